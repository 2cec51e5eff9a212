"""How many themes to ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("themes", "mixed", "weak_names", "below_bar", "near_duplicates", "name_coverage_min", "name_coverage_mean", "coherence", "smallest_theme", "not_specific", "unmatched", "largest_theme", "gini", "smallest_share")


def default_range(n_usable: int, low: int = 4, most: int = 16) -> tuple[int, int]:
    """From 4 to one theme for each 20 clauses, 16 at most."""
    return low, max(low + 1, min(most, n_usable // 20))


def sweep_row(asked: int, reports: list[dict]) -> dict:
    """One row of metrics over the reports of all scopes."""
    s = [r["summary"] for r in reports]
    small = [min((t["size"] for t in r["themes"] if not t["general"]), default=0) for r in reports]
    share = [n / max(1, x["n_clauses"]) for n, x in zip(small, s)]

    def mean(key: str) -> float:
        values = [x[key] for x in s if x[key] is not None]
        return sum(values) / len(values) if values else 0.0

    def total(key: str) -> int:
        return sum(x[key] for x in s)

    return {"asked": asked, "themes": total("n_themes") // len(s), "mixed": total("n_mixed"), "weak_names": total("n_weak_names"), "below_bar": total("n_below_bar"), "near_duplicates": total("n_near_duplicate_pairs"), "name_coverage_min": min((x["name_coverage_min"] or 0.0) for x in s), "name_coverage_mean": mean("name_coverage_mean"), "coherence": mean("coherence_npmi_mean"), "smallest_theme": min(small), "not_specific": mean("general_share"), "unmatched": mean("unassigned_share"), "largest_theme": mean("largest_share"), "gini": mean("gini"), "smallest_share": max(share)}


def sweep(counts: list[int], report_for: Callable[[int], list[dict]], progress: Callable[[int, int, int], None] | None = None) -> list[dict]:
    """A row for each count that works; ``report_for(n)`` gives the reports of all scopes for n themes."""
    rows = []
    for k, n in enumerate(counts):
        try:
            rows.append(sweep_row(n, report_for(n)))
        except ValueError:  # too few clauses for so many
            pass
        if progress:
            progress(k + 1, len(counts), n)
    return rows


def with_problems(metrics: DataFrame, min_size: int = 12, max_unspecific: float = 0.25, max_smallest_share: float = 0.15) -> DataFrame:
    """Adds problems (how many things are wrong) and score."""
    left = F.col("not_specific") + F.col("unmatched")

    def one(c: Column) -> Column:
        return c.cast("int")

    problems = F.col("mixed") + F.greatest("weak_names", "below_bar") + F.col("near_duplicates") + one(F.col("smallest_theme") < min_size) + one(left > max_unspecific) + one(F.col("smallest_share") > max_smallest_share)
    return metrics.withColumn("problems", problems).withColumn("score", F.col("coherence") + F.col("name_coverage_mean") - left - F.col("smallest_share"))


def recommend(metrics: DataFrame, tolerance: float = 0.10, **limits) -> DataFrame:
    """The row to take: of the sets without problems that are within ``tolerance`` of the best score the one with the most themes,
    else the one with the fewest problems, then the best score. Empty for no rows."""
    d = with_problems(metrics, **limits)
    top = F.max(F.when(F.col("problems") == 0, F.col("score")))
    best = d.crossJoin(F.broadcast(d.agg(top.alias("top"))))
    good = (F.col("problems") == 0) & (F.col("score") >= F.col("top") - tolerance)
    return best.withColumn("good", F.coalesce(good, F.lit(False))).orderBy(F.col("good").desc(), F.when(F.col("good"), -F.col("asked")).asc_nulls_last(), "problems", F.col("score").desc(), "asked").limit(1).drop("top", "good")

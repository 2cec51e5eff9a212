"""Comparing assignments and ratings with a coder's and with another run's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("clause_id", "theme_idx")) -> DataFrame:
    """(keys, change): pairs that only the second run has are added, those that only the first has removed."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def theme_overlap(found: DataFrame, coded: DataFrame, item: str = "item") -> DataFrame:
    """(coder_theme, theme, both, in_found, in_coded, f1) of every pair that shares an item.

    found: item, theme; coded: item, coder_theme.
    """
    f, c = found.select(item, "theme").distinct(), coded.select(item, "coder_theme").distinct()
    both = f.join(c, item).groupBy("coder_theme", "theme").agg(F.count("*").alias("both"))
    out = both.join(f.groupBy("theme").agg(F.count("*").alias("in_found")), "theme").join(c.groupBy("coder_theme").agg(F.count("*").alias("in_coded")), "coder_theme")
    return out.withColumn("f1", 2 * F.col("both") / (F.col("in_found") + F.col("in_coded")))


def theme_f1(found: DataFrame, coded: DataFrame, item: str = "item") -> DataFrame:
    """(f1): for each of the coder's themes the best match, weighted by how often the coder used it."""
    best = theme_overlap(found, coded, item).groupBy("coder_theme").agg(F.max("f1").alias("best"))
    weights = coded.select(item, "coder_theme").distinct().groupBy("coder_theme").agg(F.count("*").alias("w"))
    return weights.join(best, "coder_theme", "left").agg((F.sum(F.coalesce("best", F.lit(0.0)) * F.col("w")) / F.sum("w")).alias("f1"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, macro_f1) over the labels that occur on either side."""
    c = confusion(df, truth, predicted)
    rows = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("t"))
    cols = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("p"))
    hits = c.where("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("h"))
    per = rows.join(cols, "label", "full").join(hits, "label", "left").fillna(0, ["t", "p", "h"])
    return per.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def coder_groups(columns: list[str]) -> dict[str, list[str]]:
    """The columns of a coder's sheet by theme: those that differ only in a mark of polarity belong together."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(re.sub(r"\s*\((\+|-|Neutral|1)\)\s*$", "", c).strip(), []).append(c)
    return out


def coded_items(sheet: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """(item, coder_theme) from a sheet with a column for each theme and polarity."""
    groups = coder_groups(columns)
    hits = F.array(*[F.when(F.exists(F.array(*[F.col(f"`{c}`").isNotNull() for c in cs]), lambda b: b), F.lit(name)) for name, cs in groups.items()])
    return sheet.select(item, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("coder_theme"))


def mean_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means that leave nulls out; null for no values."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def before_after(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, before, after, change) of two tables of metrics."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot([key], metrics, "metric", name)

    out = tall(before, "before").join(tall(after, "after"), [key, "metric"], "full")
    return out.withColumn("change", F.col("after") - F.col("before"))


def display_counts(rated: DataFrame, theme: str = "theme", label: str = "label") -> DataFrame:
    """(theme, label, n, rank): counts of ratings by theme, most mentioned themes first."""
    g = rated.groupBy(theme, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(theme))
    return g.withColumn("mentions", total)

"""Queries over vectors: centres, similarities, assignment, refinement, shaping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import assign, clustering, discover, evaluation, quality
from ..operators.assign import AssignRules, Theme
from .base import query, table

N = 10
# bars that suit the vectors of the test tables
RULES = AssignRules(min_sim=0.25, secondary_margin=0.1, fallback_min_sim=0.15, max_themes_per_clause=2)
DISCOVER = discover.DiscoverRules(floor=0.25, secondary_margin=0.1, shown_floor=0.15, floor_quantile=0.05, floor_max=0.3)

# centres: unit means of the labels' vectors, numbered by label
CENTRES = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) + 1e-12 AS n FROM m GROUP BY label),
c AS (SELECT m.label AS theme_idx, list(x / n.n ORDER BY i) AS centre FROM m JOIN n USING (label) GROUP BY m.label)"""
SIMS = CENTRES + """,
s AS (SELECT vec_id, theme_idx, list_inner_product(embedding::DOUBLE[], centre) AS sim FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme_idx) AS rank, max(sim) OVER (PARTITION BY vec_id) AS best FROM s)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    return e.select("vec_id", "label", F.col("embedding").alias("vec"))


def label_themes(clauses: DataFrame, general: int | None = None) -> list[Theme]:
    centres = discover.centres_of(clauses, "vec", "label")
    return [Theme(f"label {k}", centres[k][1], general=k == general) for k in sorted(centres)]


def _centres(themes: list[Theme]) -> np.ndarray:
    return np.array([t.centre for t in themes])


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS mu FROM e GROUP BY i), d AS (SELECT vec_id, i, x - 0.7 * mu AS x FROM e JOIN m USING (i)), n AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-12 AS n FROM d GROUP BY vec_id)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(x / n, 6) + 0.0 AS x FROM d JOIN n USING (vec_id)""")
def center_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    mean = np.array(V.group_means(e.select(F.lit(0).alias("k"), "vec"), "k", "vec").first()["mean"])
    c = V.centred(e, "vec", mean, 0.7)
    return c.select("vec_id", F.posexplode("centred").alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH {CENTRES} SELECT theme_idx, CAST(i - 1 AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM (SELECT theme_idx, unnest(centre) AS x, generate_subscripts(centre, 1) AS i FROM c)")
def theme_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = V.group_means(labelled(spark, sf_dir), "label", "vec")
    return means.select(F.col("label").alias("theme_idx"), F.posexplode(V.unit("mean")).alias("i", "x")).select("theme_idx", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH {SIMS} SELECT vec_id, theme_idx, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0.0 AS sim FROM r WHERE rank <= 3")
def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    top = V.similarities(e, "vec", _centres(label_themes(e))).select("vec_id", F.posexplode(F.slice(assign.ranked(F.col("sims")), 1, 3)).alias("at", "r"))
    return top.select("vec_id", F.col("r.idx").alias("theme_idx"), (F.col("at") + 1).alias("rank"), (F.round("r.sim", 6) + 0.0).alias("sim"))


_SEM = f"""{SIMS}, sem AS (SELECT vec_id, theme_idx, sim FROM r WHERE rank <= 2 AND ((rank = 1 AND sim >= 0.25) OR (rank > 1 AND sim >= 0.25 AND best - sim <= 0.1)))"""


@query(f"WITH {_SEM} SELECT vec_id, theme_idx, round(sim, 6) AS sim FROM sem")
def assign_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    e = labelled(spark, sf_dir)
    out, _ = assign.assign_themes(e, label_themes(e), replace(RULES, fallback_min_sim=None), with_keywords=False)
    return out.select("vec_id", "theme_idx", F.round("sim", 6).alias("sim"))


_FB = f"""{_SEM}, fb AS (SELECT vec_id, theme_idx, sim FROM r WHERE rank = 1 AND sim >= 0.15 AND vec_id NOT IN (SELECT vec_id FROM sem))"""


@query(f"WITH {_FB} SELECT vec_id, theme_idx, round(sim, 6) AS sim, 'semantic' AS via FROM sem UNION ALL SELECT vec_id, theme_idx, round(sim, 6), 'fallback' FROM fb")
def assign_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    out, _ = assign.assign_themes(e, label_themes(e), RULES, with_keywords=False)
    return out.select("vec_id", "theme_idx", F.round("sim", 6).alias("sim"), "via")


@query(f"WITH {_FB}, a AS (SELECT * FROM sem UNION ALL SELECT * FROM fb) SELECT theme_idx, CAST(count(*) AS BIGINT) AS clauses, round(avg(sim), 6) AS mean_sim FROM a GROUP BY theme_idx")
def theme_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    out, _ = assign.assign_themes(e, label_themes(e), RULES, with_keywords=False)
    return out.groupBy("theme_idx").agg(F.count("*").alias("clauses"), F.round(F.avg("sim"), 6).alias("mean_sim"))


# a keyword hit stands in: vectors whose id is divisible by 7 hit the theme id % 10
_KW = "kw AS (SELECT vec_id, CAST(vec_id % 10 AS INTEGER) AS theme_idx FROM embeddings WHERE vec_id % 7 = 0)"


def _stand_in_keywords():
    return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda j: (F.col("vec_id") % 7 == 0) & (F.col("vec_id") % N == j))


@query(f"""
WITH {SIMS}, {_KW}, sem AS (SELECT vec_id, theme_idx, sim FROM r WHERE rank <= 2 AND ((rank = 1 AND sim >= 0.25) OR (rank > 1 AND sim >= 0.25 AND best - sim <= 0.1))),
b AS (SELECT s.vec_id, s.theme_idx, s.sim, sem.vec_id IS NOT NULL AS sem, kw.vec_id IS NOT NULL AS kw FROM s LEFT JOIN sem USING (vec_id, theme_idx) LEFT JOIN kw USING (vec_id, theme_idx)),
h AS (SELECT * FROM b WHERE sem OR kw), fb AS (SELECT vec_id, theme_idx, sim, false AS sem, false AS kw FROM r WHERE rank = 1 AND sim >= 0.15 AND vec_id NOT IN (SELECT vec_id FROM h)),
a AS (SELECT * FROM h UNION ALL SELECT * FROM fb),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim + CASE WHEN sem THEN 0.15 ELSE 0 END + CASE WHEN kw THEN 0.15 ELSE 0 END DESC, theme_idx) AS pos FROM a)
SELECT vec_id, theme_idx, CASE WHEN sem AND kw THEN 'both' WHEN sem THEN 'semantic' WHEN kw THEN 'keyword' ELSE 'fallback' END AS via FROM k WHERE pos <= 2""")
def assign_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    themes = label_themes(e)
    scored = assign.theme_similarities(e, themes)
    chosen = assign.chosen_themes(F.col("sims"), _stand_in_keywords(), themes, RULES)
    return scored.select("vec_id", F.explode(chosen).alias("a")).select("vec_id", "a.theme_idx", "a.via")


@query(f"""
WITH {SIMS}, sem AS (SELECT vec_id, theme_idx, sim FROM r WHERE rank <= 2 AND ((rank = 1 AND sim >= 0.25) OR (rank > 1 AND sim >= 0.25 AND best - sim <= 0.1))),
sp AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme_idx) AS pos FROM s WHERE theme_idx <> 9),
g AS (SELECT vec_id, sim AS general_sim FROM s WHERE theme_idx = 9),
fb AS (SELECT sp.vec_id, theme_idx, sim FROM sp JOIN g USING (vec_id) WHERE pos = 1 AND sim >= 0.15 AND sim >= general_sim AND vec_id NOT IN (SELECT vec_id FROM sem)),
a AS (SELECT vec_id, theme_idx, 'semantic' AS via FROM sem UNION ALL SELECT vec_id, theme_idx, 'fallback' FROM fb),
t AS (SELECT vec_id FROM a WHERE theme_idx <> 9), k AS (SELECT * FROM a WHERE theme_idx <> 9 OR vec_id NOT IN (SELECT vec_id FROM t))
SELECT vec_id, theme_idx, via FROM k UNION ALL SELECT vec_id, 9, 'fallback' FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM k)""")
def assign_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    themes = label_themes(e, general=9)
    # no text_key: the rule for whole answers does not apply here
    out, _ = assign.assign_themes(e, themes, RULES, with_keywords=False)
    return out.select("vec_id", "theme_idx", "via")


@query(f"""
WITH {SIMS}, sem AS (SELECT vec_id, theme_idx, sim FROM r WHERE rank <= 2 AND ((rank = 1 AND sim >= 0.25) OR (rank > 1 AND sim >= 0.25 AND best - sim <= 0.1))),
sp AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme_idx) AS pos FROM s WHERE theme_idx <> 9), g AS (SELECT vec_id, sim AS general_sim FROM s WHERE theme_idx = 9),
fb AS (SELECT sp.vec_id, theme_idx, sim FROM sp JOIN g USING (vec_id) WHERE pos = 1 AND sim >= 0.15 AND sim >= general_sim AND vec_id NOT IN (SELECT vec_id FROM sem)),
a AS (SELECT vec_id, theme_idx FROM sem UNION ALL SELECT vec_id, theme_idx FROM fb), t AS (SELECT vec_id FROM a WHERE theme_idx <> 9), k AS (SELECT * FROM a WHERE theme_idx <> 9 OR vec_id NOT IN (SELECT vec_id FROM t)),
f AS (SELECT vec_id, theme_idx FROM k UNION ALL SELECT vec_id, 9 FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM k)),
x AS (SELECT vec_id, theme_idx, vec_id // 3 AS answer FROM f)
SELECT vec_id, theme_idx FROM x WHERE theme_idx <> 9 OR answer NOT IN (SELECT answer FROM x WHERE theme_idx <> 9)""")
def assign_answer_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    clauses = e.withColumn("text_key", F.floor(F.col("vec_id") / 3).cast("string"))
    out, _ = assign.assign_themes(clauses, label_themes(e, general=9), RULES, with_keywords=False)
    return out.select("vec_id", "theme_idx")


_REFINE = CENTRES
for _k in range(2):
    _REFINE += f""",
s{_k} AS (SELECT vec_id, embedding, theme_idx, list_inner_product(embedding::DOUBLE[], centre) AS sim FROM embeddings, {'c' if _k == 0 else f'c{_k}'}),
t{_k} AS (SELECT vec_id, embedding, theme_idx FROM s{_k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, theme_idx) = 1 AND sim >= 0.25),
x{_k} AS (SELECT theme_idx, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM t{_k}),
m{_k} AS (SELECT theme_idx, i, avg(x) AS x, count(*) AS k FROM x{_k} GROUP BY ALL),
u{_k} AS (SELECT theme_idx, i, x / (sqrt(sum(x * x) OVER (PARTITION BY theme_idx)) + 1e-12) AS x FROM m{_k} WHERE k >= 5),
o{_k} AS (SELECT theme_idx, unnest(centre) AS x, generate_subscripts(centre, 1) AS i FROM {'c' if _k == 0 else f'c{_k}'}),
a{_k} AS (SELECT theme_idx, i, o{_k}.x + coalesce(u{_k}.x, 0) AS x FROM o{_k} LEFT JOIN u{_k} USING (theme_idx, i)),
b{_k} AS (SELECT theme_idx, i, x / (sqrt(sum(x * x) OVER (PARTITION BY theme_idx)) + 1e-12) AS x FROM a{_k}),
c{_k + 1} AS (SELECT theme_idx, list(x ORDER BY i) AS centre FROM b{_k} GROUP BY theme_idx)"""


@query(f"WITH {_REFINE} SELECT theme_idx, CAST(i - 1 AS INTEGER) AS i, round(x, 5) + 0.0 AS x FROM (SELECT theme_idx, unnest(centre) AS x, generate_subscripts(centre, 1) AS i FROM c2)")
def refine_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    c = discover.refine(e, _centres(label_themes(e)), DISCOVER)
    rows = [(j, i, float(np.round(x, 5)) + 0.0) for j, centre in enumerate(c) for i, x in enumerate(centre)]
    return spark.createDataFrame(rows, "theme_idx int, i int, x double")


@query(f"""
WITH {SIMS}, o AS (SELECT vec_id, theme_idx, sim, 'text ' || (vec_id // 2) AS t FROM r WHERE rank = 1),
d AS (SELECT *, row_number() OVER (PARTITION BY theme_idx, t ORDER BY round(sim, 12) DESC, vec_id) AS k FROM o)
SELECT theme_idx, CAST(row_number() OVER (PARTITION BY theme_idx ORDER BY round(sim, 12) DESC, vec_id) AS INTEGER) AS rank, t AS clause FROM d WHERE k = 1
QUALIFY row_number() OVER (PARTITION BY theme_idx ORDER BY round(sim, 12) DESC, vec_id) <= 3""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    clauses = e.withColumn("clause", F.concat(F.lit("text "), F.floor(F.col("vec_id") / 2)))
    return discover.representatives(clauses, _centres(label_themes(e)), 3, key="vec_id").select("theme_idx", "rank", "clause")


@query(f"""
WITH {SIMS}, o AS (SELECT theme_idx, sim FROM r WHERE rank = 1 AND sim >= 0.25)
SELECT theme_idx, CAST(count(*) AS BIGINT) AS frequency, round(CASE WHEN count(*) >= 8 THEN greatest(0.25, least(quantile_cont(sim, 0.05), 0.3)) ELSE 0.25 END, 6) AS min_sim FROM o GROUP BY theme_idx""")
def entry_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    return discover.entry_bars(e, _centres(label_themes(e)), DISCOVER).select("theme_idx", "frequency", F.round("min_sim", 6).alias("min_sim"))


@query(f"WITH {SIMS} SELECT vec_id, theme_idx FROM r WHERE (rank = 1 AND sim >= 0.15) OR (rank = 2 AND sim >= 0.25 AND best - sim <= 0.1)")
def shown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    return discover.shown_members(e, _centres(label_themes(e)), DISCOVER, key="vec_id")


@query(f"""
WITH {CENTRES}, z AS (SELECT label, count(*) AS size FROM embeddings WHERE label IS NOT NULL GROUP BY label),
k AS (SELECT label, size, row_number() OVER (ORDER BY size DESC, label) AS pos FROM z),
p AS (SELECT a.label, b.label AS target, list_inner_product(ca.centre, cb.centre) AS sim FROM k a JOIN k b ON a.pos > 6 AND b.pos <= 6 JOIN c ca ON ca.theme_idx = a.label JOIN c cb ON cb.theme_idx = b.label),
t AS (SELECT label, arg_max(target, sim) AS target FROM p GROUP BY label)
SELECT coalesce(t.target, k.label) AS cluster, CAST(sum(size) AS BIGINT) AS size FROM k LEFT JOIN t USING (label) GROUP BY 1""")
def reduce_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = labelled(spark, sf_dir).withColumnRenamed("label", "cluster")
    return discover.fold_small(groups, 6).groupBy("cluster").agg(F.count("*").alias("size"))


@query(f"""
WITH {SIMS}, z AS (SELECT theme_idx, count(*) AS size FROM r WHERE rank = 1 AND sim >= 0.25 GROUP BY theme_idx), t AS (SELECT theme_idx, coalesce(size, 0) AS size FROM c LEFT JOIN z USING (theme_idx)),
o AS (SELECT *, row_number() OVER (ORDER BY theme_idx = 9, theme_idx IN (7, 8), size, -theme_idx) AS pos FROM t)
SELECT theme_idx, CAST(size AS BIGINT) AS size FROM o WHERE pos > 4""")
def trim_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    themes = label_themes(e, general=9)
    themes = [Theme(t.name, t.centre, general=t.general, extra={"required": j in (7, 8)}) for j, t in enumerate(themes)]
    found = {r.theme_idx: r.frequency for r in discover.entry_bars(e, _centres(themes), DISCOVER).collect()}
    sizes = [found.get(j, 0) for j in range(len(themes))]
    return spark.createDataFrame([(j, sizes[j]) for j in discover.trim_to_total(themes, sizes, 6)], "theme_idx int, size long")


@query(f"WITH {CENTRES} SELECT a.theme_idx AS i, b.theme_idx AS j, round(list_inner_product(a.centre, b.centre), 6) AS sim FROM c a JOIN c b ON a.theme_idx < b.theme_idx WHERE list_inner_product(a.centre, b.centre) >= 0.1")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centres(label_themes(labelled(spark, sf_dir)))
    pairs = quality.theme_pairs(quality.theme_frame(spark, c, [[]] * len(c)))
    return quality.duplicate_pairs(pairs, merge_sim=0.1).select("i", "j", F.round("centre_cosine", 6).alias("sim"))


@query(f"""
WITH {CENTRES}, p AS (SELECT a.theme_idx AS i, b.theme_idx AS j, list_inner_product(a.centre, b.centre) AS sim FROM c a JOIN c b ON a.theme_idx < b.theme_idx),
z AS (SELECT i, j, (sim - avg(sim) OVER ()) / stddev_pop(sim) OVER () AS z, CASE WHEN (i + j) % 2 = 0 THEN 1.0 ELSE 0.0 END AS jac FROM p),
y AS (SELECT *, (jac - avg(jac) OVER ()) / stddev_pop(jac) OVER () AS zj FROM z)
SELECT i, j, round(z, 6) AS z FROM y WHERE z >= 0.8 AND jac > 0 AND zj >= 0.8""")
def outlier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centres(label_themes(labelled(spark, sf_dir)))
    words = [["even"] if j % 2 == 0 else ["odd"] for j in range(len(c))]
    pairs = quality.theme_pairs(quality.theme_frame(spark, c, words))
    return quality.outlier_pairs(pairs, 0.8).select("i", "j", F.round("strength", 6).alias("z"))


@query(f"""
WITH {SIMS}, a AS (SELECT vec_id, theme_idx FROM r WHERE rank = 1 AND sim >= 0.25), b AS (SELECT vec_id, theme_idx FROM r WHERE rank <= 2 AND sim >= 0.2 AND best - sim <= 0.05)
SELECT vec_id, theme_idx, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT vec_id, theme_idx, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    themes = label_themes(e)
    one = AssignRules(min_sim=0.25, secondary_margin=-1.0, fallback_min_sim=None)
    two = AssignRules(min_sim=0.2, secondary_margin=0.05, fallback_min_sim=None, max_themes_per_clause=2)
    a, b = (assign.assign_themes(e, themes, rules, with_keywords=False)[0] for rules in (one, two))
    return evaluation.run_diff(a, b, ("vec_id", "theme_idx"))


@query(f"""
WITH {SIMS}, f AS (SELECT vec_id AS item, theme_idx AS theme FROM r WHERE rank <= 2 AND sim >= 0.2), g AS (SELECT vec_id AS item, label AS coder FROM embeddings WHERE label IS NOT NULL),
o AS (SELECT coder, theme, count(*) AS b FROM f JOIN g USING (item) GROUP BY ALL), nf AS (SELECT theme, count(*) AS n FROM f GROUP BY ALL), ng AS (SELECT coder, count(*) AS n FROM g GROUP BY ALL),
w AS (SELECT coder, max(2.0 * b / (nf.n + ng.n)) AS best FROM o JOIN nf USING (theme) JOIN ng USING (coder) GROUP BY coder)
SELECT round(sum(coalesce(best, 0) * n) / sum(n), 6) AS f1 FROM ng LEFT JOIN w USING (coder)""")
def theme_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    top = V.similarities(e, "vec", _centres(label_themes(e))).select("vec_id", F.explode(F.slice(assign.ranked(F.col("sims")), 1, 2)).alias("r")).where("r.sim >= 0.2")
    found = top.select(F.col("vec_id").alias("item"), F.col("r.idx").alias("theme"))
    return evaluation.theme_f1(found, e.select(F.col("vec_id").alias("item"), F.col("label").alias("coder_theme"))).select(F.round("f1", 6).alias("f1"))


@query("""
WITH z AS (SELECT label, count(*)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL GROUP BY label)
SELECT round(sum(abs(a.x - b.x)) / (2.0 * (SELECT count(*) FROM z) * (SELECT sum(x) FROM z)), 6) AS gini FROM z a, z b""")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("size"))
    return quality.gini(sizes).select(F.round("gini", 6).alias("gini"))


@query(f"""
WITH {SIMS}, f AS (SELECT vec_id, theme_idx FROM r WHERE rank = 1 AND sim >= 0.25), z AS (SELECT theme_idx, count(*) AS size FROM f GROUP BY theme_idx), total AS (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.theme_idx, b.theme_idx AS other, list_inner_product(a.centre, b.centre) AS sim FROM c a JOIN c b ON a.theme_idx <> b.theme_idx)
SELECT c.theme_idx, CAST(coalesce(size, 0) AS BIGINT) AS size, round(coalesce(size, 0) / n, 6) AS share, (SELECT arg_max(other, sim) FROM p WHERE p.theme_idx = c.theme_idx) AS nearest_theme, round((SELECT max(sim) FROM p WHERE p.theme_idx = c.theme_idx), 6) AS nearest_cosine
FROM c LEFT JOIN z USING (theme_idx), total""")
def scope_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    themes = label_themes(e)
    rules = AssignRules(min_sim=0.25, secondary_margin=-1.0, fallback_min_sim=None)
    clauses = e.select(F.col("vec_id").alias("clause_id"), F.col("vec_id").cast("string").alias("text_key"), F.lit("").alias("clause"), "vec")
    assigned, _ = assign.assign_themes(clauses, themes, rules, with_keywords=False)
    report = quality.scope_report(clauses.drop("vec"), assigned, themes)
    number = {t.name: j for j, t in enumerate(themes)}
    rows = [(j, r["size"], round(r["share"], 6), number[r["nearest_theme"]], round(r["nearest_cosine"], 6)) for j, r in enumerate(report["themes"])]
    return spark.createDataFrame(rows, "theme_idx int, size long, share double, nearest_theme int, nearest_cosine double")


@query()
def ward_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = labelled(spark, sf_dir).withColumn("cluster", F.lit(0)).withColumnRenamed("vec_id", "clause_id").drop("label")
    halved, _ = discover.bisect(groups, 0, DISCOVER, 1)
    return halved.groupBy("cluster").agg(F.count("*").alias("size"))


@query()
def split_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = labelled(spark, sf_dir).withColumn("cluster", F.lit(0)).withColumnRenamed("vec_id", "clause_id").drop("label")
    return discover.split_to_count(groups, 4, DISCOVER).groupBy("cluster").agg(F.count("*").alias("size"))


@query("""
WITH l AS (SELECT DISTINCT label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS position, CASE label WHEN 0 THEN 'pair' WHEN 2 THEN 'second' WHEN 4 THEN 'fourth' ELSE 'label ' || label END AS name, 'label ' || label AS matched_by, CASE label WHEN 0 THEN 2 ELSE 0 END AS parts
FROM l WHERE label NOT IN (1, 3)""")
def curation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.curation import curate

    themes = label_themes(labelled(spark, sf_dir))
    edits = {"merge": {"pair": ["label 0", "label 1"]}, "rename": {"label 2": "second"}, "drop": ["label 3"], "ops": [["rename", "label 4", "fourth"], ["drop_if_present", "nobody"]]}
    out = curate(themes, edits)
    return spark.createDataFrame([(k, t.name, t.matched_by, len(t.sub_centres)) for k, t in enumerate(out)], "position int, name string, matched_by string, parts int")


@query()
def group_words_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centres(label_themes(labelled(spark, sf_dir)))
    labels = clustering.cut(c, 3, "average")
    return spark.createDataFrame([(j, int(g)) for j, g in enumerate(labels)], "theme_idx int, group_no int")


@query(f"""
WITH {_FB}, a AS (SELECT vec_id // 3 AS answer, theme_idx FROM sem UNION ALL SELECT vec_id // 3, theme_idx FROM fb),
k AS (SELECT * FROM a WHERE theme_idx <> 9 OR answer NOT IN (SELECT answer FROM a WHERE theme_idx <> 9))
SELECT c.theme_idx, 'label ' || c.theme_idx AS theme, CAST(count(DISTINCT k.answer) AS BIGINT) AS answers FROM c LEFT JOIN k USING (theme_idx) GROUP BY c.theme_idx""")
def themes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir)
    out, _ = assign.assign_themes(e, label_themes(e), RULES, with_keywords=False)
    keyed = out.withColumn("text_key", F.floor(F.col("vec_id") / 3).cast("string"))
    return discover.themes_table(keyed, label_themes(e, general=9)).select("theme_idx", "theme", "answers")


@query(f"""
WITH {CENTRES}, p AS (SELECT theme_idx, abs(list_inner_product(centre, (SELECT centre FROM c WHERE theme_idx = 0))) AS p FROM c),
z AS (SELECT theme_idx, (p - avg(p) OVER ()) / (stddev_pop(p) OVER () + 1e-12) AS z FROM p) SELECT 'label ' || theme_idx || unnest(['', 's']) AS word FROM z WHERE z > 1.0""")
def opinion_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = label_themes(labelled(spark, sf_dir))
    words = spark.createDataFrame([(t.name, t.centre.tolist()) for t in themes], "word string, vec array<double>")
    return discover.opinion_words(words, themes[0].centre, 1.0)


@query()
def dense_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labelled(spark, sf_dir).drop("label").withColumnRenamed("vec_id", "clause_id")
    return discover.dense_groups(e, DISCOVER, 2, 6).groupBy("cluster").agg(F.count("*").alias("size"))

"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is joins and aggregations; each round is written to the shared
folder, so no lineage grows and a lost executor costs one round at most. The
driver sees a count and a checksum of each round, never edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """edges (a, b) of longs -> (node, root): the smallest node each node can reach; only nodes with a link to another appear."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, k, before = _saved(links, f"{folder}/links-0"), 0, None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, k = now, k + 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = _saved(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/links-{k}")

"""New answers against frozen themes, as a stream.

Cutting, assignment and rating look at one answer at a time, so a stream needs
no state but for leaving out repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import centred
from ..operators import assign, backends, ingest, segment


def score_answers(answers: DataFrame, themes: list[assign.Theme], embedder, mean: np.ndarray, strength: float = 0.7, axis: np.ndarray | None = None, rules: assign.AssignRules = assign.AssignRules(), seg: segment.SegmentRules = segment.SegmentRules(), min_chars: int = 2, non_answer: str | None = None, keywords: assign.Keywords | None = None) -> DataFrame:
    """row_id, text_key, clause, theme_idx, sim and via of each clause of answers (row_id, text).

    Works on tables and on streams: vectors are computed within the rows, without a cache.
    ``keywords`` are the tested words of a run on a table (``assign.tested_keywords``).
    """
    marked = ingest.mark_valid(answers, min_chars, non_answer).where("valid")
    parts = marked.select("row_id", "text_key", F.posexplode(_clauses(seg)).alias("pos", "clause"))
    parts = parts.withColumn("clause_id", F.xxhash64("row_id", "pos"))

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = embedder.encode(batch.column("clause").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(np.asarray(vectors, np.float32)), pa.list_(pa.float32()))], names=[*batch.schema.names, "vec"])

    from pyspark.sql import types as T

    with_vec = parts.mapInArrow(encode, T.StructType([*parts.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))]))
    placed = centred(with_vec, "vec", mean, strength, axis, "_v").drop("vec").withColumnRenamed("_v", "vec")
    scored = assign.theme_similarities(placed, themes)
    hits = assign.keyword_flags(themes, keywords, rules) if keywords else None
    chosen = assign.chosen_themes(F.col("sims"), hits, themes, rules)
    return scored.select("row_id", "text_key", "clause", F.explode(chosen).alias("a")).select("row_id", "text_key", "clause", "a.*")


def _clauses(seg: segment.SegmentRules):
    from ..functions import text as X

    return X.clauses("text_clean", seg.contrast_words, seg.min_words, seg.keep_short, seg.short_not_opinion, seg.and_words)


def start(answers: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, event_time: str | None = None, late: str = "1 day", once: bool = False) -> StreamingQuery:
    """Appends the scores of a stream of answers to ``path``; answers that arrive twice within ``late`` are scored once."""
    if event_time:
        answers = answers.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["row_id"])
    writer = score(answers).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def theme_counts(assigned: DataFrame, event_time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mentions of each theme in windows of event time; windows close when the watermark passes them."""
    return assigned.withWatermark(event_time, late).groupBy(F.window(event_time, window), "theme_idx").agg(F.count("*").alias("mentions"))

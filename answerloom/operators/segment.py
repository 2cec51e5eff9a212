"""Answers into clauses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words at which an answer turns, and single words that are no opinion.
CONTRAST_WORDS = ("but", "however", "although", "though", "yet", "whereas")
SHORT_NOT_OPINION = (
    "nothing", "none", "nope", "no", "yes", "also", "well", "and", "still", "only", "just", "really", "actually", "honestly", "overall", "otherwise", "however", "anyway", "though", "then", "now",
)


@dataclass(frozen=True)
class SegmentRules:
    min_words: int = 2
    contrast_words: tuple[str, ...] = CONTRAST_WORDS
    keep_short: bool = True
    short_not_opinion: tuple[str, ...] = SHORT_NOT_OPINION
    and_words: int = 0


def cut_clauses(texts: DataFrame, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """text_key, pos, clause, clause_key and clause_id of each clause of ``texts`` (text_key, text_clean).

    A clause's id is a hash of its text's key and its place, so that it does not
    depend on the order of rows.
    """
    parts = X.clauses("text_clean", rules.contrast_words, rules.min_words, rules.keep_short, rules.short_not_opinion, rules.and_words)
    out = texts.select("text_key", F.posexplode(parts).alias("pos", "clause"))
    return out.withColumn("clause_key", X.short_sha(F.lower("clause"))).withColumn("clause_id", F.xxhash64("text_key", "pos"))

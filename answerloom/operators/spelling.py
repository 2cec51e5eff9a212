"""Repairing rare misspellings, learned from the answers themselves."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

WORD = r"[A-Za-z][A-Za-z]*(?:['’][A-Za-z]+)?"


@dataclass(frozen=True)
class SpellRules:
    min_count: int = 3
    min_len: int = 5
    long_word: int = 7
    often: int = 5


def word_counts(texts: DataFrame, text: str = "text_clean") -> DataFrame:
    """(word, n) of all words, lower case."""
    return texts.select(F.explode(F.regexp_extract_all(X.col(text), F.lit(WORD), 0)).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def proper_nouns(texts: DataFrame, text: str = "text_clean") -> DataFrame:
    """(word): words written with a capital letter inside a sentence."""
    inside = F.regexp_extract_all(X.col(text), F.lit(r"[^.!?:;\n\s]\s+([A-Z][A-Za-z]*(?:['’][A-Za-z]+)?)"), 1)
    return texts.select(F.explode(inside).alias("w")).select(F.lower("w").alias("word")).distinct()


def spelling_candidates(counts: DataFrame, rules: SpellRules = SpellRules(), dictionary: DataFrame | None = None) -> DataFrame:
    """(word, n, candidate, candidate_n, distance) of rare words and frequent ones a letter or two away.

    Words one or two edits apart have a string in common that each becomes by so many
    deletions, so the join is one of equal strings and grows with the words, not with
    their pairs. Without a dictionary, words used often are the known ones.
    """
    known = dictionary.select(F.lower("word").alias("word")).distinct() if dictionary is not None else None
    rare = counts.where((F.col("n") < rules.min_count) & (F.length("word") >= rules.min_len) & ~F.rlike("word", F.lit("['’]")))
    if known is not None:
        rare = rare.join(known, "word", "left_anti")
    often = counts.where((F.col("n") >= rules.min_count) & (F.length("word") >= rules.min_len - 2) & ~F.rlike("word", F.lit("['’]")))
    if known is not None:
        often = often.join(known, "word", "left_semi")
    most = F.when(F.length("word") >= rules.long_word, 2).otherwise(1)
    left = rare.select("word", F.explode(shortened(F.col("word"), F.length("word") >= rules.long_word)).alias("_key"))
    right = often.select(F.col("word").alias("candidate"), F.explode(shortened(F.col("word"), F.length("word") >= rules.long_word - 2)).alias("_key"))
    pairs = left.join(right, "_key").where(F.substring("word", 1, 1) == F.substring("candidate", 1, 1)).select("word", "candidate").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("word", "candidate", 2))
    twin = F.exists(X.spelling_twins(F.col("word")), lambda t: (t != F.col("word")) & (t == F.col("candidate")))
    pairs = pairs.where((F.col("distance") > 0) & (F.col("distance") <= most) & ~twin)
    named = often.select(F.col("word").alias("candidate"), F.col("n").alias("candidate_n"))
    return pairs.join(rare.select("word", "n"), "word").join(named, "candidate").select("word", "n", "candidate", "candidate_n", "distance")


def shortened(word: Column, twice: Column) -> Column:
    """The word and what is left of it without any one letter, and without any two where asked for."""

    def without_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))

    def both(one: Column) -> Column:
        return F.array_distinct(F.concat(F.array(word), one, F.when(twice, F.flatten(F.transform(one, without_one))).otherwise(F.array().cast("array<string>"))))

    return X.let(without_one(word), both)


def corrections(texts: DataFrame, rules: SpellRules = SpellRules(), protect: Iterable[str] = (), dictionary: DataFrame | None = None, text: str = "text_clean") -> DataFrame:
    """(word, correction): the nearest, most used candidate, where it clearly wins; contractions always.

    Names, protected words, -ise verbs and a known word with a y are left alone.
    """
    counts = word_counts(texts, text)
    names = proper_nouns(texts, text)
    found = spelling_candidates(counts, rules, dictionary).join(names, "word", "left_anti")
    keep = [p.lower() for p in protect]
    found = found.where(~F.col("word").isin(keep) & ~F.rlike("word", F.lit("is(?:e|ed|es|ing|ations?)$"))) if keep else found.where(~F.rlike("word", F.lit("is(?:e|ed|es|ing|ations?)$")))
    found = found.where(~(F.col("word").endswith("y") & (F.expr("substring(word, 1, length(word) - 1)") == F.col("candidate"))))
    nearest = found.withColumn("_least", F.min("distance").over(Window.partitionBy("word"))).where("distance = _least")
    order = Window.partitionBy("word").orderBy(F.col("candidate_n").desc(), "candidate")
    ranked = nearest.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead("candidate_n").over(order))
    learned = ranked.where("_rank = 1 and (_next is null or candidate_n > _next)").select("word", F.col("candidate").alias("correction"))
    fixed = texts.sparkSession.createDataFrame(sorted(X.CONTRACTIONS.items()), "word string, correction string")
    return learned.unionByName(fixed.join(counts.select("word"), "word", "left_semi"))


def apply_corrections(text: Column | str, fixes: dict[str, str]) -> Column:
    """The text with every listed word replaced in its own case; what is between the words stays.

    fixes: a theme-independent list, small enough to be a literal.
    """
    t = X.col(text)
    if not fixes:
        return t
    table = F.create_map(*[F.lit(x) for k, v in sorted(fixes.items()) for x in (k, v)])

    def rebuilt(v: Column) -> Column:
        def new(w: Column) -> Column:
            return F.coalesce(F.when(table[F.lower(w)].isNotNull(), X.like_case(w, table[F.lower(w)])).otherwise(w), F.lit(""))

        return F.concat_ws("", F.transform(v["gaps"], lambda g, i: F.concat(g, new(F.get(v["words"], i)))))

    return X.let(F.struct(F.regexp_extract_all(t, F.lit(WORD), 0).alias("words"), F.split(t, WORD, -1).alias("gaps")), rebuilt)


def protected_words(names: Iterable[str], keywords: Iterable[str] = ()) -> list[str]:
    import re

    return sorted({w for x in [*names, *keywords] for w in re.findall(r"[A-Za-z']{3,}", x)})

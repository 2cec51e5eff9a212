"""Ratings of texts and of themes within texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

KEYS = ("text_key", "scope", "theme_idx")


@dataclass(frozen=True)
class RatingRules:
    neutral: int = 0
    positive: int = 1
    negative: int = 2
    evidence_threshold: float = 0.6
    allowance: float = 0.05
    mixed_policy: str = "stronger"
    firm_negative_conf: float = 0.95
    complaint_phrases: tuple[str, ...] = ()
    neutral_phrases: tuple[str, ...] = ()
    neutral_blockers: tuple[str, ...] = ()
    spec: bool = False
    polarity_min_share: float = 0.6
    polarity_ratio: float = 3.0
    polarity_min_signal: float = 0.3
    polarity_min_rated: int = 10
    not_discussed_value: int | None = None
    labels: dict = field(default_factory=lambda: {"neutral": "Neutral", "positive": "Positive", "negative": "Negative"})

    def code(self, label: Column) -> Column:
        return F.when(label == "positive", self.positive).when(label == "negative", self.negative).when(label == "neutral", self.neutral)


def decide(p_pos: Column, p_neg: Column, threshold: float, allowance: float) -> tuple[Column, Column]:
    """(positive, negative): there is evidence, and the other side is not clearly stronger. Both may hold."""
    return (p_pos >= threshold) & (p_neg <= p_pos + allowance), (p_neg >= threshold) & (p_pos <= p_neg + allowance)


def lexical_fix(code: Column, flags: Column, rules: RatingRules) -> tuple[Column, Column]:
    """(code, hit): a negated opinion word overrules the model where nothing plain speaks against it."""
    up = flags["flip_pos"] & ~flags["flip_neg"] & ~flags["plain_neg"]
    down = flags["flip_neg"] & ~flags["flip_pos"] & ~flags["plain_pos"]
    return F.when(down, rules.negative).when(up, rules.positive).otherwise(code), up | down


def aggregate_ratings(scored: DataFrame, rules: RatingRules = RatingRules(), valence: dict[str, int] | None = None) -> DataFrame:
    """One rating for each text, scope and theme: probabilities and flags of all its clauses in one aggregation."""
    extended = "clause" in scored.columns and not rules.spec
    aggs = [F.max(c).alias(c) for c in ("p_pos", "p_neg", "p_neu")]
    if extended:
        firm = X.is_firm("clause") & (F.col("p_neg") >= rules.firm_negative_conf) & (F.col("p_neg") > F.col("p_pos"))
        aggs.append(F.bool_or(firm).alias("firm_neg"))
        if valence is not None:
            scored = scored.withColumn("_flags", X.lexical_flags("clause", X.valence_map(valence)))
            aggs += [F.bool_or(f"_flags.{k}").alias(k) for k in ("plain_pos", "plain_neg", "flip_pos", "flip_neg")]
            aggs.append(F.bool_or(X.says_any("clause", rules.complaint_phrases)).alias("complaint"))
    g = scored.groupBy(*KEYS).agg(*aggs)
    pos, neg = decide(F.col("p_pos"), F.col("p_neg"), rules.evidence_threshold, rules.allowance)
    both = pos & neg
    if rules.mixed_policy == "stronger":
        mixed = F.when(F.col("p_pos") >= F.col("p_neg"), rules.positive).otherwise(rules.negative)
    else:
        mixed = F.lit({"neutral": rules.neutral, "positive": rules.positive, "negative": rules.negative}[rules.mixed_policy])
    code = F.when(both, mixed).when(pos, rules.positive).when(neg, rules.negative).otherwise(rules.neutral)
    g = g.withColumn("mixed", both.cast("int")).withColumn("code", code).withColumn("lex_fix", F.lit(False))
    if not extended:
        return g.withColumn("firm_neg", F.lit(False))
    if valence is not None:
        flags = F.struct("plain_pos", "plain_neg", "flip_pos", "flip_neg")
        fixed, hit = lexical_fix(F.col("code"), flags, rules)
        g = g.withColumns({"code": fixed, "lex_fix": hit, "firm_neg": F.col("firm_neg") & ~F.col("flip_pos"), "ev_pos": F.col("plain_pos") | F.col("flip_pos"), "ev_neg": F.col("plain_neg") | F.col("flip_neg")})
    return g


def word_support(scored: DataFrame, questions: DataFrame, min_support: int = 2, negated: bool = False) -> DataFrame:
    """(word, n, questions array of mean difference): how the clauses with a word are rated in each question.

    scored: text_key, clause_key, clause, p_pos, p_neg; questions: text_key, question.
    A negated word says the opposite, so its clause does not count for it, unless ``negated`` words are asked for as well.
    Different texts under one clause_key are one clause with the words of all.
    """
    one = scored.groupBy("text_key", "clause_key").agg(F.collect_set("clause").alias("clauses"), (F.avg("p_pos") - F.avg("p_neg")).alias("v"))
    rows = one.join(questions.select("text_key", "question").distinct(), "text_key")
    scanned = F.flatten(F.transform("clauses", lambda c: X.scan(c)))
    words = F.array_distinct(F.transform(F.filter(scanned, lambda s: (F.lit(negated) | ~s["negated"]) & F.rlike(s["word"], F.lit("^[a-z']{3,}$"))), lambda s: s["word"]))
    # sums of decimals do not hang on the order of the rows, as those of doubles do
    each = rows.select("question", F.col("v").try_cast("decimal(38,20)").alias("v"), F.explode(words).alias("word"))
    by_question = each.groupBy("word", "question").agg(F.count("*").alias("n"), F.try_divide(F.sum("v").cast("double"), F.count("v")).alias("mean_v"))
    return by_question.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("mean_v").alias("means")).where(F.col("n") >= min_support)


def learned_valence(support: DataFrame, alone: DataFrame, min_conf: float = 0.65, least: float = 0.3) -> DataFrame:
    """(word, sign): words that a model takes a side on alone (alone: word, p_pos, p_neg) and that are rated so in every question."""
    sign = F.when((F.col("p_pos") >= min_conf) & (F.col("p_pos") > F.col("p_neg")), 1).when((F.col("p_neg") >= min_conf) & (F.col("p_neg") > F.col("p_pos")), -1)
    out = support.join(alone, "word").withColumn("sign", sign).where("sign is not null")
    agrees = F.forall("means", lambda m: (F.signum(m) == F.col("sign")) & (F.abs(m) >= least))
    return out.where((F.size("means") == 1) | agrees).select("word", "sign")

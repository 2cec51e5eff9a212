"""From ratings to the result table: question polarity, rewriting rules, pivot, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .sentiment import RatingRules, lexical_fix

# Wording of questions that ask for complaints or for praise.
ASKS_COMPLAINT = r"(?i)\b(?:not like|dislike[ds]?|didn.?t like|don.?t like|negative|worst|improve|complain\w*|wrong|problems?|issues?|hate[ds]?)\b"
ASKS_PRAISE = r"(?i)\b(?:like[ds]?|enjoy\w*|love[ds]?|best|positive|favou?rite|good)\b"


@dataclass(frozen=True)
class Polarity:
    """How the ratings of a question's answers are read. ``neutral_as``: the code that a bare mention means."""

    neutral_as: int
    overall: str = "all"
    short_words: int = 4
    themes_follow_question: bool = False
    opposite_min_conf: float | None = None
    themes_opposite_min_conf: float | None = None
    firm_negative_conf: float | None = None
    off: bool = False


def polarity_code(pos: Column, neg: Column, n: Column, question: Column | None, rules: RatingRules) -> Column:
    """What a question asks for, from the shares of positive and negative answers, else from its wording; null for neither."""
    signal = pos + neg >= rules.polarity_min_signal
    side = F.when(signal & (pos >= rules.polarity_ratio * neg) & (pos >= rules.polarity_min_share * (pos + neg)), rules.positive).when(signal & (neg >= rules.polarity_ratio * pos) & (neg >= rules.polarity_min_share * (pos + neg)), rules.negative)
    if question is not None:
        side = F.coalesce(side, F.when(F.rlike(question, F.lit(ASKS_COMPLAINT)), rules.negative).when(F.rlike(question, F.lit(ASKS_PRAISE)), rules.positive))
    return F.when(n >= rules.polarity_min_rated, side)


def infer_polarity(rated: DataFrame, rules: RatingRules = RatingRules(), by_name: bool = True, question: str = "question", code: str = "code") -> DataFrame:
    """(question, polarity): one aggregation over rated answers; null codes do not count."""
    c = F.col(code)
    g = rated.where(c.isNotNull()).groupBy(question).agg(F.count("*").alias("n"), F.avg((c == rules.positive).cast("double")).alias("pos"), F.avg((c == rules.negative).cast("double")).alias("neg"))
    return g.select(question, polarity_code(F.col("pos"), F.col("neg"), F.col("n"), F.col(question) if by_name else None, rules).alias("polarity"))


def opposite(code: Column | int, rules: RatingRules) -> Column:
    code = F.lit(code) if isinstance(code, int) else code
    return F.when(code == rules.positive, rules.negative).otherwise(rules.positive)


def answer_code(label: Column, text: Column, valid: Column, known: Column | None, rules: RatingRules) -> Column:
    """A whole answer's code before the question is looked at."""
    code = rules.code(label)
    if rules.spec or known is None:
        return F.when(valid, code) if not rules.spec else code
    fixed, hit = lexical_fix(code, X.lexical_flags(text, known), rules)
    return F.when(valid & (code.isNotNull() | hit), fixed)


def overall_rating(code: Column, text: Column, valid: Column, p_pos: Column, p_neg: Column, polarity: Polarity | None, rules: RatingRules, known: Column | None = None) -> Column:
    """A whole answer's final code: the question's polarity, then lukewarm wording, then Neutral for what is left."""
    out = code
    if polarity and not polarity.off and not rules.spec:
        p, praise = F.lit(polarity.neutral_as), polarity.neutral_as == rules.positive
        against = rules.negative if praise else rules.positive
        if polarity.overall != "none":
            bare = X.word_count(text) <= polarity.short_words if polarity.overall == "short" else F.lit(True)
            out = F.when((out == rules.neutral) & bare, p).otherwise(out)
        if polarity.opposite_min_conf is not None:
            weak = (p_neg if praise else p_pos) < polarity.opposite_min_conf
            out = F.when((out == against) & F.coalesce(weak, F.lit(False)), p).otherwise(out)
        if polarity.themes_follow_question:
            pos, neg = X.evaluative(X.lexical_flags(text, known)) if known is not None else (F.lit(False), F.lit(False))
            real = F.coalesce((code == against) & (neg if praise else pos), F.lit(False))
            firm = rules.firm_negative_conf if polarity.firm_negative_conf is None else polarity.firm_negative_conf
            if praise and firm:
                real |= F.coalesce((p_neg >= firm) & X.is_firm(text), F.lit(False))
            if praise:
                real |= X.says_any(text, rules.complaint_phrases)
            out = F.when(real, against).otherwise(p)
        out = F.when(valid, out)
    if not rules.spec:
        out = F.when(X.lukewarm(text, rules.neutral_phrases, known, rules.neutral_blockers), rules.neutral).otherwise(out)
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.coalesce(out, F.lit(rules.neutral))).otherwise(out)


def theme_rating(code: Column, p_pos: Column, p_neg: Column, flags: dict[str, Column], is_lukewarm: Column, polarity: Polarity | None, rules: RatingRules) -> Column:
    """A mentioned theme's code within an answer; null stays null. flags: ev_pos, ev_neg, firm_neg, complaint."""
    out = code
    if polarity and not polarity.off and not rules.spec:
        p, praise = F.lit(polarity.neutral_as), polarity.neutral_as == rules.positive
        against = rules.negative if praise else rules.positive
        out = F.when(out == rules.neutral, p).otherwise(out)
        if polarity.themes_follow_question:
            real = (out == against) & F.coalesce(flags["ev_neg" if praise else "ev_pos"], F.lit(False))
            # any positive threshold of the question switches its firm negatives on; theirs is the output's
            if praise and (0.95 if polarity.firm_negative_conf is None else polarity.firm_negative_conf):
                real |= F.coalesce(flags["firm_neg"], F.lit(False))
            if praise:
                real |= F.coalesce(flags["complaint"], F.lit(False)) & out.isNotNull()
            out = F.when(out.isNotNull(), F.when(F.coalesce(real, F.lit(False)), against).otherwise(p))
        if polarity.themes_opposite_min_conf is not None:
            weak = (p_neg if praise else p_pos) < polarity.themes_opposite_min_conf
            out = F.when((out == against) & F.coalesce(weak, F.lit(False)), p).otherwise(out)
    return F.when(is_lukewarm & out.isNotNull(), rules.neutral).otherwise(out)


def wide_result(rated: DataFrame, columns: list[str], row: str = "row_id", name: str = "column_name", code: str = "code") -> DataFrame:
    """One row for each respondent, one column for each (question, theme), in this order."""
    return rated.groupBy(row).pivot(name, columns).agg(F.first(code, ignorenulls=True))


def column_name(question: Column, theme: Column, several_questions: bool) -> Column:
    return F.concat(question, F.lit(" | "), theme) if several_questions else theme


def fill_general(wide: DataFrame, theme_columns: list[str], general: str | None, answer: str, overall: str, valid: str, rules: RatingRules) -> DataFrame:
    """The general theme takes answers that no theme took, with the answer's own rating; then unmentioned themes are filled, if asked for.

    Whether an answer has a theme is looked at before the filling.
    """
    none = F.forall(F.array(*[F.col(f"`{c}`").isNull() for c in theme_columns]), lambda b: b) & F.col(answer).isNotNull()
    out = wide.withColumn("_none", none)
    if rules.not_discussed_value is not None:
        out = out.withColumns({c: F.when(F.col(f"`{c}`").isNull() & F.col(valid), rules.not_discussed_value).otherwise(F.col(f"`{c}`")) for c in theme_columns if c != general})
    if general:
        out = out.withColumn(general, F.when(F.col("_none"), F.coalesce(f"`{general}`", overall, F.lit(rules.neutral))).otherwise(F.col(f"`{general}`")))
    return out.drop("_none")


def with_labels(wide: DataFrame, columns: list[str], rules: RatingRules) -> DataFrame:
    """Codes of the rating columns as words; other columns stay."""
    words = {rules.neutral: rules.labels["neutral"], rules.positive: rules.labels["positive"], rules.negative: rules.labels["negative"]}
    table = F.create_map(*[F.lit(x) for k, v in words.items() for x in (k, v)])
    return wide.withColumns({c: table[F.col(f"`{c}`")] for c in columns})


def detail_rows(answers: DataFrame, ratings: DataFrame) -> DataFrame:
    """A row for each answer and theme it mentions."""
    return answers.select("row_id", "respondent_id", "question", "text_key").join(ratings, "text_key")


def combined(parts: list[DataFrame]) -> DataFrame:
    """All questions' tables under each other, missing columns empty."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def search(wide: DataFrame, text: str, words: str | None, columns: list[str]) -> DataFrame:
    """Rows whose text contains the words (as they are, any case) and that mention one of the picked themes."""
    out = wide
    if columns:
        out = out.where(F.exists(F.array(*[F.col(f"`{c}`").isNotNull() for c in columns]), lambda b: b))
    return out.where(F.contains(F.lower(text), F.lit(words.lower()))) if words else out

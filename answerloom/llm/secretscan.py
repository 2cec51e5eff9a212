"""Secrets in texts, with DataFrame functions only.

Three kinds of spans come from patterns (assigned values, access keys, long
hexadecimal runs). A fourth, ``random``, comes from two first-order Markov models of
characters, one of random strings and one of ordinary identifiers: a
token is reported where the log-likelihood ratio of its transitions says random.
Both models are counts of character pairs in labelled samples, smoothed, as one
table of 128 x 128 numbers.

Positions are code points, end exclusive. They follow from ``split`` and
``regexp_extract_all`` with the same pattern: the pieces and the matches of a
text alternate, so their lengths add up to the starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Runs that are too short fail as a whole, so a least length in the pattern finds the same spans as a filter after it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters of a token from which the Markov models judge it, unless the caller says otherwise. Of random
#: tokens of letters and digits they then find 98 % or more; from 12 on still 93 %, but also 5 % of long invented words.
TOKEN_LEAST = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}"
KINDS = ("assign", "access", "hex", "random")
#: Least mean log-likelihood ratio of a random token's transitions (natural logarithm).
LEAST_RATIO = 0.2
SMOOTHING = 0.5
#: Labelled strings of each kind that are generated where none are given.
SAMPLES = 4000
MARK = "[SECRET]"
#: Columns that are added and dropped again.
_HELD, _SPANS = "__answerloom_held", "__answerloom_spans"


# Words that identifiers, paths and settings are made of, English, French, German and Spanish.
WORDS = tuple(
    "account action address array batch block buffer build cache change channel check class client cluster code column commit config connection content context count create "
    "data database date default delete device document driver enable error event example executor export factory field file filter format frame function group handler header history "
    "identifier image import index input instance interface internal iterator journal kernel language layer length level library limit list local logger manager memory message metadata "
    "method model module network number object offset option output package page parameter parser partition password path pattern performance pipeline policy process property protocol "
    "query queue random range record reference register request resource response result route sample scheduler schema script search secret section sequence server service session shuffle "
    "socket source status storage stream string structure system table target task template thread timeout token transaction transform update user value variable vector version window worker "
    "bonjour maison chemin nombre valeur erreur fichier bibliothek einstellung verzeichnis geschwindigkeit zeichenkette entwicklung direccion archivo servidor usuario contrario".split()
)
STYLES = ("snake", "camel", "kebab", "path", "run")


def labelled_samples(spark: SparkSession) -> DataFrame:
    """(text, random): a fixed set, the same in every session.

    Random strings are digests in base64 and digests in base 36. Ordinary ones are two to four of
    ``WORDS``, chosen by a digest of their number and written as identifiers, paths
    or one run of letters.
    """
    ids = spark.range(SAMPLES)
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = ids.select(F.regexp_replace(F.base64(F.unhex(digest)), "=", "").alias("text"), F.lit(True).alias("random"))
    short = ids.select(F.lower(F.concat(*[F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 36) for k in range(5)])).alias("text"), F.lit(True).alias("random"))

    def pick(k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30))

    words = F.array(*map(F.lit, WORDS))
    parts = F.transform(F.slice(F.array(*[pick(k) for k in range(4)]), 1, (pick(4) % 3 + 2).cast("int")), lambda h: F.get(words, (h % len(WORDS)).cast("int")))
    style = F.get(F.array(*map(F.lit, STYLES)), (pick(5) % len(STYLES)).cast("int"))
    camel = F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    number = F.when(pick(6) % 4 == 0, (pick(7) % 100).cast("string")).otherwise("")
    text = F.when(style == "snake", F.array_join(parts, "_")).when(style == "camel", camel).when(style == "kebab", F.array_join(parts, "-")).when(style == "path", F.array_join(parts, "/")).otherwise(F.array_join(parts, ""))
    return random.unionByName(short).unionByName(ids.select(F.concat(text, number).alias("text"), F.lit(False).alias("random")))


def transition_table(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """ln P(next | char, random) - ln P(next | char, ordinary) for all pairs of ASCII characters; 128 * first + second."""
    ascii_only = samples.select("random", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    chars = ascii_only.select("random", F.transform(F.split("text", ""), F.ascii).alias("c"))
    pairs = chars.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    # at most 2 * 128 * 128 rows
    rows = pairs.groupBy("random", "p.a", "p.b").count().collect()
    out = [0.0] * (128 * 128)
    counts = {True: {}, False: {}}
    totals = {True: [0] * 128, False: [0] * 128}
    for r in rows:
        counts[r["random"]][r["a"], r["b"]] = r["count"]
        totals[r["random"]][r["a"]] += r["count"]
    alphabet = 66
    for a in range(128):
        for b in range(128):
            p, q = ((counts[k].get((a, b), 0) + smoothing) / (totals[k][a] + smoothing * alphabet) for k in (True, False))
            out[128 * a + b] = math.log(p / q)
    return out


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct(start, kind, end)> of the matches of a pattern in their order."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def located(v: Column) -> Column:
        """Matches and pieces, computed once for the text, to spans."""
        lengths = F.transform(v["found"], lambda x, i: F.struct(F.length(F.get(v["pieces"], i)).alias("gap"), F.length(x).alias("own")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["own"]).alias("end"))
            return F.struct((begin + x["own"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        spans = F.aggregate(lengths, start, step)["out"]
        if keep is None:
            return spans
        # positions need every match, so failing ones go afterwards
        both = F.arrays_zip(spans.alias("s"), F.transform(v["found"], keep).alias("f"))
        return F.transform(F.filter(both, lambda z: z["f"]), lambda z: z["s"])

    value = F.array(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces")))
    return F.when(F.size(found) > 0, F.get(F.transform(value, located), 0)).otherwise(empty)


def mean_ratio(token: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    numbers = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")

    def total(c: Column) -> Column:
        """Over the characters' numbers, computed once for the token."""
        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda acc, i: acc + F.get(numbers, F.get(c, i) * 128 + F.get(c, i + 1)))

    chars = F.transform(F.split(token, ""), F.ascii)
    return F.when(F.length(token) > 1, F.get(F.transform(F.array(chars), total), 0) / (F.length(token) - 1)).otherwise(F.lit(0.0))


def find_secrets(docs: DataFrame, table: list[float] | None = None, least_ratio: float = LEAST_RATIO, name: str = "secret_spans", token_least: int = TOKEN_LEAST) -> DataFrame:
    """``docs`` with the column ``name`` (array of start, kind, end; kinds as in ``KINDS``), sorted; it replaces one of that name.

    Null and empty texts have no spans. A random token that touches a span of
    another kind is not reported again. Other columns stay as they are.
    """
    table = table or transition_table(labelled_samples(docs.sparkSession))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        _spans(text, ACCESS, 1),
        _spans(text, HEX, 2),
    )
    tokens = _spans(text, TOKEN % max(2, token_least), 3, lambda m: mean_ratio(m, table) >= least_ratio)
    held = docs.withColumn(_HELD, F.struct(base.alias("base"), tokens.alias("tokens")))
    found, others = F.col(_HELD)["base"], F.col(_HELD)["tokens"]
    free = F.filter(others, lambda t: ~F.exists(found, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return held.withColumn(name, F.array_sort(F.concat(found, free))).drop(_HELD)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def secret_report(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, the number of spans of each kind, SHA-256 of the pattern kinds' spans, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"), table).select("doc_id", "secret_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    n = [count(k) for k in range(len(KINDS))]
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *n[:3], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"), n[3])


def redact(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """The documents with every secret replaced by ``MARK``; n_chars, if there, counts the new text. Null texts stay null."""
    found = find_secrets(docs, table, name=_SPANS)
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MARK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    new = F.aggregate(_SPANS, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.size(_SPANS) > 0, new).otherwise(text)).drop(_SPANS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

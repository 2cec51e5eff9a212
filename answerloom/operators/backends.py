"""Models behind the operators: embedder, scorer and tagger, each with an offline default.

The defaults are deterministic and need no files: vectors of hashed character
and word n-grams, sentiment from a list of opinion words, parts of speech from
closed classes and endings. Any object with the same method can take a place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class Embedder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    """A scorer that is an expression: a struct of p_neg, p_neu and p_pos."""

    name: str

    def score(self, text: Column, aspect: Column | None = None) -> Column: ...


class BatchScorer(Protocol):
    """A model: rows of p_neg, p_neu and p_pos for texts, each about its aspect where one is given. It is sent to the workers and called for batches of texts of like length."""

    name: str

    def predict(self, texts: list[str], aspects: list[str] | None = None) -> np.ndarray: ...


#: Bytes of the word vectors that a worker remembers for an embedder.
WORD_BYTES = 32 << 20
_WORDS: dict[str, tuple[dict[str, int], np.ndarray]] = {}


class HashEmbedder:
    """Unit vectors from signed hashes of words and of their character n-grams.

    A word's hashes always add up to the same whole numbers, so a worker takes
    them once, as long as it remembers the word, and adds them up for each text.
    """

    def __init__(self, dims: int = 128, orders: tuple[int, ...] = (3, 4)):
        self.dims, self.orders, self.name = dims, orders, f"hash-{dims}-{'-'.join(map(str, orders))}"

    def _word(self, word: str) -> np.ndarray:
        p = f"<{word}>"
        features = [f"w:{word}", *(f"{n}:{p[i : i + n]}" for n in self.orders for i in range(len(p) - n + 1))]
        h = np.array([zlib.crc32(f.encode()) for f in features], np.int64)
        out = np.zeros(self.dims, np.int32)
        np.add.at(out, h % self.dims, np.where((h >> 20) & 1, 1, -1))
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        size = max(1024, WORD_BYTES // (4 * self.dims))
        if self.name not in _WORDS:
            _WORDS[self.name] = {}, np.zeros((size, self.dims), np.int32)
        known, table = _WORDS[self.name]
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            words = re.findall(r"\w+", text.lower())
            for k in range(0, len(words), size):
                part = words[k : k + size]
                new = set(part).difference(known)
                if len(known) + len(new) > size:
                    known.clear()
                    new = set(part)
                for w in new:
                    table[len(known)] = self._word(w)
                    known[w] = len(known)
                row += table[[known[w] for w in part]].sum(0)
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


#: Opinion words of the default scorer; any list can be given instead.
OPINION_WORDS = {
    **dict.fromkeys("good great nice love lovely like enjoy excellent amazing perfect pleasant fresh tasty best happy easy friendly fast clean helpful comfortable".split(), 1),
    **dict.fromkeys("bad poor awful terrible hate dislike unpleasant worst horrible slow dirty broken rude expensive boring stale bland annoying weak difficult".split(), -1),
}


#: Words on either side of an aspect's word in which the default scorer looks first.
REACH = 5


class LexiconScorer:
    """p_neg, p_neu and p_pos from counts of opinion words, negation turned round: the same formula for a text and for a clause about an aspect."""

    def __init__(self, words: dict[str, int] | None = None):
        self.words = OPINION_WORDS if words is None else words
        self.name = "lexicon-" + hashlib.sha1(repr(sorted(self.words.items())).encode()).hexdigest()[:8]

    def score(self, text: Column, aspect: Column | None = None) -> Column:
        """About an aspect, opinion words within ``REACH`` words of one of its words count, where there are any; else all do."""
        known = X.valence_map(self.words)
        each = F.transform(X.scan(text), lambda s: F.struct(s["word"].alias("word"), (X.word_valence(s["word"], known) * F.when(s["negated"], -1).otherwise(1)).alias("sign")))

        def heard(v: Column) -> Column:
            every = F.transform(v, lambda s: s["sign"])
            if aspect is None:
                return every
            names = F.regexp_extract_all(F.lower(aspect), F.lit("[a-z']{3,}"), 0)
            at = F.filter(F.transform(v, lambda s, i: F.when(F.array_contains(names, s["word"]), i)), lambda i: i.isNotNull())
            near = F.filter(F.transform(v, lambda s, i: F.when(F.exists(at, lambda a: F.abs(a - i) <= REACH), s["sign"])), lambda x: x.isNotNull())
            return F.when(F.exists(near, lambda x: x != 0), near).otherwise(every)

        signs = X.let(each, heard)

        def of(v: Column) -> Column:
            pos, neg = (F.size(F.filter(v, lambda x: x == sign)).cast("double") for sign in (1, -1))
            total = pos + neg + 0.5
            return F.struct((neg / total).alias("p_neg"), (F.lit(0.5) / total).alias("p_neu"), (pos / total).alias("p_pos"))

        return F.get(F.transform(F.array(signs), of), 0)


# Fixed values of the default tagger: closed classes and endings.
FUNCTION_WORDS = set(
    "a an the this that these those i you he she it we they me him her us them my your his its our their is are was were be been being am do does did have has had "
    "will would can could shall should may might must of in on at to for from with by about into over under and or but if so as than then too very not no nor".split()
)
ADJECTIVE_ENDINGS = ("y", "ous", "ful", "able", "ible", "ive", "ish", "less", "al", "ic")
NOUN_ENDINGS = ("tion", "sion", "ment", "ness", "ity", "ing", "age", "ance", "ence", "er", "or", "ship", "ure")


def tag(word: str) -> str:
    """NOUN, ADJ, FUNC or WORD by closed class and ending."""
    if word in FUNCTION_WORDS:
        return "FUNC"
    if word.endswith(NOUN_ENDINGS):
        return "NOUN"
    return "ADJ" if word.endswith(ADJECTIVE_ENDINGS) else "NOUN" if len(word) >= 3 else "WORD"


def embed(texts: DataFrame, embedder: Embedder, key: str = "key", text: str = "text") -> DataFrame:
    """(key, vec) of each distinct key; texts are encoded batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=[key, "vec"])

    unique = texts.select(key, text).groupBy(key).agg(F.min(text).alias(text))
    return unique.mapInArrow(run, f"{key} string, vec array<float>")


def vector_of(text: Column | str, embedder: Embedder) -> Column:
    """An embedder as an expression of each row: a plan that does not ask for the vector does not call the embedder."""

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(list(embedder.encode([t or "" for t in texts.to_pylist()])), pa.list_(pa.float32()))

    # the annotations of this module are strings, which the kind of a function is not read from
    encode.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(encode, "array<float>")(X.col(text))


#: Texts that a model gets at a time; those of a batch are sorted by length first, so that few are padded.
MODEL_BATCH = 64


def scored(df: DataFrame, scorer: Scorer | BatchScorer, text: str, aspect: str | None = None) -> DataFrame:
    """``df`` with p_neg, p_neu and p_pos, by an expression or by a model called in batches."""
    if not hasattr(scorer, "predict"):
        return df.withColumn("_p", scorer.score(F.col(text), F.col(aspect) if aspect else None)).select(*df.columns, "_p.*")
    from pyspark.sql import types as T

    names = ("p_neg", "p_neu", "p_pos")
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            about = [a or "" for a in batch.column(aspect).to_pylist()] if aspect else None
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            p = np.zeros((len(texts), 3))
            for k in range(0, len(order), MODEL_BATCH):
                at = order[k : k + MODEL_BATCH]
                p[at] = scorer.predict([texts[i] for i in at], [about[i] for i in at] if about else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in p.T)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def score_texts(texts: DataFrame, scorer: Scorer, key: str = "text_key", text: str = "text_clean") -> DataFrame:
    """key, p_neg, p_neu, p_pos, label and confidence of each distinct text."""
    unique = texts.select(key, text).groupBy(key).agg(F.min(text).alias(text))
    out = scored(unique, scorer, text).drop(text)
    best = F.greatest("p_neg", "p_neu", "p_pos")
    label = F.when(F.col("p_neg") == best, "negative").when(F.col("p_neu") == best, "neutral").otherwise("positive")
    return out.withColumn("label", label).withColumn("confidence", best)


def score_aspects(assigned: DataFrame, clauses: DataFrame, theme_names: dict[int, str], scorer: Scorer) -> DataFrame:
    """The assignment with clause, theme name and its three probabilities; each distinct (clause, theme) is scored once."""
    names = F.create_map(*[F.lit(x) for k, v in theme_names.items() for x in (k, v)])
    pairs = assigned.join(clauses.select("clause_id", "clause", "clause_key"), "clause_id") if "clause_key" not in assigned.columns else assigned
    pairs = pairs.withColumn("theme", names[F.col("theme_idx")])
    key = ["clause_key", "scope", "theme_idx"]
    once = pairs.groupBy(*key).agg(F.min("clause").alias("_c"), F.min("theme").alias("_t"))
    return pairs.join(scored(once, scorer, "_c", "_t").drop("_c", "_t"), key)


def stars_to_classes(stars: Column) -> Column:
    """1 and 2 stars are negative, 3 neutral, 4 and 5 positive."""
    return F.when(stars <= 2, "negative").when(stars == 3, "neutral").when(stars >= 4, "positive")


def entailment_to_classes(positive: Column, negative: Column) -> Column:
    """struct(p_neg, p_neu, p_pos) of two entailment probabilities; neutral is what the larger leaves."""
    return F.struct(negative.alias("p_neg"), (1 - F.greatest(positive, negative)).alias("p_neu"), positive.alias("p_pos"))

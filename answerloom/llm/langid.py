"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Features are the n-grams of one to three code points of the lower-cased text,
hashed into ``BUCKETS``. A feature's value is its relative frequency in the
text times its inverse document frequency, which counts every training
document. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties, which keeps them sparse, on at most ``SAMPLE`` distinct
labelled texts (of each language as many, or all it has); a fifth of these are kept back to
find the temperature by which the scores are calibrated.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import atomic_output, open_input, save_counts, sum_counts, work_dir

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that the classifier is fitted on, at most, and n-gram buckets of each (the most frequent, ties to the lower).
SAMPLE, SAMPLE_BUCKETS = 4000, 4096
#: Languages that are learned, at most: those of most rows, ties by name. Rows of others are not fitted on.
MOST_LANGUAGES = 256
#: A distinct text's rank, by which samples are picked, is a hash below this.
RANKS = 1 << 62
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.001
SCALE = 30.0
UNKNOWN = "und"
#: The pipeline keeps a document whose language is at least so sure. A clean text of one word may not be surer.
KEEP_SCORE = 0.35


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram, all orders, repeats included."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, key = [], np.zeros(len(c), np.uint64)
    for n in ORDERS:
        if len(c) < n:
            break
        key = (key[: len(c) - n + 1] << np.uint64(21)) | c[n - 1 :] if n > 1 else c
        out.append(((key + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (``UNKNOWN``, 0.0) for a null text or one without a letter."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        h = ngram_buckets(text)
        total, step = self.bias.copy(), max(1, 4_000_000 // len(self.languages))
        for k in range(0, len(h), step):
            total += self.weights[h[k : k + step]].sum(0, dtype=np.float64) * (SCALE / len(h))
        p = softmax(total / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal; one weight for each feature and class, and an unpenalised bias."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.zb, self.nb = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        z, n = self.z[at], self.n[at]
        w, b = self._weights(z, n, self.l1, self.l2), self._weights(self.zb, self.nb, 0.0, 0.0)
        error = softmax(x @ w + b)
        error[y] -= 1
        g = x[:, None] * error[None, :]
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.zb += error - (np.sqrt(self.nb + error * error) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += error * error

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n, self.l1, self.l2), self._weights(self.zb, self.nb, 0.0, 0.0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy on these documents (a search in its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int) -> Model:
    """samples: (language, buckets, relative frequencies), in a fixed order."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    code = {name: k for k, name in enumerate(languages)}
    back = samples[::5] if len(samples) >= 50 else []
    train = [s for k, s in enumerate(samples) if k % 5 or not back]
    model = Ftrl(BUCKETS, len(languages))

    def values(at: np.ndarray, f: np.ndarray) -> np.ndarray:
        return f * idf[at] * SCALE

    for _ in range(EPOCHS):
        for name, at, f in train:
            model.step(at, values(at, f), code[name])
    w, b = model.weights()
    logits = np.array([values(at, f) @ w[at] + b for _, at, f in back])
    return Model(languages, (w * idf[:, None]).astype(np.float32), b, best_temperature(logits, np.array([code[name] for name, *_ in back], int)))


def train(docs: DataFrame, folder: str, sample: int = SAMPLE) -> Model:
    """Fits on ``docs`` (text, lang); rows without a text or language are left out.

    Copies of a text with one language are one sample, whichever rows they stand
    in; which texts are samples is decided by a hash, so ties and order play no part.
    The driver holds the samples (``SAMPLE`` times ``SAMPLE_BUCKETS`` pairs of numbers
    at most) and three numbers for each bucket and language.
    """
    spark = docs.sparkSession
    docs = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("rank", F.pmod(F.xxhash64("text", "lang"), F.lit(RANKS)))
    found = docs.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(F.col("text") != "", F.col("rank"))).alias("texts")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return fit([], np.zeros(BUCKETS), 0)
    each = max(1, sample // len(found))
    # well over ``each`` texts of a language lie below the first bound, whatever the estimate's error; the second is exact
    first = {r.lang: min(RANKS, int((1.5 * each + 50) / max(1, r.texts) * RANKS)) for r in found}
    ranks: dict[str, list[int]] = {}
    for r in _below(docs, first).select("lang", "rank").distinct().collect():
        ranks.setdefault(r.lang, []).append(r["rank"])
    exact = {lang: sorted(own)[:each][-1] + 1 for lang, own in ranks.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text"):
                df[np.flatnonzero(np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS))] += 1
        if n:
            path = f"{folder}/df-{TaskContext.get().partitionId():07d}"
            save_counts(path, df)
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, rank, text in zip(batch.column("lang").to_pylist(), batch.column("rank").to_pylist(), batch.column("text")):
                h = ngram_buckets(text.as_py())
                n = np.bincount(h, minlength=BUCKETS)
                at = np.flatnonzero(n)
                if len(at) > SAMPLE_BUCKETS:
                    at = np.sort(at[np.argsort(-n[at], kind="stable")[:SAMPLE_BUCKETS]])
                rows.append((lang, rank, at.astype("<i4").tobytes(), (n[at] / len(h)).astype("<f4").tobytes()))
            if rows:
                yield _sample_batch(rows)

    counted = docs.select("text").mapInArrow(count, "path string, n long").collect()
    df = sum_counts(spark, sorted(r.path for r in counted), folder)
    # copies of a text are one sample
    samples = _below(docs, exact).select("lang", "rank", "text").distinct().mapInArrow(frequencies, "lang string, rank long, at binary, f binary").collect() if exact else []
    rows = [(r.lang, np.frombuffer(bytes(r.at), "<i4"), np.frombuffer(bytes(r.f), "<f4")) for r in sorted(samples, key=lambda r: (r["rank"], r.lang))]
    return fit(rows, df, sum(r.n for r in counted))


def _below(docs: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """The rows with a text whose rank is below their language's bound."""
    bound = F.create_map(*[F.lit(x).cast(t) for lang, b in sorted(bounds.items()) for x, t in ((lang, "string"), (b, "long"))])
    return docs.where((F.col("text") != "") & (F.col("rank") < bound[F.col("lang")]))


def _sample_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "rank": pa.int64(), "at": pa.binary(), "f": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def save_model(model: Model, path: str) -> None:
    data = io.BytesIO()
    np.savez(data, languages=np.array(model.languages, dtype=str), weights=model.weights, bias=model.bias, temperature=model.temperature)
    with atomic_output(path) as f:
        f.write(data.getvalue())


_MODELS: dict[str, Model] = {}


def load_model(path: str) -> Model:
    if path not in _MODELS:
        with open_input(path) as f:
            z = np.load(io.BytesIO(f.read()))
        _MODELS.clear()
        _MODELS[path] = Model([str(x) for x in z["languages"]], z["weights"], z["bias"], float(z["temperature"]))
    return _MODELS[path]


def trained_model(docs: DataFrame) -> str:
    """Path of a model fitted on the documents that are not held out."""
    folder = work_dir(docs.sparkSession, "langid")
    save_model(train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), folder), f"{folder}/model.npz")
    return f"{folder}/model.npz"


def predict(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document (doc_id, text); only the text enters a prediction.

    Equal texts have equal predictions; a tie goes to the language first by name. A
    null text, one without a letter, and any text where no language was learned gives
    ``UNKNOWN`` and 0. A null id is not held out. Other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score = zip(*(load_model(model).predict(t.as_py()) for t in batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: str, least: float = KEEP_SCORE) -> DataFrame:
    """The documents, all columns, whose language is recognised with at least this score."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [load_model(model).predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

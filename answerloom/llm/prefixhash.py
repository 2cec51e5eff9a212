"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two 31-bit primes, the running sums of
``code * base ** position``. Two spans are equal (up to a chance of about
2 ** -60) if their sums agree once they are moved to the same power, so any
span is compared in constant time and the longest common extension of two
positions is found by binary search.

A document's fingerprint draws on the hashes of all its spans of ``SPAN`` code
points (a shorter text is one span): each of ``SLOTS`` slots keeps the smallest
hash that falls in it, of which 16 bits are written as 4 hex digits (0000 for
an empty slot). Likeness is the share of slots that agree among those used by
either fingerprint; it estimates the Jaccard index of the span sets, and is 1
for two empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import work_dir

SPAN, SLOTS = 24, 128
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(k: int, n: int) -> np.ndarray:
    """The first ``n`` powers of base ``k`` modulo prime ``k``."""
    p, have = np.uint64(PRIMES[k]), _POWERS[k]
    while len(have) < n:
        step = np.uint64(pow(BASES[k], len(have), PRIMES[k]))
        have = np.concatenate([have, have * step % p])
    _POWERS[k] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHash:
    """Modular prefix arrays over the code points of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for k in (0, 1):
            p = np.uint64(PRIMES[k])
            terms = (codes + np.uint64(1)) * powers(k, self.n) % p
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % p]))

    def span(self, start: int, length: int, power: int) -> tuple[int, int]:
        """The two hashes of a span, moved to begin at ``power``."""
        out = []
        for k in (0, 1):
            d = (int(self.sums[k][start + length]) - int(self.sums[k][start])) % PRIMES[k]
            out.append(d * pow(BASES[k], power - start, PRIMES[k]) % PRIMES[k])
        return out[0], out[1]

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        power = max(start, other_start)
        return self.span(start, length, power) == other.span(other_start, length, power)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """How many code points agree from the two positions on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int = SPAN) -> np.ndarray:
        """A 64-bit hash of every span of this length (of the whole text, where it is shorter), whatever its place."""
        length = min(length, self.n)
        if not length:
            return np.zeros(0, np.uint64)
        count, moved = self.n - length + 1, []
        for k in (0, 1):
            p, s = np.uint64(PRIMES[k]), self.sums[k]
            inverse = pow(BASES[k], -1, PRIMES[k])
            # multiplying by base ** -start; the powers of the inverse are those of the base read backwards from the end
            last = np.uint64(pow(inverse, count - 1, PRIMES[k]))
            back = powers(k, count)[::-1] * last % p
            moved.append((s[length:] + p - s[: self.n - length + 1]) % p * back % p)
        return mixed(moved[0] << np.uint64(31) | moved[1])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slot_minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each slot; the largest value stands for an empty slot."""
    out = np.full(SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    # most hashes cannot be the least of their slot: look at the small ones first
    few = hashes[(hashes >> np.uint64(7)) < np.uint64((1 << 57) // max(1, len(hashes) // (SLOTS * 12)))] if len(hashes) > SLOTS * 24 else hashes
    np.minimum.at(out, (few & np.uint64(SLOTS - 1)).astype(np.int64), few)
    if len(few) < len(hashes) and (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any():
        np.minimum.at(out, (hashes & np.uint64(SLOTS - 1)).astype(np.int64), hashes)
    return out


def digits(minima: np.ndarray) -> np.ndarray:
    """16 bits a slot, 0 only for an empty one."""
    short = (mixed(minima) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    short[minima == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
    return short


def as_text(short: np.ndarray) -> str:
    return short.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum() / used) if used else 1.0


class _Doc:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.codes = code_points(self.text)
        self.n = len(self.codes)
        self.prefix = PrefixHash(self.codes)
        self.hashes = self.prefix.spans()
        self.digits = digits(slot_minima(self.hashes))


def _row(doc: _Doc, following: _Doc) -> tuple:
    """The result of a document whose next one is known."""
    half = doc.n // 2
    taken = min(half, following.n)
    kept = doc.n - half
    text = doc.text[:kept] + following.text[:taken]
    n = kept + taken
    if n <= SPAN:
        hashes = PrefixHash(code_points(text)).spans()
    else:  # spans within either part are known; those across the seam are new
        seam = np.concatenate([doc.codes[max(0, kept - SPAN + 1) : kept], following.codes[: min(taken, SPAN - 1)]])
        parts = [doc.hashes[: max(0, kept - SPAN + 1)] if doc.n >= SPAN else doc.hashes[:0], following.hashes[: max(0, taken - SPAN + 1)] if following.n >= SPAN else following.hashes[:0]]
        if len(seam) >= SPAN:
            parts.append(PrefixHash(seam).spans())
        hashes = np.concatenate(parts)
    edited = digits(slot_minima(hashes))
    common = doc.prefix.common_extension(0, following.prefix, 0)
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc.doc_id, doc.n, sha, as_text(doc.digits), as_text(edited), likeness(doc.digits, edited), likeness(doc.digits, following.digits), common


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"
_HELD = RESULT + ", part long, head string, tail string, tail_id long, is_edge boolean"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_KIND = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KIND[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose second half comes from the next document.

    The next document is the one that follows by descending doc_id (nulls last, equal ids by a hash
    of the text), after the last one the first; a lone document follows itself. A null text is empty; the
    empty text's fingerprint has only empty slots. ``common_start`` counts the code points with which the
    document and the next one both begin. Rows are sorted in ranges; the rows on the edges of
    the ranges are joined with their neighbours afterwards.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "prefixhash")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").asc()]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    held = _arrow(_HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, head, rows = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc = _Doc(doc_id, text.as_py())
                if last is None:
                    head = doc.text
                else:
                    rows.append(_row(last, doc) + (part, None, None, None, False))
                last = doc
                if len(rows) == 1000:
                    yield _batch(rows, held)
                    rows = []
        if last is not None:
            rows.append((None,) * 8 + (part, head, last.text, last.doc_id, True))
            yield _batch(rows, held)

    # fingerprints are hexadecimal digits, which halve under zstd
    docs.mapInArrow(run, _HELD).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.schema(_HELD).parquet(f"{folder}/rows")
    edges = rows.where("is_edge").select("part", "head", "tail", "tail_id")
    # numbers of ranges, one each: which range follows which
    parts = sorted(r.part for r in edges.select("part").collect())
    follow = dict(zip(parts, parts[1:] + parts[:1]))
    done = rows.where("not is_edge").select(*_arrow(RESULT).names)
    if not parts:
        return done
    mapping = spark.createDataFrame(sorted(follow.items()), "part long, next_part long")
    heads = edges.select(F.col("part").alias("next_part"), F.col("head").alias("next_text"))
    pending = edges.join(mapping, "part").join(heads, "next_part").select("tail_id", "tail", "next_text")

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                yield _batch([_row(_Doc(i, a), _Doc(None, b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))], _arrow(RESULT))

    return done.unionByName(pending.mapInArrow(finish, RESULT))

"""Packing documents into training sequences by lexical retrieval.

Documents become token ids plus an end id. Whole windows of a long document
are sequences of their own; what remains of each document goes into shards of
bounded size. Shards are cut from an order by content over the whole corpus: a
document's place is the first of its terms in three fixed random orders of the
vocabulary, in which a term comes early the likelier the rarer it is (weighted
min-hashing). Documents meet with the likelihood that their sets of terms
overlap, wherever they are stored; copies are always neighbours.

A shard holds a BM25 inverted index over its documents; statistics are those
of whole documents and of the whole corpus, and no term is left out. A window
starts with a seed document, all its terms query the index, and the unused
neighbours fill the window best first; the last one is cut, and what is left of
it seeds the next window. The last window of a shard is cut into sequences
whose lengths are powers of two, so that nothing is padded.

Edge cases: a null text counts as empty and gives one piece with the end id; a
null doc_id stays null; repeated rows are packed as often as they occur; ties
in score go to the earlier document of the shard; no documents give no pieces;
other columns of ``docs`` do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import over_files, work_dir
from .spool import read_spool, spool_tokens
from .tokens import forget_encoders

WINDOW = 2048
#: Tokens and documents of a shard at most (a shard closes at the first document beyond either).
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 4_000
#: Tokens, of all documents, for each task that packs.
TASK_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's documents are held as rows of numbers, the others as lists.
DENSE_SHARE = 1 / 16
#: Orders of the vocabulary that place a document, and bits of a term's place in one.
ORDERS, PLACE_BITS = 3, 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
COLUMNS = SCHEMA.replace(" long", "").split(", ")
_KEYED = "place long, tie long, doc_id long, n long, whole_crcs binary, ids binary, terms binary"


class Bm25Shard:
    """Inverted index over token ids of the documents of one shard.

    ids: the ids of each document; whole: for those that are longer than that, all
    their (terms, counts) by number.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float, whole: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.size, whole = len(ids), whole or {}
        kind = np.uint32 if len(idf) * len(ids) < 1 << 32 else np.uint64
        short = [np.zeros(0, ids[0].dtype) if k in whole else x for k, x in enumerate(ids)]
        flat, n = np.concatenate(short).astype(kind), np.array([len(x) for x in short])
        flat *= kind(len(ids))
        flat += np.repeat(np.arange(len(ids), dtype=kind), n)
        pairs, tf = np.unique(flat, return_counts=True)
        for k, (terms, counts) in whole.items():
            n[k] = counts.sum()
        if whole:
            pairs = np.concatenate([pairs, *(terms.astype(kind) * kind(len(ids)) + kind(k) for k, (terms, _) in whole.items())])
            tf = np.concatenate([tf, *(counts for _, counts in whole.values())])
            order = np.argsort(pairs, kind="stable")
            pairs, tf = pairs[order], tf[order]
        term, self.doc = (x.astype(np.int64) for x in np.divmod(pairs, kind(len(ids))))
        norm = K1 * (1 - B + B * n / mean_length)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        by_doc = np.argsort(self.doc.astype(np.uint16 if len(ids) <= 1 << 16 else np.int64), kind="stable")
        self.terms_of = np.split(term[by_doc], np.cumsum(np.bincount(self.doc, minlength=len(ids)))[:-1])
        often = np.flatnonzero(np.diff(self.first) > DENSE_SHARE * len(ids))
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(ids)), np.float32)
        at = np.flatnonzero(self.row[term] >= 0)
        self.dense[self.row[term[at]], self.doc[at]] = self.weight[at]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for all terms of this one."""
        terms = self.terms_of[doc]
        row = self.row[terms]
        out = self.dense[row[row >= 0]].sum(0) if len(self.dense) else np.zeros(self.size, np.float32)
        rare = terms[row < 0]
        first, n = self.first[rare], self.first[rare + 1] - self.first[rare]
        ends = np.cumsum(n)
        if len(ends):
            at = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
            out += np.bincount(self.doc[at], self.weight[at], self.size).astype(np.float32)
        return out


def fill_windows(index: Bm25Shard, n: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first id, number of ids); every id once; only the last may be short."""
    unused, next_seed, size = np.ones(len(n), bool), 0, len(n)
    tail: tuple[int, int] | None = None
    while True:
        if tail is None:
            while next_seed < size and not unused[next_seed]:
                next_seed += 1
            if next_seed == size:
                return
            tail, unused[next_seed] = (next_seed, 0), False
        seed, room, pieces, score = tail[0], window, [], None
        while tail:
            doc, at = tail
            take = min(room, n[doc] - at)
            pieces.append((doc, at, take))
            room -= take
            tail = (doc, at + take) if at + take < n[doc] else None
            if not room:
                break
            if tail is None:
                if score is None:
                    score = np.where(unused, index.scores(seed), np.float32(-1))
                best = int(score.argmax())
                if score[best] < 0:
                    break
                unused[best], score[best] = False, -1.0
                tail = (best, 0)
        yield pieces


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts a short window into sequences with lengths that are powers of two, longest first."""
    left, total = list(pieces), sum(p[2] for p in pieces)
    while total:
        room, own = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            doc, at, length = left.pop(0)
            take = min(room, length)
            own.append((doc, at, take))
            room -= take
            if take < length:
                left.insert(0, (doc, at + take, length - take))
        yield own


class _Pieces:
    def __init__(self, part: int):
        self.rows: list[tuple] = []
        self.sequence = part << 32

    def add(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, number of ids, their crc32, ids of the document)."""
        at, whole = 0, sum(p[2] for p in pieces)
        for doc_id, start, length, crc, n in pieces:
            self.rows.append((doc_id, start, length, crc, n, self.sequence, at, whole))
            at += length
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns, self.rows = zip(*self.rows), []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COLUMNS)


def vocabulary_orders(df: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """ORDERS x terms: the place of each term. Terms of one document only come last, as they join nothing."""
    rng = np.random.default_rng(20240101)
    places = np.empty((ORDERS, len(df)), np.uint32)
    for k in range(ORDERS):
        late = rng.exponential(size=len(df)) / np.where(df > 1, np.maximum(idf, 1e-9) ** 2, 1e-12)
        places[k, np.argsort(late, kind="stable")] = np.arange(len(df))
    return places


def _binary(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


def keyed_documents(path: str, part: int, dtype: str, places: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """A row for each document of a spool file: its place by content, checksums of its whole windows, the ids after them, and all terms of a document with both."""
    row = part << 40
    for doc_ids, flat, n in read_spool(path, dtype):
        ends = np.cumsum(n)
        place = np.zeros(len(n), np.int64)
        for order in places:
            place = place << PLACE_BITS | np.minimum.reduceat(order[flat], ends - n).astype(np.int64)
        small, rows = flat.astype(dtype), []
        for end, m in zip(ends.tolist(), n.tolist()):
            ids = flat[end - m : end]
            whole = m // window * window
            crcs = np.array([zlib.crc32(ids[k : k + window]) for k in range(0, whole, window)], "<u4").tobytes() if whole else None
            terms = None
            if whole and m > whole:
                counts = np.bincount(ids)
                own = np.flatnonzero(counts)
                terms = np.stack([own, counts[own]]).astype("<u4").tobytes()
            rows.append((crcs, small[end - m + whole : end].tobytes(), terms, zlib.crc32(ids)))
        crcs, rest, terms, whole_crc = zip(*rows)
        # copies under one key are spread by document; rows without an id by where they stand
        doc = doc_ids.fill_null(0).to_numpy().astype(np.uint64)
        doc = np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), (row + np.arange(len(n))).astype(np.uint64) ^ np.uint64(1 << 63), doc)
        tie = (doc * np.uint64(0x9E3779B97F4A7C15)) ^ (np.array(whole_crc, np.uint64) << np.uint64(16))
        row += len(n)
        columns = [pa.array(place), pa.array((tie * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)), doc_ids, pa.array(n, pa.int64()), _binary(crcs), _binary(rest), _binary(terms)]
        yield pa.RecordBatch.from_arrays(columns, names=_KEYED.replace(" long", "").replace(" binary", "").split(", "))


def pack_part(batches: Iterator[pa.RecordBatch], part: int, dtype: str, idf: np.ndarray, mean_length: float, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    out, shard, held = _Pieces(part), [], 0

    def close():
        ids = [s[2] for s in shard]
        whole = {k: s[4] for k, s in enumerate(shard) if s[4] is not None}
        for pieces in fill_windows(Bm25Shard(ids, idf, mean_length, whole), [len(x) for x in ids], window):
            short = sum(p[2] for p in pieces) < window
            for own in powers_of_two(pieces) if short else [pieces]:
                out.add([(shard[d][0], shard[d][1] + at, m, zlib.crc32(ids[d][at : at + m]), shard[d][3]) for d, at, m in own])

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("doc_id", "n", "whole_crcs", "ids", "terms"))
        for doc_id, m, crcs, rest, terms in zip(*columns):
            crcs = np.frombuffer(crcs or b"", "<u4").tolist()
            for k, crc in enumerate(crcs):
                out.add([(doc_id, k * window, window, crc, m)])
            if rest:
                ids = np.frombuffer(rest, dtype).astype("<u4")
                shard.append((doc_id, len(crcs) * window, ids, m, np.frombuffer(terms, "<u4").reshape(2, -1) if terms else None))
                held += len(ids)
            if held >= SHARD_TOKENS or len(shard) >= SHARD_DOCS:
                close()
                shard, held = [], 0
            if len(out.rows) >= 20_000:
                yield out.batch()
    if shard:
        close()
    if out.rows:
        yield out.batch()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): which ids of which document stand where in which sequence."""
    spark = docs.sparkSession
    folder = work_dir(spark, "packing")
    spool = spool_tokens(docs, folder, tokenizer, end_id, "docs", ordered=False)
    n_docs, n_tokens, dtype = sum(p.docs for p in spool.parts), sum(p.tokens for p in spool.parts), spool.dtype
    df = spool.stat.astype(float)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    places, mean_length = vocabulary_orders(df, idf), n_tokens / max(1, n_docs)

    def key(entry):
        part, path = entry
        yield from keyed_documents(path, part, dtype, places, window)

    def pack(batches):
        forget_encoders()
        yield from pack_part(batches, TaskContext.get().partitionId(), dtype, idf, mean_length, window)

    keyed = over_files(spark, [(p.number, p.path) for p in spool.parts], key, _KEYED)
    return keyed.repartitionByRange(1 + n_tokens // TASK_TOKENS, "place", "tie").sortWithinPartitions("place", "tie").mapInArrow(pack, SCHEMA)

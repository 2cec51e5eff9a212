"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text's segmentations into pieces are the paths of a lattice over its UTF-8
bytes. A path's probability is proportional to the product of its pieces'
probabilities, each to the power ``theta``. Forward filtering sums the weights
of all paths to every byte; backward sampling draws the last piece, then the one
before, and so on, which gives a path from exactly that distribution. Random
numbers are a hash of the row key and the place in the text, so a row gives
the same pieces wherever and however often it is computed.

Where no piece of the vocabulary spans the start of a run of spaces the lattice
falls apart into segments there. Each distinct segment of a batch is filtered
once, and all segments are sampled in step (a text without spaces is one
segment; it takes one step for each byte). Characters without a piece of their
own go by byte pieces. Pieces concatenate to the exact text: a space is the
piece mark, no prefix is added, and a literal mark in a text goes by bytes.

Unigram models bring log-probabilities. Models of merges only rank their
pieces; a piece of rank r then counts as 1 / (r + 10).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import mix, prefix_sums, span_sums
from .tokens import groups

THETA = 1.0
SEED = 20240101
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def span_keys(b: np.ndarray, sums: np.ndarray | None, first: np.ndarray, length: int) -> np.ndarray:
    """A key for each span of one length: up to eight bytes these bytes themselves, mixed one to one; beyond, a hash.

    ``b`` has eight more bytes after the last span.
    """
    if length > 8:
        return mix(span_sums(sums, first, first + length))
    words = np.ndarray(len(b) - 7, "<u8", b, 0, (1,))[first].astype(np.uint64)
    return mix(words & np.uint64((1 << 8 * length) - 1))


class PieceSampler:
    """Samples and decodes with one SentencePiece model."""

    def __init__(self, model_file: str, theta: float = THETA, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        score = np.array([sp.get_score(k) for k in range(n)])
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        normal = []
        for k in range(n):
            if sp.is_byte(k):
                value = int(sp.id_to_piece(k)[3:5], 16)
                self.byte_id[value], self.text[k] = k, bytes([value])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.text[k] = sp.id_to_piece(k).replace("▁", " ").encode()
                normal.append(k)
        if (self.byte_id < 0).any():
            raise ValueError("the model needs a piece for every byte")
        normal = np.array(normal)
        own = score[normal]
        if np.array_equal(own, np.round(own)) and own.min() < -1000:
            own = -np.log(np.argsort(np.argsort(-own, kind="stable"), kind="stable") + 10.0)
        self.log_p = np.full(n, own.min() - np.log(256.0))
        self.log_p[normal] = own
        self.log_p *= theta
        size = np.array([len(t) for t in self.text])
        self.size, self.flat = size, np.frombuffer(b"".join(self.text), np.uint8)
        self.at = np.cumsum(size) - size
        self.seed = np.uint64(seed)
        #: For each length in bytes: sorted hashes of pieces, and their ids.
        self.tables = []
        self.maybe = np.zeros(1 << 20, bool)
        for length in sorted(set(size[normal].tolist()) - {0}):
            ids = normal[size[normal] == length]
            data = np.concatenate([self.flat[self.at[k] : self.at[k] + length] for k in ids])
            h = span_keys(np.concatenate([data, np.zeros(8, np.uint8)]), prefix_sums(data), np.arange(len(ids)) * length, length)
            order = np.argsort(h)
            self.tables.append((length, h[order], ids[order]))
            self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.text)

    def _segments(self, b: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Starts of the segments; docs: starts of the texts that are not empty."""
        first = np.zeros(len(b), bool)
        first[docs] = True
        if self.cuts:
            space = b == 32
            first[1:] |= space[1:] & ~space[:-1]
        return np.flatnonzero(first)

    def _edges(self, b: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the segments; room: bytes left in the segment at each place."""
        sums, padded = prefix_sums(b), np.concatenate([b, np.zeros(8, np.uint8)])
        starts, lengths, pieces = [], [], []
        for length, table, ids in self.tables:
            at = np.flatnonzero(room >= length)
            if not len(at):
                break
            h = span_keys(padded, sums, at, length)
            keep = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[keep], h[keep]
            k = np.minimum(np.searchsorted(table, h), len(table) - 1)
            keep = table[k] == h
            at, own = at[keep], ids[k[keep]]
            if length > 8:  # a hash is not the bytes
                same = np.ones(len(at), bool)
                for place in range(length):
                    same &= b[at + place] == self.flat[self.at[own] + place]
                at, own = at[same], own[same]
            starts.append(at)
            lengths.append(np.full(len(at), length))
            pieces.append(own)
        wide = np.ones(len(b), np.int64)
        for least, n in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            wide[b >= least] = n
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        covered = np.zeros(len(b) + 4, bool)
        has = np.zeros(len(b), bool)
        for s, n in zip(starts, lengths):
            if len(s) and n[0] <= 4:
                has[s[wide[s] == n[0]]] = True
        for k in range(4):
            ok = lead[has[lead] & (wide[lead] > k)]
            covered[ok + k] = True
        bare = np.flatnonzero(~covered[: len(b)])
        starts.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        pieces.append(self.byte_id[b[bare]])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)

    def sample(self, texts: list[bytes], keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces one after another, and how many each text has."""
        size = np.array([len(t) for t in texts], np.int64)
        b = np.frombuffer(b"".join(texts), np.uint8)
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        doc_at = np.cumsum(size) - size
        seg = self._segments(b, doc_at[size > 0])
        n = np.diff(np.concatenate([seg, [len(b)]]))
        # distinct segments, by their bytes
        edges = pa.py_buffer(np.append(seg, len(b)).astype(np.int64))
        known = pa.Array.from_buffers(pa.large_binary(), len(seg), [None, edges, pa.py_buffer(b)]).dictionary_encode()
        which, distinct = known.indices.to_numpy(), known.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        d = np.frombuffer(distinct.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        d_size, d_at = np.diff(ends), ends[:-1] - ends[0]
        inside = np.arange(len(d)) - np.repeat(d_at, d_size)
        first, last, weight, piece, origin = self._filter(d, inside, np.repeat(d_size, d_size) - inside)
        # backward sampling; the node after byte x of the distinct segments has number x
        out = np.full(len(b), -1, np.int64)
        doc = np.searchsorted(doc_at, seg, "right") - 1
        seed = mix(self.seed + mix(np.array([0xABCDEF if k is None else k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)))
        node, base = d_at[which] + n - 1, seg - d_at[which]
        who = np.arange(len(seg))
        in_doc = (base - doc_at[doc]).astype(np.int64)
        key = seed[doc]
        while len(who):
            u = (mix(key + (in_doc + node).astype(np.uint64) * _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = first[node].copy()
            todo = np.flatnonzero((weight[e] <= u) & (e < last[node]))
            while len(todo):
                e[todo] += 1
                todo = todo[(weight[e[todo]] <= u[todo]) & (e[todo] < last[node[todo]])]
            begin = origin[e]
            out[base + begin] = piece[e]
            alive = begin > node_floor(begin, inside)
            who, base, in_doc, key = who[alive], base[alive], in_doc[alive], key[alive]
            node = begin[alive] - 1
        taken = np.concatenate([[0], np.cumsum(out >= 0)])
        return out[out >= 0], taken[doc_at + size] - taken[doc_at]

    def _filter(self, d: np.ndarray, inside: np.ndarray, room: np.ndarray):
        """For the node after each byte: its first and last edge; for edges: running share of the weight, piece, start."""
        start, length, piece = self._edges(d, room)
        end = start + length - 1
        # longer pieces are likelier and come first, so that few edges are looked at
        order = np.lexsort((-length, end, inside[end]))
        start, end, piece = start[order], end[order], piece[order]
        step = inside[end]
        score = self.log_p[piece]
        alpha = np.zeros(len(d))
        share = np.empty(len(start))
        edges = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        for a, z in zip(edges.tolist(), np.concatenate([edges[1:], [len(step)]]).tolist()):
            s, e = start[a:z], end[a:z]
            w = score[a:z] + np.where(inside[s] > 0, alpha[s - 1], 0.0)
            head = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            count = np.diff(np.concatenate([head, [z - a]]))
            top = np.maximum.reduceat(w, head)
            x = np.exp(w - np.repeat(top, count))
            total = np.add.reduceat(x, head)
            alpha[e[head]] = top + np.log(total)
            x /= np.repeat(total, count)
            run = np.cumsum(x)
            share[a:z] = run - np.repeat(run[head] - x[head], count)
        first, last = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        head = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        first[end[head]] = head
        last[end[head]] = np.concatenate([head[1:], [len(end)]]) - 1
        return first, last, share, piece, start

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of these pieces."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


def node_floor(begin: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The start of the segment that each place belongs to."""
    return begin - inside[begin]


_SAMPLERS: dict[tuple, PieceSampler] = {}


def sampler(model_file: str, theta: float, seed: int) -> PieceSampler:
    key = (model_file, theta, seed)
    if key not in _SAMPLERS:
        _SAMPLERS[key] = PieceSampler(*key)
    return _SAMPLERS[key]


def sampled_pieces(docs: DataFrame, model_file: str, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, pieces): a sampled segmentation of each text, by piece ids. A null text has none; equal rows have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model_file, theta, seed)
        for ids, texts in _portions(batches):
            pieces, n = s.sample(texts, ids)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(pieces, pa.int32()))], names=["doc_id", "pieces"])

    return _narrow(docs).mapInArrow(run, "doc_id long, pieces array<int>")


def segmentation_digests(docs: DataFrame, model_file: str, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32, n_bytes, decoded_sha256 and lossless of a sampled segmentation of each whole text.

    Ids count as little-endian unsigned 32-bit integers. Null and empty texts have no pieces and decode to nothing.
    """
    names = ["doc_id", "n_pieces", "pieces_crc32", "n_bytes", "decoded_sha256", "lossless"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model_file, theta, seed)
        for ids, texts in _portions(batches):
            pieces, n = s.sample(texts, ids)
            rows, at = [], 0
            for doc_id, text, m in zip(ids, texts, n.tolist()):
                own, at = pieces[at : at + m], at + m
                back = s.decode(own)
                rows.append((doc_id, m, zlib.crc32(own.astype("<u4").tobytes()), len(text), hashlib.sha256(back).hexdigest(), back == text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _narrow(docs).mapInArrow(run, "doc_id long, n_pieces long, pieces_crc32 long, n_bytes long, decoded_sha256 string, lossless boolean")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for a, b in groups(batch.column(1), 3_000_000):
            part = batch.slice(a, b - a)
            yield part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()

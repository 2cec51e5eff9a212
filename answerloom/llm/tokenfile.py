"""Token ids in binary files: canonical length-limited Huffman codes.

Layout of a dataset: ``codebook`` has the code length of every id (from the
counts of all documents); files ``part-N`` of bounded size have, in ascending doc_id order, a bit
stream of all ids, the bit offset of every block of ``BLOCK`` ids, and for
each document its id and its number of ids. All sections carry a CRC-32.
Blocks decode independently; the decoder takes one step in thousands of blocks
at once, looking each code up in a table of ``2 ** limit`` entries.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import atomic_output, delete, exists, open_input, over_files, work_dir
from .spool import read_spool, spool_tokens

BLOCK = 1024
LIMIT = 18
MAGIC = b"ALHF0001"
_WIDE = 4096
#: Chunks of text that a worker's encoder remembers: more than elsewhere, as this operator is the closest to its limit of time.
KEEP = 800_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that do not occur.

    A lone id gets one bit. The limit is raised where so many ids need more bits.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < len(leaves))
    take, n = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        n[:own] += 1
        take = 2 * (take - own)
    lengths[order] = n
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths.max())
        steps = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        left = np.cumsum(steps) - steps
        codes[order] = left >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For the next ``top`` bits: id * 32 + code length."""
    top = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    entry = order.astype(np.uint64) * np.uint64(32) + lengths[order].astype(np.uint64)
    table = np.repeat(entry, (1 << (top - lengths[order].astype(np.int64))))
    return np.concatenate([table, np.full((1 << top) - len(table), 1, np.uint64)]), top


class BitWriter:
    """Appends codes; keeps the bit offset where every block starts."""

    def __init__(self, lengths: np.ndarray, block: int = BLOCK):
        self.length, self.code, self.block = lengths.astype(np.int64), canonical_codes(lengths), block
        self.bits = self.tokens = 0
        self.tail = 0
        self.words: list[np.ndarray] = []
        self.checkpoints: list[np.ndarray] = []

    def append(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), 1 << 18):
            self._append(ids[k : k + (1 << 18)])

    def _append(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        length = self.length[ids]
        ends = np.cumsum(length)
        at = ends - length
        first = -self.tokens % self.block
        self.checkpoints.append((at[first :: self.block] + self.bits).astype("<u8"))
        base = self.bits & 31
        at += base
        shifted = self.code[ids] << (64 - length - (at & 31)).astype(np.uint64)
        word, n = at >> 5, int((ends[-1] + base + 31) >> 5)
        total = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n + 1) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[: n + 1]
        out = total[:n].astype(np.uint32)
        out[0] |= np.uint32(self.tail)
        self.bits += int(ends[-1])
        self.tokens += len(ids)
        self.tail = int(out[-1]) if self.bits & 31 else 0
        self.words.append(out[: n - bool(self.bits & 31)].astype(">u4"))

    def finish(self) -> tuple[bytes, np.ndarray]:
        last = [np.array([self.tail], ">u4")] if self.bits & 31 else []
        return b"".join(w.tobytes() for w in self.words + last), np.concatenate(self.checkpoints) if self.checkpoints else np.zeros(0, "<u8")


def decode_blocks(stream: bytes, starts: np.ndarray, lengths_table: tuple[np.ndarray, int], n_tokens: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The ids of consecutive blocks that start at these bits, ``_WIDE`` blocks at a time."""
    table, top = lengths_table
    words = np.concatenate([np.frombuffer(stream, ">u4").astype(np.uint64), np.zeros(block * 32 // 32 + 4, np.uint64)])
    both = (words[:-1] << np.uint64(32)) | words[1:]
    mask, room = np.uint64((1 << top) - 1), np.int64(64 - top)
    for k in range(0, len(starts), _WIDE):
        pos = starts[k : k + _WIDE].astype(np.int64)
        left = min(n_tokens - k * block, len(pos) * block)
        steps = min(block, left)
        out = np.empty((steps, len(pos)), np.uint32)
        for t in range(steps):
            entry = table[(both[pos >> 5] >> (room - (pos & 31)).astype(np.uint64)) & mask]
            out[t] = entry >> np.uint64(5)
            pos += (entry & np.uint64(31)).astype(np.int64)
        expected = starts[k + 1 : k + 1 + len(pos)].astype(np.int64)
        if (pos[: len(expected)] != expected).any():
            raise ValueError("a block does not end where the next one starts")
        yield out.T.ravel()[:left]


def _section(f, data: bytes) -> None:
    f.write(struct.pack("<QI", len(data), zlib.crc32(data)))
    f.write(data)


def _read_section(f) -> bytes:
    n, crc = struct.unpack("<QI", f.read(12))
    data = f.read(n)
    if len(data) != n or zlib.crc32(data) != crc:
        raise ValueError("a section does not match its checksum")
    return data


def write_part(path: str, lengths: np.ndarray, batches: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> None:
    writer, ids, counts = BitWriter(lengths), [], []
    for doc_ids, tokens, n in batches:
        writer.append(tokens)
        ids.append(doc_ids)
        counts.append(n)
    stream, checkpoints = writer.finish()
    doc_ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
    with atomic_output(path) as f:
        f.write(MAGIC + struct.pack("<QI", writer.tokens, BLOCK))
        _section(f, checkpoints.tobytes())
        _section(f, doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes())
        _section(f, np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False)).tobytes())
        _section(f, (np.concatenate(counts) if counts else np.zeros(0)).astype("<i8").tobytes())
        _section(f, stream)


def read_part(path: str, table: tuple[np.ndarray, int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, in its order."""
    with open_input(path) as f:
        head = f.read(20)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n_tokens, block = struct.unpack("<QI", head[8:])
        checkpoints = np.frombuffer(_read_section(f), "<u8")
        doc_ids = np.frombuffer(_read_section(f), "<i8")
        null = np.unpackbits(np.frombuffer(_read_section(f), np.uint8))[: len(doc_ids)].astype(bool)
        counts = np.frombuffer(_read_section(f), "<i8")
        stream = _read_section(f)
    runs, have, size = decode_blocks(stream, checkpoints, table, n_tokens, block), [], 0
    rest = np.zeros(0, np.uint32)
    for doc_id, is_null, n in zip(doc_ids.tolist(), null.tolist(), counts.tolist()):
        if len(rest) < n:
            have, size = [rest], len(rest)
            while size < n:
                have.append(next(runs))
                size += len(have[-1])
            rest = np.concatenate(have)
        yield None if is_null else doc_id, rest[:n]
        rest = rest[n:]


def write_codebook(path: str, counts: np.ndarray) -> None:
    with atomic_output(path) as f:
        _section(f, zlib.compress(code_lengths(counts).tobytes()))


def read_codebook(path: str) -> np.ndarray:
    with open_input(path) as f:
        return np.frombuffer(zlib.decompress(_read_section(f)), np.uint8)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """Encodes ``docs`` (doc_id, text) into a folder of token files; (folder, [(file, documents, ids)]) in doc_id order."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    spool = spool_tokens(docs, folder, tokenizer, end_id, "tokens", ordered=True, keep=KEEP)
    write_codebook(f"{folder}/codebook", spool.stat)

    def pack(entry):
        source, target = entry
        if not exists(target):
            write_part(target, read_codebook(f"{folder}/codebook"), read_spool(source, spool.dtype))
        delete(source)
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int64())})

    files = [(f"{folder}/part-{p.number:07d}", p.docs, p.tokens) for p in spool.parts]
    over_files(spark, [(p.path, f[0]) for p, f in zip(spool.parts, files)], pack, "done long").collect()
    return folder, files


def read_token_files(spark, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """A row for each document: doc_id, start (ids before it), n_tokens, ids_crc32, read from the files.

    Null texts give just the end id; repeated rows are documents of their own;
    a null doc_id comes first. No documents give an empty result.
    """
    starts = np.concatenate([[0], np.cumsum([f[2] for f in files])]).tolist() if files else []

    def read(entry):
        path, start = entry
        table = decoding_table(read_codebook(f"{folder}/codebook"))
        rows: list[tuple] = []
        for doc_id, ids in read_part(path, table):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
            start += len(ids)
            if len(rows) == 20_000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return over_files(spark, [(f[0], s) for f, s in zip(files, starts)], read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

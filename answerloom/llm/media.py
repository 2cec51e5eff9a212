"""Media columns: payloads as PNG images in a binary column, and perceptual hashes of them.

A payload becomes an 8-bit grey image 576 samples wide. Its rows get either no
filter or each the one (none, sub or up) with the least sum of absolute
differences, whichever deflates better. The reader checks the CRC of every
chunk and the stream's own checksum, and undoes all five filters of the format
with numpy, average and Paeth along diagonals (the writer has no use for these two). The feature is a 64-bit hash: the samples are laid out as nearly
square as ``WIDTHS`` allow and reduced to 32 x 32 means, their cosine transform
is taken, and each of the 64 lowest frequencies but the first gives a bit,
above the median or not.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import work_dir
from .tokens import groups

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Widths of images; all divide ``UNIT``.
WIDTHS = (24, 48, 96, 192, 288, 576)
_SIDE, _LOW = 32, 8
_k, _x = np.arange(_LOW)[:, None], np.arange(_SIDE)[None, :]
_COSINES = np.cos(np.pi * (2 * _x + 1) * _k / (2 * _SIDE))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8, filled with bytes 255 to a positive multiple of ``UNIT``, and its own length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (whole - len(data)), len(data)


def squared(image: np.ndarray) -> np.ndarray:
    """The samples in rows of the widest of ``WIDTHS`` that is not wider than high."""
    return image.reshape(-1, max(w for w in WIDTHS if w == WIDTHS[0] or w * w <= image.size))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(rows: np.ndarray, level: int = 6) -> bytes:
    """A grey 8-bit PNG of a (height, width) array of bytes."""
    height, width = rows.shape
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in (rows, sub, up)]
    streams = []
    for kind in (np.zeros(height, np.int64), np.argmin(cost, axis=0)):
        lines = np.empty((height, width + 1), np.uint8)
        lines[:, 0] = kind
        lines[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], sub, up))
        streams.append(zlib.compress(lines.tobytes(), level))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", min(streams, key=len)) + _chunk(b"IEND", b"")


def chunks_of(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk; a wrong signature, length or CRC raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the file ends within a chunk")
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        if len(data) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"chunk {kind!r} does not match its checksum")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _undo_diagonally(kind: int, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes the average (3) or Paeth (4) filter of a run of rows.

    A sample needs those left of it, above it and, for Paeth, between the two, all of
    which lie on earlier diagonals; so a whole diagonal goes at once. The work
    array has a row above and a column to the left.
    """
    height, width = lines.shape
    work = np.zeros((height + 1, width + 1), np.int16)
    work[0, 1:] = above
    flat, step = work.ravel(), width + 1
    given = lines.astype(np.int16).ravel()
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        at = (r + 1) * step + (d - r) + 1
        left, up = flat[at - 1], flat[at - step]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = flat[at - step - 1]
            da, db, dc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        flat[at] = (given[r * width + d - r] + guess) & 255
    return work[1:, 1:].astype(np.uint8)


def unfilter(kind: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undoes PNG's row filters for one byte a sample; runs of rows of like kind go together where their filter allows it."""
    height, width = lines.shape
    out = np.empty_like(lines)
    above = np.zeros(width, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [height]]) if height else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        k, own = int(kind[a]), lines[a:b]
        if k == 0:
            out[a:b] = own
        elif k == 1:
            out[a:b] = np.cumsum(own, axis=1, dtype=np.uint8)
        elif k == 2:
            out[a:b] = np.cumsum(own, axis=0, dtype=np.uint8) + above
        elif k in (3, 4):
            out[a:b] = _undo_diagonally(k, own, above)
        else:
            raise ValueError(f"filter {k} is not known")
        above = out[b - 1]
    return out


def read_png(png: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG; damaged or other files raise ValueError."""
    head, data, ended = None, [], False
    for kind, body in chunks_of(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended |= kind == b"IEND"
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only grey 8-bit images without interlacing are read")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(f"the image data are damaged: {e}") from None
    if len(raw) != height * (width + 1):
        raise ValueError("the image data have a wrong length")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def low_frequency_hash(rows: np.ndarray) -> bytes:
    """8 bytes: signs, about their median, of the 8 x 8 lowest cosine frequencies of the image's 32 x 32 means."""

    def reduced(x: np.ndarray, axis: int) -> np.ndarray:
        n = x.shape[axis]
        if n < _SIDE:
            return np.take(x, np.arange(_SIDE) * n // _SIDE, axis=axis)
        edges = np.arange(_SIDE + 1) * n // _SIDE
        return np.add.reduceat(x, edges[:-1], axis=axis) / np.expand_dims(np.diff(edges), 1 - axis)

    small = reduced(reduced(rows.astype(np.float64), 1), 0)
    freq = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = freq > np.median(freq[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a PNG. Null texts are empty payloads of filling only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(1), 4_000_000):
                part = batch.slice(a, b - a)
                n, media = [], []
                for t in part.column(1):
                    data, size = payload_of(t.as_py())
                    n.append(size)
                    media.append(write_png(np.frombuffer(data, np.uint8).reshape(-1, UNIT)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "hash": pa.binary()}


def media_features(media: DataFrame) -> DataFrame:
    """Reads every stored image back: digests of payload and file, and the hash, as hex digits and as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                png = png.as_py()
                image = read_png(png)
                payload, mark = image.tobytes(), low_frequency_hash(squared(image))
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), mark.hex(), mark))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FEATURES.values())], names=list(_FEATURES))

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary")


def stored_media_features(docs: DataFrame) -> DataFrame:
    """Stores the media column of ``docs`` (doc_id, text) as a table in the shared folder and computes features of what is read back.

    Nulls count as empty texts, repeated rows stay, equal texts have equal values, an
    empty table gives no rows; other columns do not matter. ``hash`` is the binary
    column, ``feature`` the same in hexadecimal digits.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "media")
    # images are compressed already
    media_column(docs).write.option("compression", "none").parquet(f"{folder}/media")
    return media_features(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(f"{folder}/media"))

"""Token ids of whole texts, kept between two passes as compressed Arrow streams of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import atomic_output, open_input, save_counts, sum_counts
from .tokens import encoder, groups

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.large_binary())])


#: Ids after which a task starts another file (at the end of a group of texts).
FILE_TOKENS = 8_000_000


class Part(NamedTuple):
    number: int
    path: str
    docs: int
    tokens: int


class Spool(NamedTuple):
    parts: list[Part]
    stat: np.ndarray
    dtype: str


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to the ids of each document."""
    n = n + 1
    out = np.empty(len(ids) + len(n), np.uint32)
    last = np.cumsum(n) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end_id
    return out, n


def add_document_counts(counts: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
    """Adds one to the count of every id for each of these documents that has it."""
    at = 0
    for m in n.tolist():
        counts[ids[at : at + m]] += 1  # an id that occurs twice in the index is still increased once
        at += m


def spool_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, stat: str, ordered: bool, keep: int = 600_000) -> Spool:
    """Encodes ``docs`` (doc_id, text) and writes files of about ``FILE_TOKENS`` ids, numbered in their order.

    stat: "tokens" counts how often each id occurs, "docs" in how many documents.
    ordered: files follow each other by ascending doc_id (nulls first), and so do
    the documents within; equal ids are ordered by a hash of the text.
    keep: chunks of text that a worker's encoder remembers.
    The driver keeps a row for each file and one array of the vocabulary's size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ordered:
        order = ["doc_id", "tie"]
        docs = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).select("doc_id", "text")
    most = FILE_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, keep)
        dtype = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        size = max(enc.size, end_id + 1)
        counts = np.zeros(size, np.int64)

        def encoded() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for batch in batches:
                for a, b in groups(batch.column("text"), 3_000_000):
                    ids, n = with_end(*enc.encode(batch.column("text").slice(a, b - a)), end_id)
                    if stat == "tokens":
                        counts[:] += np.bincount(ids, minlength=size)
                    else:
                        add_document_counts(counts, ids, n)
                    small = ids.astype(dtype)
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * small.itemsize
                    column = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(small)])
                    yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), column], schema=SCHEMA), len(ids)

        every, rows = encoded(), []
        for first in every:
            path, n_docs, n_tokens = f"{folder}/spool-{part:07d}-{len(rows):05d}", 0, 0
            with atomic_output(path) as f, pa.ipc.new_stream(f, SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch, tokens in chain([first], every):
                    out.write_batch(batch)
                    n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + tokens
                    if n_tokens >= most:
                        break
            rows.append((path, n_docs, n_tokens))
        if rows:
            save_counts(f"{folder}/counts-{part:07d}", counts)
            path, docs_in, tokens_in = (list(c) for c in zip(*rows))
            yield pa.RecordBatch.from_pydict({"part": [part] * len(rows), "path": path, "docs": docs_in, "tokens": tokens_in, "dtype": [dtype] * len(rows)})

    rows = sorted(docs.mapInArrow(run, "part long, path string, docs long, tokens long, dtype string").collect(), key=lambda r: (r.part, r.path))
    parts = [Part(k, r.path, r.docs, r.tokens) for k, r in enumerate(rows)]
    counted = sorted({r.part for r in rows})
    total = sum_counts(docs.sparkSession, [f"{folder}/counts-{k:07d}" for k in counted], folder) if parts else np.zeros(0, np.int64)
    return Spool(parts, total, rows[0].dtype if rows else "<u4")


def read_spool(path: str, dtype: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, ids of all these documents, number of ids of each), batch by batch."""
    with open_input(path) as f, pa.ipc.open_stream(f) as batches:
        for batch in batches:
            column = batch.column(2)
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype).astype(np.uint32)
            yield batch.column(0), ids, batch.column(1).to_numpy()

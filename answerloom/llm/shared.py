"""The folder that driver and executors share, and helpers to keep files there.

``spark.checkpoint.dir`` names the folder. Executors reach it through
``pyarrow.fs`` so that any store with a URI works; a file appears under its
final name only when it is complete, so a task that is run again after its
executor was lost writes the same file once more.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new local one only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = now.get() if now.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="answerloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    # with the scheme of the cluster's default store, where the setting names none
    jpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of its own below the shared root."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class atomic_output:
    """``with atomic_output(uri) as f``: the file gets its name when all is written."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.file = self.fs.open_output_stream(self.tmp, compression=None)
        return self.file

    def __exit__(self, kind, value, trace):
        self.file.close()
        if kind is None:
            if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
                self.fs.delete_file(self.path)  # of an earlier attempt; some stores do not rename onto a file
            self.fs.move(self.tmp, self.path)
        else:
            self.fs.delete_file(self.tmp)


def open_input(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


def exists(uri: str) -> bool:
    fs, path = open_fs(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def delete(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)


#: Entries that a task's closure carries at most; longer lists stand in files of so many, of which a task reads one.
CLOSURE_ENTRIES = 1000


def over_files(spark: SparkSession, entries: list, fn: Callable[[object], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """One task for each entry of a driver list (of files, never of rows): the batches that ``fn(entry)`` gives."""
    parts = [entries[k : k + CLOSURE_ENTRIES] for k in range(0, len(entries), CLOSURE_ENTRIES)]
    folder = None
    if len(parts) > 1:
        folder = work_dir(spark, "entries")
        for k, part in enumerate(parts):
            with atomic_output(f"{folder}/{k:07d}") as f:
                f.write(pickle.dumps(part))
        parts = []

    def entry(k: int):
        part, at = divmod(k, CLOSURE_ENTRIES)
        if folder is None:
            return parts[part][at]
        with open_input(f"{folder}/{part:07d}") as f:
            return pickle.loads(f.read())[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from fn(entry(k))

    n = max(1, len(entries))
    return spark.range(0, len(entries), 1, n).mapInArrow(run, schema)


def save_counts(uri: str, counts: np.ndarray) -> None:
    with atomic_output(uri) as f:
        f.write(zlib.compress(np.ascontiguousarray(counts, dtype="<i8").tobytes(), 1))


def load_counts(uri: str) -> np.ndarray:
    with open_input(uri) as f:
        return np.frombuffer(zlib.decompress(f.read()), dtype="<i8")


def sum_counts(spark: SparkSession, paths: list[str], out: str, fan_in: int = 16) -> np.ndarray:
    """Sums count arrays of one fixed length, kept as files, by a tree of tasks that each hold two arrays.

    The driver gets one array; its length is fixed by the caller (a vocabulary or a
    number of hash buckets), not by the data.
    """
    level = 0
    while len(paths) > fan_in:
        groups = [(f"{out}/sum-{level}-{k}", paths[k : k + fan_in]) for k in range(0, len(paths), fan_in)]

        def fold(group):
            target, members = group
            total = load_counts(members[0]).copy()
            for p in members[1:]:
                total += load_counts(p)
            save_counts(target, total)
            yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int64())})

        over_files(spark, groups, fold, "done long").collect()
        paths, level = [g[0] for g in groups], level + 1
    total = load_counts(paths[0]).copy()
    for p in paths[1:]:
        total += load_counts(p)
    return total

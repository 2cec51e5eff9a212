"""Vector expressions and numpy kernels; sums are taken in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

TINY = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    n = norm(a) + TINY
    return F.transform(col(a), lambda x: x.cast("double") / n)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + TINY)


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's array column as a matrix of doubles; all vectors have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def map_vectors(df: DataFrame, vector: str, out: str, kind: str, fn: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """``df`` with a column that ``fn`` computes from whole batches of vectors. Rows with a null vector get null."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            have = column.is_valid()
            values = fn(matrix(column.filter(have))) if pa.compute.any(have).as_py() else None
            if values is None:
                new = pa.nulls(batch.num_rows)
            elif column.null_count:
                new = values.take(pa.array(np.where(have.to_numpy(zero_copy_only=False), np.cumsum(have.to_numpy(zero_copy_only=False)) - 1, 0), mask=~have.to_numpy(zero_copy_only=False)))
            else:
                new = values
            yield pa.RecordBatch.from_arrays([*batch.columns, new.cast(_arrow(kind))], names=[*batch.schema.names, out])

    import pyarrow.compute  # noqa: F401

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}[kind]


def rows(x: np.ndarray) -> pa.Array:
    """A matrix as an array column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.ravel()))


def similarities(df: DataFrame, vector: str, centres: np.ndarray, out: str = "sims") -> DataFrame:
    """One array of dot products with all centres for each row: a matrix product for each batch, no join and no shuffle.

    centres: (themes, dimensions), on the driver; its size is that of the themes.
    """
    c = np.asarray(centres, np.float64)
    return map_vectors(df, vector, out, "array<double>", lambda e: rows(e @ c.T))


def centred(df: DataFrame, vector: str, mean: np.ndarray, strength: float = 1.0, axis: np.ndarray | None = None, out: str = "centred") -> DataFrame:
    """Vectors less ``strength`` times the mean and their part along ``axis``, with unit length."""
    mu, a = np.asarray(mean, np.float64), None if axis is None else np.asarray(axis, np.float64)

    def run(e: np.ndarray) -> pa.Array:
        x = e - strength * mu
        if a is not None:
            x = x - (x @ a)[:, None] * a
        return rows(unit_rows(x))

    return map_vectors(df, vector, out, "array<double>", run)


def axis_of(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """The unit vector from negative wording to positive."""
    return unit_rows(np.mean(positive, 0) - np.mean(negative, 0))


def group_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean): sums of whole batches first, then of their partial sums, element by element."""
    from pyspark.sql import types as T

    kind = df.schema[key].dataType
    at_key, at_vec = df.columns.index(key), df.columns.index(vector)
    schema = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(at_vec).is_valid())
            if not batch.num_rows:
                continue
            codes = batch.column(at_key).dictionary_encode(null_encoding="encode")
            code, e = codes.indices.to_numpy(), matrix(batch.column(at_vec))
            order = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            sums = np.add.reduceat(e[order], heads, axis=0)
            n = np.diff(np.concatenate([heads, [len(code)]]))
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(code[order][heads])), pa.array(n, pa.int64()), rows(sums)], names=[key, "n", "sums"])

    return _added(df.mapInArrow(partial, schema), key)


def member_means(df: DataFrame, keys: str, vector: str, among: list[str]) -> DataFrame:
    """(key, n, mean) of the rows whose array ``keys`` has the key, for each of ``among`` that any row has.

    A partition adds up its rows without a copy for each key, and sends one row of sums for a key.
    """
    from pyspark.sql import types as T

    at_keys, at_vec = df.columns.index(keys), df.columns.index(vector)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        values = pa.array(among, pa.string())
        n, sums = np.zeros(len(among), np.int64), None
        for batch in batches:
            batch = batch.filter(batch.column(at_vec).is_valid())
            if not batch.num_rows:
                continue
            e, lists = matrix(batch.column(at_vec)), batch.column(at_keys)
            sums = np.zeros((len(among), e.shape[1])) if sums is None else sums
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy()
            order = np.argsort(code, kind="stable")
            counts = np.bincount(code + 1, minlength=len(among) + 1)
            ends = np.cumsum(counts)
            for k in np.flatnonzero(counts[1:]):
                sums[k] += e[row[order[ends[k] : ends[k + 1]]]].sum(0)
            n += counts[1:]
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([values.take(pa.array(some)), pa.array(n[some]), rows(sums[some])], names=["key", "n", "sums"])

    return _added(df.mapInArrow(partial, schema), "key")


def _added(partials: DataFrame, key: str) -> DataFrame:
    """(key, n, mean) of partial (key, n, sums), element by element."""
    exploded = partials.select(key, "n", F.posexplode("sums").alias("i", "x"))
    by_element = exploded.groupBy(key, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    listed = by_element.groupBy(key).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return listed.select(key, "n", F.transform("v", lambda s: s["x"] / F.col("n")).alias("mean"))

"""What outlives a run: vectors, stages, frozen groups, edits."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "model string, key string, vec array<float>"


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


class VectorCache:
    """A table of vectors by model and text key, partitioned by model; a table that cannot be read counts as empty."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path, model

    def table(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path).where(F.col("model") == self.model).select("key", "vec")
        except AnalysisException:
            return self.spark.createDataFrame([], "key string, vec array<float>")

    def missing(self, texts: DataFrame, key: str = "key") -> DataFrame:
        return texts.dropDuplicates([key]).join(self.table().select(F.col("key").alias(key)), key, "left_anti")

    def add(self, vectors: DataFrame) -> None:
        vectors.select(F.lit(self.model).alias("model"), "key", "vec").write.mode("append").partitionBy("model").parquet(self.path)

    def vectors(self, texts: DataFrame, embedder, key: str = "key", text: str = "text") -> DataFrame:
        """``texts`` with ``vec``; only what the table lacks is encoded, and added to it."""
        from ..operators.backends import embed

        new = embed(self.missing(texts, key).select(F.col(key).alias("key"), F.col(text).alias("text")), embedder)
        self.add(new)
        table = self.table().groupBy("key").agg(F.first("vec").alias("vec"))
        return texts.join(table.withColumnRenamed("key", key), key)


class Stages:
    """Results of stages as Parquet under ``run_dir/stage/key``; a stage whose key is there is read, not computed."""

    def __init__(self, spark: SparkSession, run_dir: str):
        self.spark, self.run_dir = spark, run_dir.rstrip("/")

    def path(self, stage: str, key: str) -> str:
        return f"{self.run_dir}/{stage}/{key}"

    def result(self, stage: str, key: str, compute, force: bool = False) -> tuple[DataFrame, bool]:
        """(table, whether it was there)."""
        path = self.path(stage, key)
        if not force and exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.read.parquet(path), True
        compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), False


class FrozenGroups:
    """Groups found before, by fingerprint, the newest few kept."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 8):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def load(self, fingerprint: str) -> DataFrame | None:
        path = f"{self.path}/{fingerprint}"
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None

    def save(self, fingerprint: str, groups: DataFrame) -> None:
        groups.select("clause_id", "cluster").write.mode("overwrite").parquet(f"{self.path}/{fingerprint}")
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = sorted(fs.listStatus(jpath), key=lambda s: s.getModificationTime())
        for old in kept[: -self.keep]:
            fs.delete(old.getPath(), True)


def _path(path: str):
    """(file system, path) of a path or URI, as the session's tables resolve it."""
    spark = SparkSession.active()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def save_json(path: str, value) -> None:
    """Written beside its place first, then renamed."""
    fs, target = _path(path)
    data = json.dumps(value, indent=1, ensure_ascii=False, default=str).encode("utf-8")
    _, beside = _path(f"{path}.tmp")
    out = fs.create(beside, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def load_json(path: str, default=None):
    """What ``save_json`` wrote; the default where there is no such file or it holds no JSON."""
    fs, source = _path(path)
    if not fs.exists(source):
        return default
    stream = fs.open(source)
    try:
        return json.loads(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return default
    finally:
        stream.close()

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what bytes.split() cuts, the ASCII white space being the only separator.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null gives none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key written as text, modulo the divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the folder that all executors share, and read from there.

    Later steps then neither repeat the work nor depend on an executor's disk. The folder is the session's
    spark.checkpoint.dir; only where that is unset (tests) the warehouse serves.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/dossier-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder of stored() rows that no later step reads."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's spark.sql.execution.arrow.maxBytesPerBatch to 2 MB, unless the user chose a value.

    By default a batch of texts has up to 64 MB: a task's whole share of a table, held at once in buffers beside the
    executor's heap, each grown by doubling, and in Python, both ways. Spark reads the setting when the rows are
    computed, so that it stays. It changes no rows.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, 2 << 20)


def after_shuffle(condition: Column) -> Column:
    """The condition, kept above the shuffle of its rows: several uses of these rows then share that one shuffle.

    Partition ids aren't deterministic for Spark, so that it doesn't move the filter. The uses must also read all
    columns, or else each has a shuffle of its own.
    """
    return F.when(F.spark_partition_id() >= 0, condition)


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined ("inner" or "left") with groups, which has a row per key and, in _n, how many of the rows have that key.

    Keys with more rows than an even share of a shuffle partition are at most as many as there are partitions; these
    rows of groups are broadcast, so that a hot key's rows stay where they are. The other keys are shuffled. groups is
    read several times: it should be stored.
    """
    even = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"] // shuffle_partitions(rows.sparkSession)
    heavy = F.col("_n") > max(even, 1000)
    hot = groups.where(heavy)
    if hot.isEmpty():
        return rows.join(groups.drop("_n"), keys, how)
    hot = F.broadcast(hot.drop("_n"))
    light = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(~heavy).drop("_n"), keys, how)
    return rows.join(hot, keys).unionByName(light)


def small(df: DataFrame, most: int) -> DataFrame:
    """The rows, stored, and marked for broadcast if they are counted to be at most so many."""
    held = stored(df)
    return F.broadcast(held) if held.count() <= most else held


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(label, text) of at most ``most`` different labelled rows, chosen by a hash of ids and texts.

    docs has doc_id and text, labels doc_id and the label. Ids may be repeated on both sides: the bound holds for what
    comes out, each (id, text, label) once.
    """
    chosen = labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = met.select(F.struct(F.xxhash64("doc_id").alias("by"), text_key(F.col("text")).alias("then"), label).alias("key"), "text")
    if met.select("doc_id").count() > most:
        last = rows.select("key").distinct().orderBy("key").limit(most).agg(F.max("key").alias("last"))  # one row
        rows = rows.join(F.broadcast(last), F.col("key") <= F.col("last")).select("key", "text")
    return rows.groupBy("key").agg(F.first("text").alias("text")).select(F.col(f"key.{label}").alias(label), "text")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def word_offsets(some: list[bytes]) -> np.ndarray:
    """Where each word starts in the words joined by one space, and where a next one would."""
    return np.r_[0, np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.diff(np.r_[starts, len(values)])


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)

"""Versions of a table with compare-and-swap, and record files that follow marks (PIP20, SNK4).

A version is a folder of Parquet files that is never changed, and a pointer is a file named by the version's number that
names its folder. Who commits version n + 1 creates that pointer, which only one can do (creation without overwriting is
atomic in HDFS and local file systems); the other finds that the table changed and begins again from the new version.
Readers take the highest pointer, so that they see a whole version or the one before.

Defined cases: a table without a version is read as the empty table of its schema; folders that no pointer names are
left by tries that lost, and go with ``forget_before``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources.packages import write_files


class Changed(RuntimeError):
    """Another version was committed first."""


@dataclass(frozen=True)
class Versions:
    """The versions of a table of one schema in a folder that all executors share."""

    spark: SparkSession
    path: str
    schema: str

    def _files(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        return jvm.Path, jvm.Path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> int:
        """The number of the newest version; 0 if there is none."""
        path, files = self._files()
        folder = path(f"{self.path}/pointers")
        numbers = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()] if files.exists(folder) else []
        return max(numbers, default=0)

    def _folder(self, number: int) -> str:
        path, files = self._files()
        stream = files.open(path(f"{self.path}/pointers/{number}"))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        number = self.current() if number is None else number
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(number)}")

    def commit(self, rows: DataFrame, after: int) -> int:
        """Writes a version that follows ``after``; raises Changed if another one has followed it."""
        name = f"version-{uuid.uuid4().hex}"
        rows.to(self.spark.createDataFrame([], self.schema).schema).write.parquet(f"{self.path}/{name}")
        path, files = self._files()
        if self.current() != after:
            raise Changed(f"version {after} isn't the newest")
        files.mkdirs(path(f"{self.path}/pointers"))
        try:
            stream = files.create(path(f"{self.path}/pointers/{after + 1}"), False)
        except Exception as e:  # the JVM's FileAlreadyExistsException
            if "exist" in str(e):
                raise Changed(f"version {after + 1} was committed meanwhile") from e
            raise
        stream.write(bytearray(name.encode()))
        stream.close()
        return after + 1

    def replace(self, made: Callable[[DataFrame], DataFrame], attempts: int = 3) -> int:
        """PIP20: commits made(newest rows); if the table changed while that was made, once more from the new rows."""
        for _ in range(attempts):
            before = self.current()
            try:
                return self.commit(made(self.read(before)), before)
            except Changed:
                continue
        raise Changed(f"the table changed in each of {attempts} attempts")

    def forget_before(self, number: int) -> None:
        """Deletes the versions before one, and what lost tries left."""
        path, files = self._files()
        kept = {self._folder(n) for n in range(number, self.current() + 1)}
        for f in files.listStatus(path(self.path)):
            if f.getPath().getName().startswith("version-") and f.getPath().getName() not in kept:
                files.delete(f.getPath(), True)
        for f in files.listStatus(path(f"{self.path}/pointers")):
            if f.getPath().getName().isdigit() and int(f.getPath().getName()) < number:
                files.delete(f.getPath(), False)


MARKS = "key string, version long"


def mark(marks: Versions, keys: DataFrame) -> int:
    """SNK4: the keys' records have changed: each gets the next version of its mark."""

    def more(now: DataFrame) -> DataFrame:
        fresh = keys.select("key").distinct().withColumn("new", F.lit(1))
        return now.join(fresh, "key", "full_outer").select("key", (F.coalesce("version", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("version"))

    return marks.replace(more)


def flush(marks: Versions, rendered: Callable[[DataFrame], DataFrame], folder: str, passes: int = 4) -> int:
    """SNK4: writes the marked records and takes off the marks whose version is still the one that was written.

    rendered(keys): (key, name, content) of the records that there are; a mark without a record goes. A record marked again
    meanwhile keeps its mark and is written in the next pass. Returns how many files were written.
    """
    written = 0
    for _ in range(passes):
        pending = marks.read()
        if pending.isEmpty():
            break
        written += write_files(rendered(pending.select("key")), folder)
        marks.replace(lambda now, done=pending: now.join(done, ["key", "version"], "left_anti"))
    return written

"""Streams: arrivals, settling, copies, changes and windows (SRC1-SRC3, SRC18, STR1-STR9, SNK3, SNK7)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

POLLS, ZERO_BYTES_S, UNOPENABLE_S, LONGEST_S = 2, 30, 60, 900


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in tests, where it is unset, the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def arrivals(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000, kind: str = "parquet") -> DataFrame:
    """SRC1, STR1: files of a folder as they arrive."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def settled(polls: DataFrame, needed: int = POLLS, then: tuple[str, ...] = (), filled: Column | None = None) -> DataFrame:
    """SRC2 in batch form: (path, settled_at, size): the first poll that ends `needed` alike, readable ones in a row.

    then: columns that order polls of one path and time. filled: which polls may end a row, by default those of a size
    above 0; an empty one can still begin it. Polls without a time come last.
    """
    filled = F.col("size") > 0 if filled is None else filled
    w = Window.partitionBy("path").orderBy(F.col("polled_at").asc_nulls_last(), *then)
    until = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = F.col("readable") & filled & (F.lag("size").over(w) == F.col("size")) & (F.lag("mtime").over(w) == F.col("mtime")) & F.lag("readable").over(w)
    marked = polls.withColumn("alike", F.coalesce(alike, F.lit(False))).withColumn("n", F.row_number().over(w))
    # Counted from the last poll that isn't alike, row by row: polls of one time are no peers.
    marked = marked.withColumn("streak", F.col("n") - F.max(F.when(~F.col("alike"), F.col("n"))).over(until) + 1)
    return marked.where(F.col("alike") & (F.col("streak") >= needed)).groupBy("path").agg(F.min("polled_at").alias("settled_at"), F.min_by("size", "n").alias("size"))


class Settling(StatefulProcessor):
    """SRC2, STR2: per path, what the polls say; the poll's own time is the clock."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "size long, mtime double, polls int, first double, told int")

    def handleInputRows(self, key, rows, timers):
        state = self.seen.get() if self.seen.exists() else None
        out = []
        for frame in rows:
            for r in frame.sort_values("polled_at").itertuples():
                at = r.polled_at.timestamp()
                if state is None or r.gone:
                    state = None if r.gone else (int(r.size), float(r.mtime), int(r.readable), at, 0)
                    continue
                size, mtime, polls, first, told = state
                same = (size, mtime) == (r.size, r.mtime)
                polls = polls + 1 if same and r.readable else int(r.readable)
                event = None
                if r.size == 0 and same:
                    event = "settled" if at - first >= ZERO_BYTES_S else None
                elif not r.readable:
                    event = "unopenable" if at - first >= UNOPENABLE_S and not told else None
                elif polls >= POLLS:
                    event = "settled"
                elif at - first >= LONGEST_S and not told:
                    event = "stillChanging"
                if event:
                    out.append((key[0], event, int(r.size), r.polled_at))
                state = (int(r.size), float(r.mtime), polls, first, int(told or event in ("unopenable", "stillChanging")))
                if event == "settled":
                    state = None
        if state is None:
            self.seen.clear()
        else:
            self.seen.update(state)
        yield pd.DataFrame(out, columns=["path", "event", "size", "at"]).astype({"size": "int64", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def settling(polls: DataFrame) -> DataFrame:
    """The stream of (path, event, size, at) of a stream of polls."""
    return polls.groupBy("path").transformWithStateInPandas(Settling(), "path string, event string, size long, at timestamp", "Append", "None")


def without_copies(files: DataFrame, digest: str = "sha256", at: str | None = None, within: str = "30 seconds") -> DataFrame:
    """STR4: the first file of each content; with an event time, within a watermark, so that state is bounded."""
    if at is None:
        return files.dropDuplicates([digest])
    return files.withWatermark(at, within).dropDuplicatesWithinWatermark([digest])


def windowed(events: DataFrame, at: str, keys: list[str], late: str = "1 hour", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """STR7, STR9: counts by sliding windows of event time."""
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """STR3, SNK3: everything there is now, each batch once per checkpoint; `write` must bear a repetition of its batch id."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """SNK3, SNK7: a folder per batch id, replaced when the batch is repeated."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def follow(spark: SparkSession, path: str) -> DataFrame:
    """STR8: log lines as they are written to new files."""
    return spark.readStream.schema("at timestamp, level string, category string, message string").json(path)

"""Queries over streams that Spark derives from the test tables: timers, moves, observed values, followed logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dossier.plans.adapters import table
from dossier.plans.registry import query
from dossier.sources.follow import FollowedLines
from dossier.streaming import arrivals, changes

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Streamed:
    """Rows written to a folder of the shared one, streamed from there, and what the stream wrote."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{arrivals.shared_folder(spark)}/dossier-stream-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def put(self, rows: DataFrame) -> None:
        self.schema = rows.schema
        rows.write.mode("append").parquet(f"{self.folder}/in")

    def run(self, made) -> None:
        """Everything there is now, through made(stream), in one batch."""
        stream = made(arrivals.arrivals(self.spark, f"{self.folder}/in", self.schema, per_trigger=1_000_000))
        self.out = stream.schema
        arrivals.into(stream, f"{self.folder}/checkpoint", arrivals.snapshot_writer(f"{self.folder}/out")).awaitTermination()

    def found(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.out.fields, StructField("batch", IntegerType())])).parquet(f"{self.folder}/out")


_POLLS_SQL = """p AS (SELECT o_orderkey AS k, TIMESTAMP '2024-01-01' + o_orderkey * INTERVAL 1 SECOND AS t FROM orders),
polls AS (SELECT k, t + CASE k % 6 WHEN 1 THEN 4 WHEN 4 THEN 10 WHEN 5 THEN 24 ELSE 0 END * INTERVAL 1 SECOND AS last FROM p), now AS (SELECT max(last) AS now FROM polls)"""


@query("settling_timers", f"""WITH {_POLLS_SQL}, e AS (SELECT k, CASE k % 6 WHEN 0 THEN 'settled' WHEN 1 THEN 'settled' WHEN 2 THEN 'unopenable' WHEN 3 THEN 'stillChanging' WHEN 5 THEN 'settled' END AS event, CASE k % 6 WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 5 END AS size,
t + CASE k % 6 WHEN 0 THEN 30 WHEN 1 THEN 4 WHEN 2 THEN 60 WHEN 3 THEN 900 WHEN 5 THEN 24 END * INTERVAL 1 SECOND AS happened, k % 6 IN (1, 5) AS polled FROM p WHERE k % 6 <> 4)
SELECT '/in/' || k AS path, event, size::BIGINT AS size, e.happened AS "at" FROM e, now WHERE polled OR e.happened <= now""")
def settling_timers(spark, sf_dir):
    """SRC2, STR2: empty, unreadable and changing files are told by timers, with no further poll of theirs."""
    key = F.col("o_orderkey")
    poll = lambda after, size, readable=True, gone=False: F.struct(F.lit(after).alias("after"), F.lit(size).cast("long").alias("size"), F.lit(readable).alias("readable"), F.lit(gone).alias("gone"))
    cases = [[poll(0, 0)], [poll(0, 5), poll(2, 5), poll(4, 5)], [poll(0, 3, False)], [poll(0, 5)], [poll(0, 5), poll(10, 5, True, True)], [poll(0, 0), poll(20, 5), poll(22, 5), poll(24, 5)]]
    which = F.when(key % 6 == 0, F.array(*cases[0]))
    for n, some in enumerate(cases[1:], 1):
        which = which.when(key % 6 == n, F.array(*some))
    rows = table(spark, sf_dir, "orders").select(key, F.explode(which).alias("p"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + key + F.col("p.after"))
    streamed = Streamed(spark)
    streamed.put(rows.select(F.concat(F.lit("/in/"), key.cast("string")).alias("path"), at.alias("at"), "p.size", F.lit(1.0).alias("mtime"), "p.readable", "p.gone"))
    streamed.run(changes.settling)
    return streamed.found().select("path", "event", "size", F.col("at").cast("timestamp_ntz").alias("at"))


_CHANGES_SQL = """p AS (SELECT o_orderkey AS k, TIMESTAMP '2024-01-01' + o_orderkey * INTERVAL 1 SECOND AS t, o_orderkey % 45 AS gap, o_orderkey % 5 AS kind, o_orderkey % 7 = 0 AS own, '/a/' || o_orderkey AS was, CASE o_orderkey % 3 WHEN 0 THEN '/a/new' WHEN 1 THEN '/b/' ELSE '/a/' END || o_orderkey AS new FROM orders),
rows_ AS (SELECT *, t AS gone_at, t + gap * INTERVAL 1 SECOND AS found_at FROM p),
now AS (SELECT max(greatest(CASE WHEN kind <> 1 THEN gone_at END, CASE WHEN kind <> 0 THEN found_at END)) AS now FROM rows_), c AS (SELECT * FROM rows_ WHERE NOT own)"""


@query("archive_moves", f"""WITH {_CHANGES_SQL}, e AS (
SELECT k AS inode, CASE k % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'moved' ELSE 'changed' END AS event, was, new AS now_, found_at AS happened, TRUE AS told FROM c WHERE kind > 1 AND gap < 30
UNION ALL SELECT k, 'deleted', was, NULL, gone_at + INTERVAL 30 SECOND, kind > 1 AND gap >= 30 FROM c WHERE kind = 0 OR kind > 1 AND gap >= 30
UNION ALL SELECT k, 'created', NULL, new, found_at + INTERVAL 30 SECOND, FALSE FROM c WHERE kind = 1 OR kind > 1 AND gap >= 30)
SELECT inode, event, was, now_ AS now, e.happened AS "at" FROM e, now WHERE told OR e.happened <= now.now""")
def archive_moves(spark, sf_dir):
    """SRC3, STR4: deletions and creations of one inode are moves, what stays alone is told by a timer, the archive's own changes are left out."""
    key = F.col("o_orderkey")
    path = lambda folder: F.concat(folder, key.cast("string"))
    was, new = path(F.lit("/a/")), path(F.when(key % 3 == 0, "/a/new").when(key % 3 == 1, "/b/").otherwise("/a/"))
    change = lambda kind, p, after, when: F.when(when, F.struct(F.lit(kind).alias("kind"), p.alias("path"), after.cast("long").alias("after")))
    own, gap, zero = key % 7 == 0, key % 45, F.lit(0)
    gone, found = key % 5 != 1, key % 5 != 0
    some = F.array(change("expected", was, zero - 1, own & gone), change("gone", was, zero, gone), change("expected", new, gap - 1, own & found & ~((key % 3 == 2) & gone & (gap == 0))), change("found", new, gap, found))
    rows = table(spark, sf_dir, "orders").select(key, F.explode(F.array_compact(some)).alias("c"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + key + F.col("c.after"))
    streamed = Streamed(spark)
    streamed.put(rows.select("c.path", at.alias("at"), "c.kind", key.cast("long").alias("inode")))
    streamed.run(lambda stream: changes.moves(changes.without_own(stream), chained=True))
    return streamed.found().select("inode", "event", "was", "now", F.col("at").cast("timestamp_ntz").alias("at"))


@query("observed_maxima", """WITH b AS (SELECT event_type AS key, event_id * 4 // (SELECT count(*) FROM events) AS batch, max(value) AS v FROM events GROUP BY ALL), r AS (SELECT *, max(v) OVER w AS value, lag(key) OVER w AS before, max(v) OVER (PARTITION BY key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM b WINDOW w AS (PARTITION BY key ORDER BY batch))
SELECT key, batch::INT AS batch, value FROM r WHERE was IS NULL OR value > was""")
def observed_maxima(spark, sf_dir):
    """STR5: the largest value of each kind of event after each of four batches, where it changed."""
    events = table(spark, sf_dir, "events")
    total = events.count()
    streamed = Streamed(spark)
    for n in range(4):
        streamed.put(events.where(F.expr(f"event_id * 4 div {total}") == n).select("event_type", "value"))
        streamed.run(lambda stream: changes.observed(stream, F.col("event_type"), F.col("value"), "max"))
    return streamed.found().select("key", "batch", "value")


@query("followed_logs", """SELECT event_id, event_type AS category, value > 20 AS warned, event_id % 2 = 1 AS later FROM events""")
def followed_logs(spark, sf_dir):
    """STR8: JSON lines of two days' logs, followed by their offsets over a restart between them."""
    spark.dataSource.register(FollowedLines)
    folder = f"{arrivals.shared_folder(spark)}/dossier-logs-{uuid.uuid4().hex}"
    lines = F.to_json(F.struct("event_id", F.col("event_type").alias("category"), F.when(F.col("value") > 20, "warning").otherwise("info").alias("level")))
    for n in (0, 1):
        table(spark, sf_dir, "events").where(F.col("event_id") % 2 == n).select(lines).write.mode("append").text(f"{folder}/logs")
        stream = spark.readStream.format("followed_lines").option("path", f"{folder}/logs").option("suffix", ".txt").load()
        arrivals.into(stream, f"{folder}/checkpoint", arrivals.snapshot_writer(f"{folder}/out")).awaitTermination()
    found = spark.read.schema("file string, offset long, line string, batch int").parquet(f"{folder}/out")
    row = F.from_json("line", "event_id long, category string, level string")
    return found.select(row.alias("r"), "batch").select("r.event_id", "r.category", (F.col("r.level") == "warning").alias("warned"), (F.col("batch") > 0).alias("later"))

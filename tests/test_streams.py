"""Timers, moves and followed files over several batches and restarts."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from dossier.plans import queries, registry  # noqa: F401  registers
from dossier.plans.stream_queries import Streamed
from dossier.sources.follow import FollowedLines, Follower
from dossier.streaming import arrivals, changes


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=seconds)


def test_timers_over_batches(spark):
    """A file that no later batch names is told when the watermark has passed its timer; one that is gone isn't."""
    schema = "path string, at timestamp, size long, mtime double, readable boolean, gone boolean"
    streamed = Streamed(spark)
    batches = [
        [("empty", at(0), 0, 1.0, True, False), ("locked", at(1), 5, 1.0, False, False), ("gone", at(1), 0, 1.0, True, False), ("slow", at(2), 5, 1.0, True, False)],
        [("gone", at(20), 0, 1.0, True, True), ("slow", at(22), 6, 2.0, True, False), ("tick", at(45), 1, 1.0, True, True)],
        [("slow", at(800), 7, 3.0, True, False), ("tick", at(900), 1, 1.0, True, True)],
        [("slow", at(903), 7, 3.0, True, False), ("slow", at(905), 7, 3.0, True, False)],
    ]
    for rows in batches:
        streamed.put(spark.createDataFrame(rows, schema).coalesce(1))
        streamed.run(changes.settling)
    found = {(r.path, r.event, r.at.replace(tzinfo=datetime.UTC) if r.at.tzinfo is None else r.at) for r in streamed.found().collect()}
    assert {(p, e) for p, e, _ in found} == {("empty", "settled"), ("locked", "unopenable"), ("slow", "stillChanging"), ("slow", "settled")}
    assert {streamed.found().where(f"event = '{e}' AND path = '{p}'").select(F.unix_timestamp("at") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).first()[0] for p, e in (("empty", "settled"), ("slow", "stillChanging"))} == {30, 902}


def test_moves_by_hand(spark):
    """Either order, repeated deletions, and an expectation that is used up by the first change."""
    schema = "path string, at timestamp, kind string, inode long"
    rows = [
        ("/b/x", at(0), "found", 1), ("/a/x", at(5), "gone", 1), ("/a/y", at(0), "gone", 2), ("/a/y", at(10), "gone", 2), ("/a/z", at(0), "expected", 3), ("/a/z", at(1), "gone", 3), ("/a/z", at(2), "found", 3),
        ("/a/w", at(0), "expected", 4), ("/a/w", at(31), "gone", 4), ("/t", at(500), "found", 9),
    ]
    streamed = Streamed(spark)
    streamed.put(spark.createDataFrame(rows, schema).coalesce(1))
    streamed.run(lambda s: changes.moves(changes.without_own(s), chained=True))
    assert sorted((r.inode, r.event, r.was, r.now) for r in streamed.found().collect()) == [(1, "moved", "/a/x", "/b/x"), (2, "deleted", "/a/y", None), (2, "deleted", "/a/y", None), (3, "created", None, "/a/z"), (4, "deleted", "/a/w", None)]


def test_followed_files_grow(spark, tmp_path):
    """Each complete line once over restarts; a line being written waits; a file written anew is read again."""
    spark.dataSource.register(FollowedLines)
    logs, out = tmp_path / "logs", []
    logs.mkdir()

    def run():
        stream = spark.readStream.format("followed_lines").option("path", str(logs)).option("suffix", ".log").option("split", "7").load()
        stream.writeStream.foreachBatch(lambda b, _: out.append(sorted((r.file.rpartition("/")[2], r.offset, r.line) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return out.pop() if out else []

    (logs / "a.log").write_bytes("one\nzwölf\nthr".encode())
    (logs / "skip.txt").write_text("no\n")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "zwölf")]
    with (logs / "a.log").open("ab") as f:
        f.write(b"ee\r\n" + b"x" * 40 + b"\n\n")
    (logs / "b.log").write_text("first\n")
    assert run() == [("a.log", 11, "three"), ("a.log", 18, "x" * 40), ("a.log", 59, ""), ("b.log", 0, "first")]
    assert run() == []
    (logs / "b.log").write_text("new\n")
    assert run() == [("b.log", 0, "new")]
    parts = Follower({"path": str(logs), "split": "5"}).partitions({}, {str(logs / "a.log"): 60})
    lines = [x for p in parts for x in Follower({"path": str(logs)}).read(p)]
    assert len(parts) == 12 and [x[2] for x in lines] == ["one", "zwölf", "three", "x" * 40, ""]


def test_observed_values(spark):
    streamed = Streamed(spark)
    for rows in ([("a", 1.0), ("b", 2.0)], [("a", 0.5), ("b", None)], [("b", 3.0), (None, 1.0)]):
        streamed.put(spark.createDataFrame(rows, "k string, v double"))
        streamed.run(lambda s: changes.observed(s, F.col("k"), F.col("v"), "max"))
    assert sorted((r.batch, str(r.key), r.value) for r in streamed.found().collect()) == [(0, "a", 1.0), (0, "b", 2.0), (2, "None", 1.0), (2, "b", 3.0)]


def test_keys_share_the_calls_of_the_state(spark):
    """A batch of many keys calls the state store per bucket, not per key, and due timers of all keys of a bucket are told at once."""
    calls = []

    class Held:
        rows: list = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("getListState", "exists", "get", "listTimers"):
                    return {"getListState": self, "exists": bool(self.rows), "get": iter(self.rows), "listTimers": iter([])}[name]
                self.rows = list(args[0]) if name == "put" else [] if name == "clear" else self.rows

            return call

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    processor = changes.Settling("EventTime")
    processor.init(Held())
    polls = pd.DataFrame({"key": [f"/{n}" for n in range(2000)], "at": pd.Timestamp("2024-01-01"), "size": 0, "mtime": 1.0, "readable": True, "gone": False})
    assert sum(map(len, processor.handleInputRows((1,), iter([polls]), None))) == 0 and len(processor.held.rows) == 2000
    due = pd.Timestamp("2024-01-01").value // 10**6 + 30_000
    found = pd.concat(processor.handleExpiredTimer((1,), Clock(due), Clock(due)))
    assert len(found) == 2000 and set(found.event) == {"settled"} and not processor.held.rows and len(calls) < 20


def test_inodes_are_exact(spark):
    """A number over 2**53 stays what it is beside an expectation that has none."""
    rows = [("/a/x", at(0), "expected", None), ("/a/x", at(1), "gone", 2**60 + 1), ("/a/x", at(2), "found", 2**60 + 1), ("/t", at(500), "found", 9)]
    streamed = Streamed(spark)
    streamed.put(spark.createDataFrame(rows, "path string, at timestamp, kind string, inode long").coalesce(1))
    streamed.run(lambda s: changes.moves(changes.without_own(s), chained=True))
    assert [(r.inode, r.event) for r in streamed.found().collect()] == [(2**60 + 1, "created")]


def test_polls_of_one_time(spark):
    """Polls of one path and time follow each other by the columns given, one by one."""
    rows = [("a", 1, 0, 5), ("a", 1, 1, 5), ("b", 1, 0, 5), ("b", 1, 1, 6), ("b", 1, 2, 6), ("c", 1, 0, 5), ("c", 1, 1, 6), ("c", 1, 2, 7), ("d", 1, 2, 5), ("d", 1, 1, 6), ("d", 1, 0, 6), ("d", 2, 3, 9)]
    polls = spark.createDataFrame(rows, "path string, polled_at int, id int, size int").selectExpr("*", "0 AS mtime", "true AS readable")
    assert sorted((r.path, r.size) for r in arrivals.settled(polls, then=("id",)).collect()) == [("a", 5), ("b", 6), ("d", 6)]
    assert [r.path for r in arrivals.settled(polls.where("path = 'b'"), 3, ("id",)).collect()] == []
    assert [r.size for r in arrivals.settled(spark.createDataFrame([("a", 1, 3 - i, 5) for i in range(3)], polls.schema[:4]).selectExpr("*", "0 AS mtime", "true AS readable"), 3, ("id",)).collect()] == [5]


def test_settled_files_of_empty_and_missing_polls(spark, tmp_path):
    """An empty poll can begin a row of alike ones, as in the SQL; polls without a time come last."""
    import random

    import duckdb

    draw = random.Random(3)
    rows = [(0, 1, 0, "view", 0.0), (1, 2, 0, "view", 5.0), (2, 1, 1, "view", 0.0), (3, 2, 1, "view", 50.0), (4, None, 2, "view", 5.0), (5, 1, 2, "view", 5.0), (6, 2, 2, "view", 50.0)]
    for user in range(3, 300):  # no times twice: the SQL leaves such ties open
        times = draw.sample(range(50), 6)
        rows += [(10 * user + k, t or None, user if user > 3 else None, draw.choice(["view", "view", "error", None]), draw.choice([0.0, 0.0, 5.0, 10.0, 10.5, 50.0, -1.0, float("nan"), None])) for k, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id long, t int, user_id long, event_type string, value double")
    events.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["settled_files"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(registry.ORACLE["settled_files"]).fetchall()
    assert set(map(tuple, found)) == set(want) and len(found) == len(want) and (0, datetime.datetime(1970, 1, 1, 0, 0, 2)) in want

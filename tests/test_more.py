"""Tasks, jobs, records, digests, and the settling stream."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import identifiers
from dossier.functions import labels as L
from dossier.functions import text as T
from dossier.operators import filters, observability, search
from dossier.plans import tasks
from dossier.streaming import arrivals


def test_text_helpers(spark):
    row = spark.createDataFrame([("/a/b/Café.pdf", "Body " * 900)], "p string, b string")
    got = row.select(T.file_name(T.compose("p")).alias("n"), T.embedding_summary([F.lit("Title: x"), F.lit(None)], F.col("b")).alias("s"), T.package_digest(F.array(F.lit("b"), F.lit("a"))).alias("d"), T.package_digest(F.array(F.lit("a"), F.lit("b"))).alias("e")).first()
    assert got.n == "Café.pdf" and len(got.s) == 2000 and got.s.startswith("Title: x\nBody") and got.d == got.e
    same = spark.createDataFrame([(1, 1, 5.0, 5.4, 7, 7), (1, 1, 5.0, 6.0, 7, 7), (1, 1, 5.0, 5.0, 7, 8), (1, 1, 5.0, 5.0, None, 8)], "a int, b int, c double, d double, e int, f int")
    assert [r.x for r in same.select(T.same_file(*[F.col(c) for c in "abcdef"]).alias("x")).collect()] == [True, False, False, True]


def test_label_helpers(spark):
    kind = "x array<struct<kind:string,value:string>>, y array<struct<kind:string,value:string>>"
    tags = [[("tag", v) for v in "abc"], [("tag", v) for v in "Bdefg"]]
    row = spark.createDataFrame([tuple(tags)], kind)
    assert [t.value for t in row.select(L.merge_tags(F.col("x"), F.col("y")).alias("t")).first().t] == list("abcde") and row.select(L.search_text(F.col("x"), "tag").alias("t")).first().t == "a\nb\nc"
    assert spark.createDataFrame([("NIF: 999999990",), (None,)], "t string").select(identifiers.stable_keys("t").alias("k")).collect()[0].k == ["nif:999999990"]
    vector = spark.createDataFrame([("house of houses house",), ("",)], "t string").select(search.stub_embedding("t").alias("v")).collect()
    assert len(vector[0].v) == 64 and sum(x * x for x in vector[0].v) == pytest.approx(1, abs=1e-5) and not any(vector[1].v)


def test_jobs_and_records(spark):
    jobs = spark.createDataFrame([(1, "pending", None, False), (2, "pending", None, True), (3, "done", None, False), (4, "running", "2025-01-01", False), (5, "pending", "2030-01-01", False)], "id long, state string, at string, gives_way boolean")
    assert [r.id for r in tasks.due_jobs(jobs.withColumn("next_run_at", F.to_timestamp("at")), "2025-06-01").orderBy("turn").collect()] == [1, 4, 2]
    kind = "id long, source_path string, kind string, strength int, tags array<string>"
    got = tasks.enqueue(spark.createDataFrame([(1, "/a", "read", 1, ["x"])], kind), spark.createDataFrame([(2, "/a", "ingest", 2, ["y"]), (3, "/b", "read", 1, [])], kind)).orderBy("source_path").collect()
    assert [(r.source_path, r.kind, r.id, r.tags) for r in got] == [("/a", "ingest", 2, ["x", "y"]), ("/b", "read", 3, [])]
    kind = "uid string, path string, title string"
    current, parsed = spark.createDataFrame([("a", "/1", "old"), ("b", "/2", "stays")], kind), spark.createDataFrame([("a", "/1", "new"), ("c", "/3", "one"), ("c", "/4", "two")], kind)
    merged = {r.uid: (r.title, r.conflict) for r in tasks.merge_records(current, parsed).collect()}
    assert merged == {"a": ("new", False), "b": ("stays", False), "c": ("one", True)} and "b" not in {r.uid for r in tasks.merge_records(current, parsed, replacing=True).collect()}
    files = spark.createDataFrame([("a", "/x/1", 5, "/x/1", 9, False), ("a", "/y", 9, "/x/1", 9, False), ("b", "/z", 1, "/q", 2, True)], "uid string, path string, inode long, recorded_path string, recorded_inode long, unsure boolean")
    assert {r.path for r in tasks.carrier(files).where("carrier").collect()} == {"/x/1", "/z"}


def test_timelines_and_grounding(spark):
    turns = spark.createDataFrame([(1, 10, "question"), (2, 20, "answer")], "id long, s int, text string").withColumn("at", F.timestamp_seconds("s"))
    events = spark.createDataFrame([(7, 20, "edited")], "id long, s int, summary string").withColumn("at", F.timestamp_seconds("s"))
    assert [r.text for r in tasks.timeline(turns, events).collect()] == ["question", "edited", "answer"]
    said = spark.createDataFrame([(1, "the old house"), (1, "a new house")], "doc_id long, passage string")
    assert [r.grounded for r in tasks.contained(said, spark.createDataFrame([(1, "This House is old, the owner says")], "doc_id long, text string")).orderBy("passage").collect()] == [False, True]
    docs = spark.createDataFrame([([("type", "bill"), ("date", "2025-03-01")],)], "labels array<struct<kind:string,value:string>>")
    assert tuple(docs.select(*tasks.group_values(F.col("labels"), ["type", "date", "sender"])).first()) == ("bill", "2025", None)
    steps = spark.createDataFrame([("analyse", ("r", "secret"), 0), ("hash", ("r", "kept"), 0)], "stage string, output struct<result:string,exchange:string>, s int").withColumn("started_at", F.timestamp_seconds("s"))
    assert [r.output.exchange for r in observability.trim_steps(steps, "2020-01-01", ["analyse"]).collect()] == [None, "kept"]
    assert "filed" in filters.STATUSES["in_archive"]


def test_settling_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", 0, 5, 1.0, True, False), ("a", 2, 9, 2.0, True, False), ("a", 4, 9, 2.0, True, False), ("z", 0, 0, 1.0, True, False), ("z", 40, 0, 1.0, True, False), ("u", 0, 3, 1.0, False, False), ("u", 70, 3, 1.0, False, False), ("g", 0, 3, 1.0, True, False), ("g", 2, 3, 1.0, True, True)]
    schema = "path string, s int, size long, mtime double, readable boolean, gone boolean"
    spark.createDataFrame(rows, schema).withColumn("polled_at", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    stream = arrivals.settling(arrivals.arrivals(spark, str(tmp_path / "in"), schema + ", polled_at timestamp"))
    found = stream.writeStream.format("memory").queryName("settling").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    found.awaitTermination(180)
    assert {(r.path, r.event) for r in spark.table("settling").collect()} == {("a", "settled"), ("z", "settled"), ("u", "unopenable")}


def test_trimmed_json_keeps_its_types(spark):
    rows = [(1, '{"n":5,"ok":true,"o":{"x":1},"exchange":{"a":1}}'), (2, '{"n": 1.50}'), (3, "no json"), (4, None), (5, '[{"exchange":1}]')]
    steps = spark.createDataFrame(rows, "id int, output string").selectExpr("id", "output", "'analyse' AS stage", "timestamp'2020-01-01' AS started_at")
    assert {r.id: r.output for r in observability.trim_steps(steps, "2021-01-01", ["analyse"]).collect()} == {1: '{"n":5,"ok":true,"o":{"x":1}}', **dict(rows[1:])}


def test_readers_bear_damaged_files(spark):
    from dossier.sources import files

    content = [("a.csv", b'x;y\n"open quotation' + b" word" * 60_000), ("b.xlsx", b"PK\x03\x04 broken"), ("c.zip", b"PK\x05\x06" + b"\0" * 18 + b"junk"), ("d.eml", b"\xff\xfe\x00"), ("e.csv", b"")]
    frame = spark.createDataFrame([(n, bytearray(b), len(b)) for n, b in content], "path string, content binary, length long")
    found = {r.path: r for r in files.extract(frame).collect()}
    assert found["a.csv"].text.startswith("x\ty\nopen quotation word") and found["b.xlsx"].warnings == ["unreadable: BadZipFile"] and len(found) == 5


def test_deadline_of_a_reader():
    import time

    import pytest

    from dossier.sources import files

    with pytest.raises(TimeoutError), files.deadline(0.05):
        time.sleep(5)

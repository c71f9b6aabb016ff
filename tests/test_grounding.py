"""Grounding, answers, settings and records."""

from pyspark.sql import functions as F

from dossier.functions import grounding as G
from dossier.functions import settings as S
from dossier.sources import records

BODY = "EDP Comercial\nNIF 999 999 990\nInvoice of 2025 for Maria Silva"


def one(spark, column):
    return spark.createDataFrame([(BODY,)], "body string").select(column.alias("x")).first().x


def test_what_is_written(spark):
    words, numbers = G.written_words(F.col("body")), G.written_numbers(F.col("body"))
    assert one(spark, G.name_is_written(F.lit("Silva, Maria"), words)) and not one(spark, G.name_is_written(F.lit("Galp"), words))
    assert one(spark, G.number_is_written(F.lit("999999990"), numbers)) and not one(spark, G.number_is_written(F.lit("99"), numbers))
    assert one(spark, G.unwritten_share(F.lit("Invoice unheard"), words)) == 0.5 and one(spark, G.year_is_written(F.lit("2025-01-02"), words))


def test_answers(spark):
    answer = '{"labels":[{"kind":"sender","value":"EDP; Nobody"},{"kind":"date","value":"31.02.2025"},{"kind":"odd","value":"x"},{"kind":"reference","value":"999 999 990"}]}'
    row = G.validated(spark.createDataFrame([(answer, BODY), ("not json", BODY)], "answer string, body string")).collect()
    assert [(x.kind, x.value) for x in row[0].labels] == [("sender", "EDP"), ("reference", "999 999 990")] and row[0].notes == ["unknownKinds", "unreadable", "ungrounded"] and row[1].labels == []
    frame = spark.createDataFrame([("see [2] and [9]", [5, 6], [6, 7], ["a", "b"])], "a string, s array<int>, w array<int>, n array<string>")
    got = frame.select(G.cited(*[F.col(c) for c in "aswn"]).alias("c")).first().c
    assert (got.answer, got.sources) == ("see b and ", [6])
    assert [r.x for r in spark.createDataFrame([('{"same": true}',), ("?",)], "a string").select(G.judged(F.col("a")).alias("x")).collect()] == ["same", None]
    asked = G.ask(spark.createDataFrame([(1, "p")], "id long, prompt string"), lambda p: "good" if "could not be read" in p else "bad", lambda a: a == "good").first()
    assert (asked.answer, asked.attempts) == ("good", 2)


def test_settings():
    base = {"a": 1, "b": {"c": 2, "d": 3}}
    assert S.merged(base, {"a": None, "b": {"c": 5}}) == {"a": 1, "b": {"c": 5, "d": 3}} and S.difference(base, {"a": 1, "b": {"c": 5, "d": 3}}) == {"b": {"c": 5}}
    assert S.unknown_keys(base, {"b": {"x": 1}, "y": 2}) == ["b.x", "y"] and S.phrase_pattern(["due", "n. *"]) == r"n\.?\s*\S+|due"
    assert S.percent(0.934) == "93 %" and S.duration(0.25) == "250 ms" and S.duration(75) == "1 min 15 s"


def test_records(spark, tmp_path):
    docs = spark.createDataFrame([("u1", "2025-03", "body one"), ("u2", "2025-04", "body two")], "uid string, month string, body string")
    text = records.rendered({"uid": F.col("uid"), "none": F.lit(None)}, F.col("body"))
    records.write_records(docs, F.col("month"), text, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("month=*")) == ["month=2025-03", "month=2025-04"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.md").write_text("---\nuid: u1\ntitle: A b\n---\nthe body")
    row = records.read_records(spark, str(tmp_path / "r")).first()
    assert row.fields == {"uid": "u1", "title": "A b"} and row.body == "the body"
    kept = []
    assert records.rebuild(spark, str(tmp_path / "r"), lambda: 1, lambda found: kept.append(found.count())) and kept == [1]
    ticks = iter(range(99))
    assert not records.rebuild(spark, str(tmp_path / "r"), lambda: next(ticks), kept.append)


def test_bodies_are_read_once_and_by_many_tasks(spark):
    import __spark_entry__ as e

    rows = spark.createDataFrame([('{"labels":[{"kind":"reference","value":"AB 123"},{"kind":"sender","value":"Nowhere"}]}', "AB 12 3")], "answer string, body string")
    found = G.validated(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 3
    assert [tuple(x) for x in found.first().labels] == [("reference", "AB 123")] and found.first().notes == ["ungrounded"]
    for name in ("validated_answers", "checked_plans"):
        assert e.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4

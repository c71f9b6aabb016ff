"""Versions that change meanwhile, and marks."""

import pytest
from pyspark.sql import functions as F

from dossier.sources import snapshots
from dossier.sources.snapshots import Versions


def test_a_concurrent_change_makes_the_rebuild_repeat(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "id long, v string")
    assert table.read().count() == 0 and table.commit(spark.createDataFrame([(1, "a")], "id long, v string"), 0) == 1
    seen = []

    def made(now):
        seen.append(sorted(tuple(r) for r in now.collect()))
        if len(seen) == 1:  # another one adds a row while this one works
            other = Versions(spark, str(tmp_path / "t"), "id long, v string")
            other.commit(other.read().unionByName(spark.createDataFrame([(2, "b")], "id long, v string")), other.current())
        return now.withColumn("v", F.upper("v"))

    assert table.replace(made) == 3 and seen == [[(1, "a")], [(1, "a"), (2, "b")]]
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "A"), (2, "B")] and table.read(1).first().v == "a"
    with pytest.raises(snapshots.Changed):
        table.commit(table.read(1), 1)
    table.forget_before(3)
    assert table.read().count() == 2 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1


def test_a_table_that_always_changes_is_given_up(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "id long")
    row = spark.createDataFrame([(1,)], "id long")

    def made(now):
        table.commit(row, table.current())
        return now

    with pytest.raises(snapshots.Changed, match="each of 2"):
        table.replace(made, attempts=2)


def test_marks_of_records(spark, tmp_path):
    marks = Versions(spark, str(tmp_path / "marks"), snapshots.MARKS)
    keys = lambda *some: spark.createDataFrame([(k,) for k in some], "key string")
    snapshots.mark(marks, keys("a", "b", "gone", "a"))
    snapshots.mark(marks, keys("a"))
    assert {tuple(r) for r in marks.read().collect()} == {("a", 2), ("b", 1), ("gone", 1)}
    text, passes = {"a": "one", "b": "two"}, []

    def rendered(pending):
        found = sorted(r.key for r in pending.collect())
        passes.append(found)
        rows = [(k, f"{k}.md", bytearray(text[k].encode())) for k in found if k in text]
        if len(passes) == 1:  # a record changes while it is written
            text["b"] = "two, again"
            snapshots.mark(marks, keys("b"))
        return spark.createDataFrame(rows, "key string, name string, content binary")

    assert snapshots.flush(marks, rendered, str(tmp_path / "out")) == 3 and passes == [["a", "b", "gone"], ["b"]]
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "one", "b.md": "two, again"} and marks.read().count() == 0

"""Search, vocabulary, observability, tasks, sources and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier.operators import filters, observability, search, vocabulary
from dossier.plans import tasks
from dossier.sources import files
from dossier.streaming import arrivals


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  ", []), ('a"b', ['"a"', '"b"']), ("filename:fatura edp", ['filename : "fatura"', '"edp" *']), ('"nota de liquidação"', ['"nota de liquidação"']), ('jurisdiction:"Costa Rica"', ['jurisdiction : "Costa Rica"']),
        ("Party:silva", ['party : "silva" *']), ('before"a phrase"', ['"before"', '"a phrase"']), ('owner:"x y"', ['"owner"', '"x y"']), ('object:""', []), ('language:"pt', ['language : "pt"']),
    ],
)
def test_query_language(text, want):
    assert [str(p) for p in search.parse(text)] == want


def test_word_search_agrees_with_sqlite(spark):
    import sqlite3

    docs = [(1, "Fatura eletricidade", "período de faturação da EDP"), (2, "Выписка по счёту", "Sberbank выписка"), (3, "Meter reading", "meter meter of the house"), (4, "Electricity bill", "the bill of the house of EDP"), (5, "Passport", "nothing of it")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(filename, body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f (rowid, filename, body) VALUES (?, ?, ?)", docs)
    frame = spark.createDataFrame(docs, "doc_id long, filename string, body string")
    for text, match in (("FATURAÇÃO", '"FATURAÇÃO" *'), ("выпис", '"выпис" *'), ('"of the house"', '"of the house"'), ("filename:bill the", 'filename : "bill" AND "the" *'), ("meter", '"meter" *')):
        want = {i: -s for i, s in db.execute("SELECT rowid, bm25(f, 3.0, 1.0) FROM f WHERE f MATCH ?", (match,))}
        got = {r.doc_id: r.score for r in search.bm25(frame, {"filename": "filename", "body": "body"}, search.parse(text)).collect()}
        assert got == pytest.approx(want, rel=1e-6), text


def test_fusion_and_vectors(spark):
    words = spark.createDataFrame([(1, 2.0)], "doc_id long, score double")
    near = spark.createDataFrame([(2, 0.9), (3, 0.6), (4, 0.3)], "doc_id long, similarity double")
    assert [r.doc_id for r in search.fuse(words, near, floor=0.5).orderBy("place").collect()] == [1, 2, 3]
    vectors = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, [1.0]), (4, [])], "doc_id long, v array<float>")
    assert [r.doc_id for r in search.vector_top(search.modal_dimension(vectors, "v"), [1.0, 0.0], 5, "doc_id", "v").collect()] == [2, 1]
    back = vectors.select("doc_id", search.vector_of_bytes(search.bytes_of_vector("v")).alias("v")).collect()
    assert [list(r.v) for r in back] == [list(r.v) for r in vectors.collect()]
    assert search.gate("ab", True, True) == "short" and search.gate("abc", True, True) is None


def test_filters(spark):
    docs = spark.createDataFrame([(1, "filed", "/a/x"), (2, "failed", "/a/y"), (3, "filed", "/ab/z")], "doc_id long, status string, path string")
    labels = spark.createDataFrame([(1, "sender", "EDP-Comercial, S.A."), (1, "type", "bill"), (3, "sender", "EDP")], "doc_id long, kind string, value string")
    chosen = filters.DocumentFilter(statuses=["filed"], labels=[("sender", "edp comercial SA"), ("type", "Bill")], within="/a")
    assert [r.doc_id for r in chosen.apply(docs, labels).collect()] == [1]
    assert [r.doc_id for r in filters.DocumentFilter(labels=[("sender", "no one")]).apply(docs, labels).collect()] == []
    assert [r.doc_id for r in filters.in_order_of(docs, [3, 1]).orderBy("position").collect()] == [3, 1]


@pytest.mark.parametrize(
    ("a", "b", "same", "alike"),
    [
        ("EDP-Comercial, S.A.", "edp comercial SA", True, 1.0), ("Silva, Maria", "Maria Silva", True, 1.0), ("Ｅｄｐ", "EDP", True, 1.0), ("FT 1/23", "FT 12/3", False, 0.0), ("Rua das Flores 12, 3", "Rua das Flores 3, 12", False, 0.0),
        ("car AB 12 CD", "car CD 12 AB", False, None), ("NIF 123 456 789", "NIF 123456789", True, 1.0), ("MARTHA", "MARHTA", False, 0.961), ("DWAYNE", "DUANE", False, 0.840), ("DIXON", "DICKSONX", False, 0.813),
    ],
)
def test_similarity(a, b, same, alike):
    ka, kb = vocabulary.comparison_key(a), vocabulary.comparison_key(b)
    assert (ka[0] == kb[0] and (ka[2] == kb[2] or ka[3] == kb[3])) is same
    if alike is not None:
        assert (0.0 if ka[0] != kb[0] else 1.0 if same else vocabulary.jaro_winkler(ka[3], kb[3])) == pytest.approx(alike, abs=6e-4)


def test_vocabulary(spark):
    rows = [("reference", "V/2026/532774"), ("reference", "V2026532774"), ("sender", "Galp Energia"), ("sender", "Galp Energias"), ("sender", "Unrelated Ltd")]
    labels = spark.createDataFrame(rows, "kind string, value string")
    found = {(r.a, r.b, r.regrouping) for r in vocabulary.look_alikes(labels).collect()}
    assert found == {("V/2026/532774", "V2026532774", True), ("Galp Energia", "Galp Energias", False)}
    fresh = labels.where("value = 'Galp Energia'")
    assert [(r.a, r.b) for r in vocabulary.look_alikes(labels, fresh).collect()] == [("Galp Energia", "Galp Energias")]
    used = spark.createDataFrame([("sender", "EDP", 5), ("sender", "edp", 1)], "kind string, value string, documents long")
    assert [tuple(r) for r in vocabulary.align(used.where("value = 'edp'"), used).collect()] == [("sender", "edp", "EDP")]
    assert vocabulary.resolve_rules([("s", "a", "merge", "b"), ("s", "b", "merge", "a"), ("s", "c", "ignore", None)]) == {("s", "a"): "a", ("s", "b"): "b", ("s", "c"): None}
    docs = spark.createDataFrame([(1, [("sender", "Silva, Maria"), ("type", "x")]), (2, [("sender", "Other")])], "doc_id long, labels array<struct<kind:string,value:string>>")
    got = vocabulary.relabel(docs, "sender", "Maria Silva", "M. Silva").collect()
    assert [(r.doc_id, [tuple(x) for x in r.labels]) for r in got] == [(1, [("sender", "M. Silva"), ("type", "x")])]


def test_length_bound_never_underestimates(spark):
    words = ["", "a", "ab", "abc", "abcd", "martha", "marhta", "dixon", "dicksonx"]
    rows = [(a, b, vocabulary.jaro_winkler(a, b)) for a in words for b in words]
    frame = spark.createDataFrame(rows, "a string, b string, s double")
    assert frame.where(vocabulary.most_possible(F.col("a"), F.col("b")) < F.col("s") - 1e-9).count() == 0


def test_percentiles_and_funnel(spark):
    rows = spark.createDataFrame([("s", float(x)) for x in (1, 2, 3, 4)], "stage string, ms double")
    assert rows.groupBy("stage").agg(observability.nearest_rank(F.col("ms"), 0.5).alias("p")).first().p == 3.0
    assert observability.latencies(rows, "stage", "ms", {"p50": 0.5}).first().p50 == 3.0
    docs = spark.createDataFrame([(1, "filed"), (2, "failed"), (3, "duplicate")], "id long, status string")
    traces = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, doc_id long")
    steps = spark.createDataFrame([(10, "hash", "ok", 1.0), (10, "name", "ok", 2.0), (20, "extract", "error", 5.0), (30, "dedupe", "ok", 1.0)], "trace_id long, stage string, status string, duration_ms double")
    got = observability.funnel(docs, traces, steps).orderBy("step_index").collect()
    assert [(r.reached, r.passed, r.stopped) for r in got] == [(3, 3, 0), (3, 2, 1), (2, 1, 1), (1, 1, 0), (1, 1, 0), (1, 1, 0)]
    assert observability.funnel_summary(observability.funnel(docs, traces, steps)).first().main_stop == "deduplicated"


def test_evaluation(spark):
    kind = "e string, labels array<struct<kind:string,value:string>>, k string"
    rows = [("72.00 EUR", [("amount", "72 EUR")], "amount"), ("72.00 EUR", [("amount", "72.01 EUR")], "amount"), ("2026-02", [("period", "2026-02-01/2026-02-28")], "period"), ("CPE PT0002|contador", [("object", "Contador 123")], "object")]
    frame = spark.createDataFrame(rows, kind)
    assert [r.x for r in frame.select(observability.label_found(F.col("e"), F.col("labels"), F.col("k")).alias("x")).collect()] == [True, False, True, True]


def test_tasks(spark):
    docs = spark.createDataFrame(
        [(1, [("date", "2025-03-05"), ("sender", "EDP Comercial"), ("language", "pt")]), (2, [("period", "2024-07/2025-06"), ("sender", "Galp")]), (3, [("sender", "EDP")])], "doc_id long, labels array<struct<kind:string,value:string>>"
    )
    ids = lambda plan: [r.doc_id for r in plan.documents(docs, {}).collect()]
    assert ids(tasks.SearchPlan(labels=[("sender", "edp"), ("sender", "galp")])) == [1, 2, 3]
    assert ids(tasks.SearchPlan(labels=[("date", "2025"), ("sender", "edp")])) == [1] and ids(tasks.SearchPlan(labels=[("period", "2025")])) == [2] and ids(tasks.SearchPlan()) == []
    rows = spark.createDataFrame([(1, 1, 1, 900), (1, 2, 2, 300), (1, 3, 3, 100)], "question long, doc_id long, place int, chars long")
    assert [(r.doc_id, r.use) for r in tasks.pack_context(rows, budget=1000).orderBy("doc_id").collect()] == [(1, "shown"), (2, "listed"), (3, "shown")]
    index = spark.createDataFrame([("a", "/1", 1, 10), ("b", "/2", 2, 20), ("c", "/3", 3, 30)], "uid string, path string, inode long, size long")
    found = spark.createDataFrame([("a", "/1", 1, 10), ("b", "/9", 7, 20), (None, "/8", 3, 30), (None, "/7", 8, 1)], "uid string, path string, inode long, size long")
    assert sorted((r.path, r.fate) for r in tasks.reconcile(index, found).collect()) == [("/1", "kept"), ("/7", "new"), ("/8", "moved"), ("/9", "moved")]


def zipped(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return data.getvalue()


def test_readers(spark, tmp_path):
    sheet = zipped({
        "xl/workbook.xml": "<workbook><sheets><sheet name='S'/></sheets></workbook>", "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>",
        "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>",
    })
    mail = b"Subject: =?utf-8?q?Ol=C3=A1?=\r\nFrom: a@b.c\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>caf=C3=A9</p>\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=f.pdf\r\n\r\n1\r\n--x--\r\n"
    parts = {"a.csv": b'h;"two\nlines"\n1;2\n', "b.xlsx": sheet, "c.eml": mail, "d.zip": zipped({"x.txt": "abc", "__MACOSX/y": "1"}), "e.txt": "Это письмо о поставке товаров".encode("koi8-r"), "f.md": b"---\nuid: 7\ntags:\n  - a\n  - b\n---\nbody", "g.docx": b"broken"}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.csv"].text == "h\ttwo lines\n1\t2" and got["b.xlsx"].text == "## S\nhead\t5" and got["c.eml"].text == "café" and got["c.eml"].metadata["subject"] == "Olá" and got["c.eml"].metadata["attachments"] == "f.pdf"
    assert got["d.zip"].text == "x.txt\t3" and got["e.txt"].metadata["encoding"] == "koi8-r" and got["f.md"].metadata == {"uid": "7", "tags": "a, b"} and got["g.docx"].warnings[0].startswith("unreadable")
    paths = spark.createDataFrame([("/in/tax/a.pdf",), ("/in/.hid",), ("/in/_x.md",), ("/in/b.part",)], "p string")
    assert [tuple(r) for r in paths.select(files.skip_reason(F.col("p")), files.folder_tag(F.col("p"), "/in")).collect()] == [(None, "tax"), ("prefix", None), ("managed", None), ("extension", None)]


def test_settling_and_streams(spark, tmp_path):
    polls = [("a", 0, 5, 1.0, True), ("a", 2, 9, 2.0, True), ("a", 4, 9, 2.0, True), ("a", 6, 9, 2.0, True), ("b", 0, 1, 1.0, True)]
    frame = spark.createDataFrame(polls, "path string, s int, size long, mtime double, readable boolean").withColumn("polled_at", F.timestamp_seconds("s")).withColumn("gone", F.lit(False))
    got = arrivals.settled(frame).collect()
    assert [(r.path, r.size) for r in got] == [("a", 9)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "sha256 string, s int").withColumn("at", F.timestamp_seconds("s"))
    events.write.parquet(source)
    stream = arrivals.without_copies(arrivals.arrivals(spark, source, "sha256 string, s int, at timestamp"))
    arrivals.into(stream, str(tmp_path / "state"), arrivals.snapshot_writer(out)).awaitTermination(120)
    assert sorted(r.sha256 for r in spark.read.parquet(out).collect()) == ["x", "y"]
    again = arrivals.windowed(arrivals.arrivals(spark, source, "sha256 string, s int, at timestamp"), "at", ["sha256"], size="1 day", slide="1 day")
    found = again.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    found.awaitTermination(120)
    assert {(r.sha256, r.n) for r in spark.table("w").collect()} == {("x", 2), ("y", 1)}


def test_index_agrees_with_sqlite(spark, tmp_path):
    """Words, prefixes, phrases and fields from the stored index, before and after documents change."""
    import sqlite3

    from dossier.operators import postings

    fields = {"filename": "filename", "body": "body"}
    docs = [(1, "Fatura eletricidade", "período de faturação da EDP"), (2, "Выписка по счёту", "Sberbank выписка"), (3, "Meter reading", "meter meter of the house"), (4, "Electricity bill", "the bill of the house of EDP"), (5, "Passport", None), (6, None, "the house of the house of the house"), (7, "a", "of the, of the. of")]
    schema = "doc_id long, filename string, body string"
    queries = (("FATURAÇÃO", '"FATURAÇÃO" *'), ("выпис", '"выпис" *'), ('"of the house"', '"of the house"'), ("filename:bill the", 'filename : "bill" AND "the" *'), ("meter", '"meter" *'), ('body:"house of"', 'body : "house of"'), ('"of the hou', '"of the hou"'), ("ho", '"ho" *'), ('the "of the"', '"the" AND "of the"'))

    def agree(index, rows):
        db = sqlite3.connect(":memory:")
        db.execute("CREATE VIRTUAL TABLE f USING fts5(filename, body, tokenize='unicode61 remove_diacritics 2')")
        db.executemany("INSERT INTO f (rowid, filename, body) VALUES (?, ?, ?)", rows)
        for text, match in queries:
            want = {i: -s for i, s in db.execute("SELECT rowid, bm25(f, 3.0, 1.0) FROM f WHERE f MATCH ?", (match,))}
            got = {r.doc_id: r.score for r in postings.bm25(index, search.parse(text)).collect()}
            assert got == pytest.approx(want, rel=1e-6), text

    index = postings.build(spark.createDataFrame(docs, schema), fields, str(tmp_path / "i"), partitions=3)
    agree(index, docs)
    anew = [(3, "Gas bill", "of the house"), (9, "House", "the meter of the meter")]
    index = postings.append(index, spark.createDataFrame(anew, schema), fields, removed=spark.createDataFrame([(6,), (3,), (77,)], "doc_id long"), partitions=2)
    agree(index, [d for d in docs if d[0] not in (3, 6)] + anew)


def test_index_reads_only_its_terms(spark, tmp_path):
    """The scan's filters name the folder and the term; repeated ids, null ids and empty tables have their results."""
    from dossier.operators import postings

    rows = [(i, f"word{i} common") for i in range(500)] + [(7, "again word7"), (None, "word7")]
    index = postings.build(spark.createDataFrame(rows, "doc_id long, body string"), {"body": "body"}, str(tmp_path / "i"), partitions=4)
    found = postings.bm25(index, search.parse('"word7"'))
    assert [r.doc_id for r in found.collect()] == [7]
    plan = postings._rows(index.read("postings"), search.parse('"word7"'))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "EqualTo(term,word7)" in plan
    none = postings.build(spark.createDataFrame([], "doc_id long, body string"), {"body": "body"}, str(tmp_path / "e"))
    assert postings.bm25(none, search.parse("word")).count() == 0 and postings.bm25(index, search.parse("...")).count() == 0


def test_equal_rounded_scores_are_ties(spark, tmp_path):
    """Within a set, scores that are equal as shown are ties, which the key decides; without digits the longer number does."""
    from dossier.operators import postings

    # Texts of 100,000 and 99,990 words differ in the score beyond the sixth digit.
    docs = spark.createDataFrame([(1, "onen " + "x " * 99_999), (2, "onen " + "x " * 99_989), (3, "y " * 200_000)], "doc_id long, text string")
    index = postings.build(docs, {"body": "text"}, str(tmp_path / "i"))
    vectors = spark.createDataFrame([(9, [1.0])], "doc_id long, embedding array<float>")
    order = lambda **more: [r.doc_id for r in postings.within_set(index, search.parse_any("onen"), vectors, [0.0], docs, **more).orderBy("place").collect()]
    assert order() == [2, 1] and order(digits=(6, 5)) == [1, 2]


def test_index_rows_are_packed(spark, tmp_path):
    """A term's documents share rows of bounded blocks, whose places stay apart; a listing without a term makes no index."""
    from dossier.operators import postings

    docs = spark.createDataFrame([(i, "common " * (i % 3 + 1) + f"word{i} common") for i in range(3000)], "doc_id long, body string").coalesce(1)
    index = postings.build(docs, {"body": "body"}, str(tmp_path / "i"), partitions=2)
    held = index.read("postings").where("term = 'common'")
    assert held.count() < 10 and held.selectExpr("sum(size(docs))").first()[0] == 3000
    found = postings._rows(index.read("postings"), search.parse('"common"')).select("doc_id", "dl", "places").collect()
    assert {(r.doc_id, r.dl, tuple(r.places)) for r in found} == {(i, i % 3 + 3, (*range(i % 3 + 1), i % 3 + 2)) for i in range(3000)}

    def unmade():
        raise AssertionError

    assert [r.doc_id for r in postings.listing(unmade, docs, " ", [], F.col("doc_id"), 2).collect()] == [2999, 2998]

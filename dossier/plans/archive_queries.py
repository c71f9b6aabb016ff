"""Queries of the vocabulary's actions, of languages and of record snapshots, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.functions import labels as L
from dossier.functions import language, text
from dossier.operators import actions, observability, postings, search, vocabulary
from dossier.plans import answers, tasks
from dossier.plans.adapters import LABELS_SQL, dealt, labels, table
from dossier.plans.more_queries import _expectations as expectations
from dossier.plans.registry import query
from dossier.sources import files, packages, records, snapshots
from dossier.streaming.arrivals import shared_folder

_JARO = "jaro_similarity(a.s, b.s) + len(list_filter(range(1, 5), lambda i: i <= length(a.s) AND i <= length(b.s) AND a.s[1:i] = b.s[1:i])) * 0.1 * (1 - jaro_similarity(a.s, b.s))"


@query("aligned_labels", f"""WITH used AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), fresh AS (SELECT DISTINCT left(p_name, length(p_name) - 1) AS v FROM part),
k AS (SELECT v, array_to_string(list_sort(regexp_extract_all(lower(v), '[\\p{{L}}\\p{{N}}]+')), ' ') AS s FROM (SELECT v FROM used UNION SELECT v FROM fresh)),
p AS (SELECT a.v, b.v AS into_, u.n, {_JARO} AS similarity FROM fresh f JOIN k a ON a.v = f.v LEFT JOIN used own ON own.v = f.v JOIN k b ON b.v <> a.v JOIN used u ON u.v = b.v WHERE own.v IS NULL)
SELECT v AS value, arg_min(into_, (-round(similarity, 9), -n, into_)) AS into_ FROM p WHERE similarity >= 0.96 GROUP BY v""")
def aligned_labels(spark, sf_dir):
    """VOC10: names with a letter less, written as the vocabulary has them."""
    part = table(spark, sf_dir, "part")
    used = part.groupBy(F.lit("topic").alias("kind"), F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("documents"))
    fresh = part.select(F.lit("topic").alias("kind"), F.expr("left(p_name, length(p_name) - 1)").alias("value"))
    return vocabulary.align(fresh, used).select("value", F.col("into").alias("into_"))


def _archive(spark, sf_dir) -> actions.Archive:
    """Documents with their labels, and what was decided of them in eight steps."""
    held = labels(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("kind", "value"))).alias("labels"))  # of one document
    docs = held.select("doc_id", "labels", F.filter("labels", lambda x: x["kind"] == "sender").alias("by_hand"), F.lit(False).alias("tags_only"))
    archive = actions.Archive(docs)
    for step in (
        lambda a: actions.merge(a, "sender", "SRC1", "src3"),
        lambda a: actions.ignore(a, "topic", "toxic 1"),
        lambda a: actions.rename(a, "topic", "quality:1", "good"),
        lambda a: actions.keep_apart(a, "sender", "src2", "src4"),
        lambda a: actions.add(a, "tag", "house"),
        lambda a: actions.remove(a, "language", "fr"),
        lambda a: actions.rename(a, "sender", "src3", "third"),
        lambda a: actions.forget(a, next(r.id for r in a.rules if r.action == "add")),
    ):
        archive = step(archive).archive
    return archive


_ACTED = f"""{LABELS_SQL}, acted AS (SELECT DISTINCT doc_id, kind, CASE WHEN kind = 'sender' AND value IN ('src1', 'src3') THEN 'third' WHEN kind = 'topic' AND value = 'quality:1' THEN 'good' ELSE value END AS value
FROM labelled WHERE NOT (kind = 'topic' AND value = 'toxic:1') AND NOT (kind = 'language' AND value = 'fr'))"""


@query("label_actions", f"WITH {_ACTED} SELECT doc_id, kind, value FROM acted")
def label_actions(spark, sf_dir):
    """VOC13: the labels of every document after all the actions."""
    return _archive(spark, sf_dir).documents.select("doc_id", F.inline("labels"))


@query("label_action_events", f"""WITH {LABELS_SQL}, n AS (SELECT count(DISTINCT doc_id) FILTER (kind = 'sender' AND value = 'src1') AS a, count(DISTINCT doc_id) FILTER (kind = 'topic' AND value = 'toxic:1') AS b, count(DISTINCT doc_id) FILTER (kind = 'topic' AND value = 'quality:1') AS c, count(DISTINCT doc_id) FILTER (kind = 'language' AND value = 'fr') AS d, count(DISTINCT doc_id) FILTER (kind = 'sender' AND value IN ('src1', 'src3')) AS e FROM labelled)
SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7])::INT AS seq, unnest(['labelsMerged', 'labelIgnored', 'labelsMerged', 'labelsKeptApart', 'labelAdded', 'labelRemoved', 'labelsMerged', 'labelRuleForgotten']) AS kind, unnest([a, b, c, 0, 0, d, e, 0]) AS documents FROM n""")
def label_action_events(spark, sf_dir):
    """VOC13, VOC11: what was recorded of each action, and how many documents it changed."""
    return _archive(spark, sf_dir).events_table().select("seq", "kind", "documents")


@query("label_action_rules", "SELECT * FROM (VALUES ('sender', 'SRC1', 'merge', 'third'), ('topic', 'toxic 1', 'ignore', NULL), ('topic', 'quality:1', 'merge', 'good'), ('sender', 'src2', 'keepApart', 'src4'), ('sender', 'src3', 'merge', 'third')) r(kind, value, action, target) WHERE EXISTS (SELECT 1 FROM documents)")
def label_action_rules(spark, sf_dir):
    """VOC13, VOC9: the rules that the actions leave: what led to a renamed label follows it."""
    return _archive(spark, sf_dir).rules_table().drop("id")


_GRAMS = "WITH w AS (SELECT doc_id, lang, doc_id % 2 = 1 AS held_out, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS words FROM documents), u AS (SELECT doc_id, lang, held_out, ' ' || unnest(words) || ' ' AS p FROM w), g AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, length(p) - 1), lambda i: p[i:i + 2])) AS gram FROM u)"


@query("guessed_languages", _GRAMS + """, l AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) - 1 AS place FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY place < 300),
d AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) - 1 AS place FROM g WHERE held_out GROUP BY doc_id, gram QUALIFY place < 300),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT n.doc_id, langs.lang, power(1 - (sum(CASE WHEN l.place IS NULL THEN 300 ELSE abs(d.place - l.place) END)) / (300.0::DOUBLE * any_value(n.n)), 12) AS near FROM n CROSS JOIN (SELECT DISTINCT lang FROM l) langs JOIN d ON d.doc_id = n.doc_id LEFT JOIN l ON l.lang = langs.lang AND l.gram = d.gram GROUP BY ALL),
b AS (SELECT doc_id, arg_min(lang, (-near, lang)) AS best, max(near) / sum(near) AS share FROM s GROUP BY 1)
SELECT w.doc_id, CASE WHEN len(words) = 0 THEN 'und' WHEN share >= CASE WHEN len(words) < 4 THEN 0.9 ELSE 0.5 END THEN best ELSE 'other' END AS language, round(coalesce(share, 0), 6) AS confidence FROM w LEFT JOIN b ON b.doc_id = w.doc_id WHERE held_out""")
def guessed_languages(spark, sf_dir):
    """TXT6: languages of the documents of odd ids, learned from the others."""
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where("doc_id % 2 = 0"))
    return language.detect(docs.where("doc_id % 2 = 1").select("doc_id", "text"), profiles).select("doc_id", "language", F.round("confidence", 6).alias("confidence"))


def _written(spark, rows, kind: str, write=packages.write_files) -> str:
    """(name, content) rows as files of a new folder of the shared one."""
    folder = f"{shared_folder(spark)}/dossier-{kind}-{uuid.uuid4().hex}"
    write(rows, folder)
    return folder


@query("zip_listing", """WITH c AS (SELECT c_custkey, c_custkey // 50 AS archive, c_custkey % 100 AS size FROM customer), t AS (SELECT archive, count(*)::INT AS entries, sum(size)::DOUBLE AS total FROM c GROUP BY 1)
SELECT archive, 'c/' || c_custkey || '.txt' AS name, size::DOUBLE AS size, entries, total, NULL AS problem FROM c JOIN t USING (archive) WHERE archive % 7 <> 3 UNION ALL SELECT archive, NULL, NULL, NULL, NULL, 'no end of a central directory' FROM t WHERE archive % 7 = 3""")
def zip_listing(spark, sf_dir):
    """SRC14: archives of fifty customers each, listed from their directories; every seventh is cut off and refused."""
    spark.dataSource.register(packages.ArchiveEntries)
    key = F.col("c_custkey")
    part = F.struct(F.concat(F.lit("c/"), key.cast("string"), F.lit(".txt")).alias("name"), F.repeat(F.lit("x"), (key % 100).cast("int")).alias("text"))
    held = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 50").alias("archive")).agg(F.collect_list(part).alias("parts"))  # fifty
    junk = F.array(F.struct(F.lit("__MACOSX/._c").alias("name"), F.lit("junk").alias("text")))
    rows = held.select(F.concat(F.col("archive").cast("string"), F.lit(".zip")).alias("name"), F.concat(junk, F.array_sort("parts")).alias("parts"), F.when(F.col("archive") % 7 == 3, 40).alias("bytes"))
    found = spark.read.format("archive_entries").option("path", _written(spark, rows, "archives", packages.write_archives)).load()
    number = F.regexp_extract("path", "([0-9]+)[.]zip$", 1).cast("long")
    return found.select(number.alias("archive"), "name", F.col("size").cast("double").alias("size"), "entries", F.col("total").cast("double").alias("total"), "problem")


_REL = '<Relationship Id="{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'


@query("workbook_cells", """WITH o AS (SELECT o_orderkey, o_orderkey // 40 AS book, o_orderkey % 2 AS half, o_orderdate, o_totalprice FROM orders)
SELECT book, CASE half WHEN 0 THEN 'even' ELSE 'odd' END AS sheet, (o_orderkey % 40 + 1)::INT AS row, o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::VARCHAR AS serial, o_orderkey % 100 || '%' AS share FROM o""")
def workbook_cells(spark, sf_dir):
    """SRC10: workbooks of forty orders in two sheets, found by their relationships, with dates and percentages as shown."""
    spark.dataSource.register(packages.WorkbookRows)
    key, text = F.col("o_orderkey"), lambda c: c.cast("string")
    cell = lambda column, style, value: F.concat(F.lit(f'<c r="{column}'), text(key % 40 + 1), F.lit(f'" s="{style}"><v>'), value, F.lit("</v></c>"))
    serial = text(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")))
    row = F.concat(F.lit('<row r="'), text(key % 40 + 1), F.lit('">'), cell("A", 0, text(key)), cell("C", 1, serial), cell("D", 2, text((key % 100) / 100)), F.lit("</row>"))
    sheet = lambda half: F.concat(F.lit("<worksheet><sheetData>"), F.array_join(F.array_sort(F.collect_list(F.when(key % 2 == half, row))), ""), F.lit("</sheetData></worksheet>"))
    books = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 40").alias("book")).agg(sheet(0).alias("even"), sheet(1).alias("odd"))  # of forty rows
    fixed = {
        "_rels/.rels": "<Relationships>" + _REL.format("r1", "officeDocument", "xl/workbook.xml") + "</Relationships>",
        "xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="even" r:id="r8"/><sheet name="odd" r:id="r3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>" + _REL.format("r3", "worksheet", "worksheets/sheet1.xml") + _REL.format("r8", "worksheet", "worksheets/sheet2.xml") + _REL.format("r2", "styles", "styles.xml") + "</Relationships>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>',
    }
    part = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("text"))
    parts = F.array(*[part(n, F.lit(t)) for n, t in fixed.items()], part("xl/worksheets/sheet1.xml", F.col("odd")), part("xl/worksheets/sheet2.xml", F.col("even")))
    rows = books.select(F.concat(text(F.col("book")), F.lit(".xlsx")).alias("name"), parts.alias("parts"))
    found = spark.read.format("workbook_rows").option("path", _written(spark, rows, "workbooks", packages.write_archives)).load()
    number = F.regexp_extract("path", "([0-9]+)[.]xlsx$", 1).cast("long")
    return found.select(number.alias("book"), "sheet", "row", F.get("shown", F.lit(0)).cast("long").alias("key"), F.get("shown", F.lit(2)).alias("day"), F.get("cells", F.lit(2)).alias("serial"), F.get("shown", F.lit(3)).alias("share"))


@query("rebuilt_index", "SELECT o_orderkey AS id, o_orderstatus || CASE WHEN o_orderkey % 10 = 0 THEN '+' ELSE '' END AS status, 2 AS tries FROM orders WHERE o_orderkey % 10 <> 9")
def rebuilt_index(spark, sf_dir):
    """PIP20: an index is rebuilt from a snapshot, changes meanwhile, and is rebuilt once more from what it is then."""
    index = snapshots.Versions(spark, f"{shared_folder(spark)}/dossier-versions-{uuid.uuid4().hex}", "id long, status string")
    index.commit(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), 0)
    tries = []

    def made(now):
        tries.append(1)
        if len(tries) == 1:
            index.commit(index.read().where("id % 10 <> 9"), index.current())
        return now.withColumn("status", F.when(F.col("id") % 10 == 0, F.concat("status", F.lit("+"))).otherwise(F.col("status")))

    index.replace(made)
    return index.read().withColumn("tries", F.lit(len(tries)))


@query("flushed_records", "SELECT s_suppkey, 'supplier: ' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN ', again' ELSE '' END AS text FROM supplier")
def flushed_records(spark, sf_dir):
    """SNK4: a record file for every marked supplier; those that change while they are written are written again."""
    folder = f"{shared_folder(spark)}/dossier-records-{uuid.uuid4().hex}"
    marks = snapshots.Versions(spark, f"{folder}/marks", snapshots.MARKS)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), "s_suppkey", "s_name")
    snapshots.mark(marks, rows)
    passes = []

    def rendered(pending):
        passes.append(1)
        again = F.when((F.col("s_suppkey") % 3 == 0) & F.lit(len(passes) > 1), ", again").otherwise("")
        found = rows.join(pending, "key").select("key", F.concat("key", F.lit(".md")).alias("name"), F.encode(F.concat(F.lit("supplier: "), "s_name", again), "UTF-8").alias("content"))
        if len(passes) == 1:
            snapshots.mark(marks, rows.where("s_suppkey % 3 = 0"))
        return found

    snapshots.flush(marks, rendered, f"{folder}/files")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{folder}/files")
    return files.select(F.regexp_extract("path", "([0-9]+)[.]md$", 1).cast("long").alias("s_suppkey"), F.decode("content", "UTF-8").alias("text"))


@query("grouping_folded", """WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS s, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (1990 + p_partkey % 7)::VARCHAR END AS y FROM part),
k AS (SELECT *, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS ks FROM d),
a AS (SELECT ks, arg_min(s, p_partkey) AS sender, count(*) AS documents FROM k GROUP BY ks), b AS (SELECT ks, y, count(*) AS documents FROM k GROUP BY ks, y),
r AS (SELECT 1 AS depth, sender, NULL::VARCHAR AS date, documents, ks, 0 AS o FROM a UNION ALL SELECT 2, a.sender, b.y, b.documents, b.ks, 1 FROM b JOIN a ON a.ks IS NOT DISTINCT FROM b.ks)
SELECT depth::INT AS depth, sender, date, documents, row_number() OVER (ORDER BY sender IS NULL, regexp_extract(ks, '[0-9]+')::INT, o, date IS NULL, date DESC) AS place FROM r""")
def grouping_folded(spark, sf_dir):
    """AGG16: senders in several writings, years downwards, what has neither last."""
    key = F.col("p_partkey")
    sender = F.when(key % 4 == 0, None).when(key % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    year = F.when(key % 5 != 0, (1990 + key % 7).cast("string"))
    docs = table(spark, sf_dir, "part").select(key.alias("doc_id"), sender.alias("sender_label"), year.alias("year_label"))
    return tasks.folded_groups(docs, [("sender", "sender_label"), ("date", "year_label")]).select("depth", "sender", "date", "documents", "place")


@query("office_texts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || p_brand ELSE 'slide of ' || p_name || chr(10) || 'note ' || p_brand || chr(10) || 'second' END AS text FROM part")
def office_texts(spark, sf_dir):
    """SRC11, SRC12: paragraphs of a document, and of slides with their notes."""
    para = lambda *runs: F.concat(F.lit("<p>"), *[x for r in runs for x in (F.lit("<r><t>"), r, F.lit("</t></r>"))], F.lit("</p>"))
    part = lambda name, *body: F.struct(F.lit(name).alias("name"), F.concat(F.lit("<doc>"), *body, F.lit("</doc>")).alias("text"))
    words = F.array(part("word/document.xml", para(F.col("p_name")), para(F.col("p_brand"))))
    slides = F.array(part("ppt/slides/slide10.xml", para(F.lit("second"))), part("ppt/slides/slide2.xml", para(F.lit("slide of "), F.col("p_name"))), part("ppt/notesSlides/notesSlide2.xml", para(F.lit("note "), F.col("p_brand"))))
    even = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf_dir, "part").withColumn("content", packages.zip_of(F.when(even, words).otherwise(slides)))
    found = files.extract(rows.select(F.concat(F.col("p_partkey").cast("string"), F.when(even, ".docx").otherwise(".pptx")).alias("path"), "content", F.octet_length("content").alias("length")))
    return found.select(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("p_partkey"), "text")


@query("read_logs", "SELECT event_id, event_type AS category FROM events WHERE value > 20 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-10'")
def read_logs(spark, sf_dir):
    """SRC18: JSON lines of one category, of a least level, since a time."""
    folder = f"{shared_folder(spark)}/dossier-read-logs-{uuid.uuid4().hex}"
    level = F.when(F.col("value") > 20, "warning").otherwise("info")
    lines = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("at"), level.alias("level"), F.col("event_type").alias("category"), F.col("event_id").cast("string").alias("message"))
    table(spark, sf_dir, "events").select(F.to_json(lines)).write.text(folder)
    return files.logs(spark, folder, "click", "warning", "2024-01-10").select(F.col("message").cast("long").alias("event_id"), "category")


@query("most_alike_names", f"""WITH n AS (SELECT DISTINCT p_name AS v FROM part), k AS (SELECT v, array_to_string(list_sort(string_split(lower(v), ' ')), ' ') AS s FROM n), a AS (SELECT * FROM k WHERE v = (SELECT min(v) FROM n)), p AS (SELECT b.v, CASE WHEN a.s = b.s THEN 1.0 ELSE {_JARO} END AS similarity FROM a JOIN k b ON b.v <> a.v)
SELECT v AS value, round(similarity, 6) AS similarity FROM p ORDER BY p.similarity DESC, v LIMIT 8""")
def most_alike_names(spark, sf_dir):
    """RNK7: the names most like the first one, the earlier of equals."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    first = names.agg(F.min("value").alias("v")).first()["v"]
    return vocabulary.most_alike(first, names.withColumn("position", F.col("value")), 8).select("value", F.round("similarity", 6).alias("similarity"))


@query("decoded_entities", "SELECT p_partkey, p_name || ' & <' || p_brand || '> é ' || chr(960) || ' &nosuch; &amp' AS text FROM part")
def decoded_entities(spark, sf_dir):
    """TXT4: named, decimal and hexadecimal entities; unknown ones and those without a semicolon stay."""
    written = F.concat(F.col("p_name"), F.lit(" &amp; &lt;"), F.col("p_brand"), F.lit("&gt; &eacute; &#x3c0; &nosuch; &amp"))
    return table(spark, sf_dir, "part").select("p_partkey", text.entities(written).alias("text"))


@query("decoded_bytes", "SELECT c_custkey, c_name || ' àéîõü' AS text, CASE c_custkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' ELSE 'utf-16' END AS encoding FROM customer")
def decoded_bytes(spark, sf_dir):
    """TXT5: texts of three encodings, told by their bytes."""
    written, n = F.concat("c_name", F.lit(" àéîõü")), F.col("c_custkey") % 3
    data = F.when(n == 0, F.encode(written, "UTF-8")).when(n == 1, F.encode(written, "ISO-8859-1")).otherwise(F.encode(written, "UTF-16"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.decoded(data).alias("d")).select("c_custkey", "d.text", "d.encoding")


@query("merge_suggestions", f"""WITH used AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), k AS (SELECT v, n, array_to_string(list_sort(string_split(lower(v), ' ')), ' ') AS s FROM used),
p AS (SELECT a.v AS a, b.v AS b, a.n AS na, b.n AS nb, CASE WHEN a.s = b.s THEN 1.0 ELSE {_JARO} END AS similarity FROM k a JOIN k b ON a.v < b.v)
SELECT CASE WHEN na >= nb THEN b ELSE a END AS value, CASE WHEN na >= nb THEN a ELSE b END AS into_, na + nb AS documents FROM p WHERE similarity >= 0.9 AND NOT (a = (SELECT min(a) FROM p WHERE similarity >= 0.9))""")
def merge_suggestions(spark, sf_dir):
    """VOC8: alike names, the less used into the more used, without the pairs that rules keep apart."""
    part = table(spark, sf_dir, "part")
    used = part.groupBy(F.lit("object").alias("kind"), F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("documents"))
    pairs = vocabulary.look_alikes(used.select("kind", "value"))
    first = pairs.agg(F.min("a").alias("a")).first()["a"]
    apart = pairs.where(F.col("a") == first).select("kind", F.col("b").alias("value"), F.lit("keepApart").alias("action"), F.col("a").alias("target"))
    return vocabulary.suggestions(pairs, used, apart, limit=1_000_000).select("value", F.col("into").alias("into_"), "documents")


@query("hits_with_documents", "SELECT doc_id, source, lang FROM documents WHERE list_contains(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}]+'), 'onen') AND source IS NOT NULL")
def hits_with_documents(spark, sf_dir):
    """JN1: what words find, joined with the documents' own columns."""
    docs = table(spark, sf_dir, "documents")
    index = postings.kept(docs, {"body": "text", "sender": "source", "language": "lang"})
    return postings.bm25(index, [search.Phrase(("onen",), "body")]).join(docs.where("source IS NOT NULL"), "doc_id").select("doc_id", "source", "lang")


@query("rebuilt_from_records", "SELECT s_suppkey, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def rebuilt_from_records(spark, sf_dir):
    """PIP7: the index made anew from record files."""
    rows = table(spark, sf_dir, "supplier")
    written = records.rendered({"key": F.col("s_suppkey"), "nation": F.col("s_nationkey")}, F.col("s_name"))
    folder = _written(spark, rows.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".md")).alias("name"), F.encode(written, "UTF-8").alias("content")), "record-files")
    index = snapshots.Versions(spark, f"{folder}-index", "s_suppkey long, name string, nation string")
    records.rebuild(spark, folder, index.current, lambda found: index.commit(found.select(F.col("fields")["key"].cast("long").alias("s_suppkey"), F.trim("body").alias("name"), F.col("fields")["nation"].alias("nation")), index.current()))
    return index.read()


@query("checked_plans", """WITH p AS (SELECT p_partkey, p_brand AS b, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part)
SELECT p_partkey, 'sender:' || b || '|topic:' || one || CASE WHEN p_partkey % 2 = 1 THEN '|topic:' || two ELSE '' END AS labels, CASE WHEN p_partkey % 2 = 1 THEN 'papers' ELSE 'papers|' || two END AS words, 'type' AS grouping,
CASE WHEN p_partkey % 3 = 0 THEN 'unquoted:nothing|' ELSE '' END || CASE WHEN p_partkey % 2 = 1 THEN 'askedForByALabel:' || two || '|' ELSE '' END || 'onlyArranges:by type' AS notes FROM p WHERE one <> two""")
def checked_plans(spark, sf_dir):
    """VAL3: answers to requests, of which stands what the requests bear out."""
    one, two = (F.element_at(F.split("p_name", " "), n) for n in (1, 2))
    label = lambda kind, value, quote: F.struct(F.lit(kind).alias("kind"), value.alias("value"), quote.alias("quote"))
    some = F.array(label("sender", F.col("p_brand"), F.col("p_brand")), label("topic", one, one), F.when(F.col("p_partkey") % 3 == 0, label("topic", F.lit("nothing"), F.lit("elsewhere"))), F.when(F.col("p_partkey") % 2 == 1, label("topic", two, two)))
    grouping = F.array(F.struct(F.lit("type").alias("kind"), F.lit("by type").alias("quote")))
    answer = F.to_json(F.struct(F.array_compact(some).alias("labels"), F.array(F.lit("papers"), two, F.lit("by type")).alias("words"), grouping.alias("grouping")))
    request = F.concat(F.lit("papers of "), "p_brand", F.lit(" about "), "p_name", F.lit(" by type"))
    found = dealt(table(spark, sf_dir, "part").where(one != two).select("p_partkey", "p_name", "p_brand")).select("p_partkey", answers.checked_plan(answer, request).alias("p"))
    return found.select("p_partkey", F.array_join(F.transform("p.labels", lambda x: F.concat_ws(":", x["kind"], x["value"])), "|").alias("labels"), F.array_join("p.words", "|").alias("words"), F.array_join("p.grouping", "|").alias("grouping"), F.array_join("p.notes", "|").alias("notes"))


@query("composed_texts", "SELECT p_partkey, nfc_normalize(p_name || 'e' || chr(769) || ' A' || chr(778)) || chr(10) || 'next' AS text FROM part")
def composed_texts(spark, sf_dir):
    """TXT1: composed characters, line ends and trailing blanks."""
    written = F.concat(F.col("p_name"), F.lit("é Å \t\r\nnext\x07 \n"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized(written).alias("text"))


@query("language_search_texts", "SELECT doc_id, lang || CASE lang WHEN 'en' THEN ' English' WHEN 'fr' THEN ' French' WHEN 'de' THEN ' German' WHEN 'es' THEN ' Spanish' WHEN 'pt' THEN ' Portuguese' WHEN 'it' THEN ' Italian' WHEN 'ru' THEN ' Russian' WHEN 'nl' THEN ' Dutch' ELSE '' END AS searched FROM documents WHERE lang IS NOT NULL")
def language_search_texts(spark, sf_dir):
    """FTS10: a language is found by its code and its English name."""
    label = F.array(F.struct(F.lit("language").alias("kind"), F.col("lang").alias("value")))
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", L.search_text(label, "language").alias("searched"))


@query("context_places", """WITH m AS (SELECT o_custkey AS question, o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 11 END AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 13 END AS near FROM orders)
SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY seq IS NULL, seq, CASE WHEN seq IS NULL THEN near IS NULL ELSE TRUE END, CASE WHEN seq IS NULL THEN near END, date DESC, doc_id) AS place FROM m""")
def context_places(spark, sf_dir):
    """PIP14: what the last answer was made from, then what is relevant, then the newest."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    sources = rows.where("doc_id % 7 = 0").select("question", "doc_id", (F.col("doc_id") % 11).alias("seq"))
    relevant = rows.where("doc_id % 3 = 0").select("question", "doc_id", (F.col("doc_id") % 13).alias("place"))
    return tasks.context_order(rows, sources, relevant).select("question", "doc_id", F.col("place").cast("long").alias("place"))


@query("evaluation_report", "SELECT o_orderkey, o_orderkey % 5 <> 0 AS status_right, 2 AS labels_expected, (SELECT count(*) FROM orders) AS amounts FROM orders")
def evaluation_report(spark, sf_dir):
    """SNK9, AGG14: an evaluation written as lines of JSON and read again: a row's marks, beside the number of labels expected of a kind."""
    folder = f"{shared_folder(spark)}/dossier-report-{uuid.uuid4().hex}"
    observability.write_report(expectations(spark, sf_dir), folder, "o_orderkey")
    lines = spark.read.schema("value string, kind string").text(folder)
    rows = lines.where("kind = 'row'").select(F.from_json("value", "o_orderkey long, status_right boolean, labels_expected int").alias("r")).select("r.*")
    kinds = lines.where("kind = 'kind'").select(F.from_json("value", "kind string, expected long").alias("k")).where("k.kind = 'amount'").select(F.col("k.expected").alias("amounts"))
    return rows.crossJoin(F.broadcast(kinds))  # one row

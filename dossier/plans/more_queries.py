"""Queries over the test tables for labels, dates, identifiers, readers, records, grounding and streams, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import dates, grounding, identifiers, settings
from dossier.functions import labels as L
from dossier.functions import text as T
from dossier.operators import filters, observability, search, vocabulary
from dossier.plans import requests, tasks
from dossier.plans.adapters import LABELS_SQL, dealt, labels, table
from dossier.plans.registry import query
from dossier.sources import files, records
from dossier.streaming import arrivals


def _label(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _shown(some: Column) -> Column:
    """An array of labels as one string."""
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["value"])), "|")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


# Labels and their writings.


def _written_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents whose object is the part's name in either order, with one of two numbers."""
    first, last = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1)
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.concat_ws(", ", last, first))).otherwise(F.concat_ws(" ", first, last))
    number = F.when(F.col("p_partkey") % 2 == 0, " FT 1/23").otherwise(" FT 12/3")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("object").alias("kind"), F.concat(name, number).alias("value"))


@query("labels_by_writing", "SELECT p_partkey AS doc_id FROM part WHERE list_sort(string_split(p_name, ' ')) = list_sort(string_split((SELECT p_name FROM part WHERE p_partkey = 0), ' ')) AND p_partkey % 2 = 0")
def labels_by_writing(spark, sf_dir):
    """FLT4, VOC2: one writing is any order of words, but other numbers are another label."""
    some = _written_parts(spark, sf_dir)
    name = table(spark, sf_dir, "part").where("p_partkey = 0").first()["p_name"]
    return filters.with_labels(some.select("doc_id"), some, [("object", f"{name}: ft 1-23")])


@query("comparison_keys", """SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') || ' ' || p_partkey || ' 7' AS sorted, replace(p_name, ' ', '') || p_partkey || '7' AS joined, p_partkey || '7' AS digits, 2 AS numbers FROM part""")
def comparison_keys(spark, sf_dir):
    """VOC1, FLT4: numbers, letters and sorted words of a value."""
    key = vocabulary.keys_of(F.concat_ws(" ", F.initcap("p_name"), F.concat(_text("p_partkey"), F.lit(".7"))))
    return table(spark, sf_dir, "part").select("p_partkey", key["sorted"].alias("sorted"), key["joined"].alias("joined"), key["digits"].alias("digits"), F.size(key["numbers"]).alias("numbers"))


@query("regroupings", "SELECT o_orderkey, o_orderkey % 2 = 0 OR length((o_orderkey + 10000)::VARCHAR) <= 3 AS regrouped FROM orders")
def regroupings(spark, sf_dir):
    """VOC3: the same digits, cut at places of which one's include the other's."""
    digits = (F.col("o_orderkey") + 10000).cast("string")
    cut = lambda n: F.concat(F.substring(digits, 1, n), F.lit("/"), F.substr(digits, F.lit(n + 1)))
    other = F.when(F.col("o_orderkey") % 2 == 0, digits).otherwise(cut(3))
    return table(spark, sf_dir, "orders").select("o_orderkey", vocabulary.regrouping(vocabulary.keys_of(cut(2)), vocabulary.keys_of(other)).alias("regrouped"))


@query("rules_applied", f"""WITH {LABELS_SQL}, r AS (SELECT doc_id, kind, CASE WHEN kind = 'sender' AND value IN ('src1', 'src2') THEN 'src3' WHEN kind = 'sender' AND value = 'src5' THEN 'Six' ELSE value END AS value
FROM labelled WHERE NOT (kind = 'sender' AND value = 'src4')) SELECT DISTINCT doc_id, kind, value FROM r""")
def rules_applied(spark, sf_dir):
    """VOC9, VOC11: merges that follow each other, an ignored label, and a rule on another writing."""
    rules = spark.createDataFrame([(1, "sender", "src1", "merge", "src2"), (2, "sender", "SRC 2", "merge", "src3"), (3, "sender", "src4", "ignore", None), (4, "sender", "src-5", "merge", "Six"), (5, "topic", "quality:1", "keepApart", "toxic:1")], "id int, kind string, value string, action string, target string")
    return vocabulary.apply_rules(labels(spark, sf_dir), rules)


@query("decided_pairs", """WITH u AS (SELECT source AS value, count(DISTINCT doc_id) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), p AS (SELECT a.value AS a, b.value AS b, a.n AS na, b.n AS nb FROM u a JOIN u b ON a.value < b.value AND length(a.value) = length(b.value))
SELECT CASE WHEN na > nb OR (na = nb AND a < b) THEN b ELSE a END AS value, CASE WHEN (na + nb) % 2 = 0 THEN 'merge' ELSE 'keepApart' END AS action, CASE WHEN na > nb OR (na = nb AND a < b) THEN a ELSE b END AS target FROM p""")
def decided_pairs(spark, sf_dir):
    """VOC14: the rules that judgements of pairs in use make."""
    used = filters.usage(labels(spark, sf_dir)).where("kind = 'sender'").cache()  # a row per sender
    a, b = used.select("kind", F.col("value").alias("a"), F.col("documents").alias("na")), used.select("kind", F.col("value").alias("b"), F.col("documents").alias("nb"))
    pairs = a.join(b, "kind").where((F.col("a") < F.col("b")) & (F.length("a") == F.length("b")))
    judged = pairs.select("kind", "a", "b", F.when((F.col("na") + F.col("nb")) % 2 == 0, "same").otherwise("different").alias("judged"))
    return vocabulary.decided(judged, used).select("value", "action", "target")


_LABELS = "'object:' || p_name || '|topic:' || p_brand || '|topic:' || p_type || '|date:2024-01-0' || (p_partkey % 9 + 1)"


def _part_labels() -> Column:
    day = F.concat(F.lit("2024-01-0"), (F.col("p_partkey") % 9 + 1).cast("string"))
    return F.array(_label("object", F.col("p_name")), _label("object", F.upper("p_name")), _label("topic", F.concat_ws("; ", "p_brand", "p_type")), _label("date", day), _label("date", F.lit("1999-12-31")))


@query("split_and_distinct_labels", f"SELECT p_partkey, {_LABELS} AS labels FROM part")
def split_and_distinct_labels(spark, sf_dir):
    """ARR1, ARR2: values joined by `;` apart, each once, one date."""
    return table(spark, sf_dir, "part").select("p_partkey", _shown(L.distinct_labels(L.split_labels(_part_labels()))).alias("labels"))


@query("edited_labels", "SELECT p_partkey, 'topic:' || p_brand || '; ' || p_type || '|date:2025-05-05|tag:seen' AS labels FROM part")
def edited_labels(spark, sf_dir):
    """PIP16: removals by folded value; an added date takes the place of the others."""
    removed, added = F.array(_label("object", F.initcap("p_name"))), F.array(_label("date", F.lit("2025-05-05")), _label("tag", F.lit("seen")))
    return table(spark, sf_dir, "part").select("p_partkey", _shown(L.edit_labels(_part_labels(), removed, added)).alias("labels"))


@query("normalized_labels", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') END AS period, printf('%.2f', o_totalprice) || ' EUR' AS amount FROM orders""")
def normalized_labels(spark, sf_dir):
    """ARR3, NUM1: values as their kind is written, null where they can't be read."""
    day = L.normalize(F.lit("date"), F.date_format("o_orderdate", "d.M.yyyy"))
    period = L.normalize(F.lit("period"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", " yyyy-MM ")).otherwise("some day"))
    amount = L.normalize(F.lit("amount"), F.concat(F.lit("€ "), F.format_number("o_totalprice", 2)))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), period.alias("period"), amount.alias("amount"))


@query("labels_kept_by_hand", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'object:' || p_name || '|tag:mine|topic:new' ELSE 'object:' || upper(p_name) || '|topic:' || p_brand || '|tag:mine' END AS labels FROM part")
def labels_kept_by_hand(spark, sf_dir):
    """VOC16: a new reading doesn't touch what the user changed, set by hand or tagged."""
    even = F.col("p_partkey") % 2 == 0
    before = F.array(_label("object", F.col("p_name")), _label("topic", F.lit("old")))
    current = F.when(even, F.array(_label("object", F.col("p_name")), _label("topic", F.lit("old")), _label("tag", F.lit("mine")))).otherwise(F.array(_label("object", F.upper("p_name")), _label("topic", F.col("p_brand")), _label("tag", F.lit("mine"))))
    by_hand = F.when(even, F.array(_label("object", F.col("p_name")))).otherwise(F.array(_label("object", F.upper("p_name"))))
    read = F.array(_label("object", F.lit("read")), _label("topic", F.lit("new")), _label("tag", F.lit("read")))
    return table(spark, sf_dir, "part").select("p_partkey", _shown(L.keep_by_hand(read, before, current, by_hand)).alias("labels"))


@query("merged_tags", "SELECT p_partkey, 'tag:' || p_brand || '|tag:' || p_type || '|tag:x1|tag:x2|tag:x3' AS tags FROM part")
def merged_tags(spark, sf_dir):
    """VOC18: at most five tags, each once."""
    tag = lambda c: _label("tag", c)
    some, more = F.array(tag(F.col("p_brand")), tag(F.col("p_type"))), F.array(tag(F.upper("p_brand")), *[tag(F.lit(f"x{i}")) for i in range(1, 6)])
    return table(spark, sf_dir, "part").select("p_partkey", _shown(L.merge_tags(some, more)).alias("tags"))


@query("stored_labels", "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'tag:' || p_brand WHEN 2 THEN 'object:' || p_name || '|tag:' || p_brand END AS labels, p_partkey % 3 = 1 AS tags_only, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS by_hand FROM part")
def stored_labels(spark, sf_dir):
    """VOC17: null while unlabelled, whether there are tags only, and the by-hand ones that are still there."""
    n, tag, thing = F.col("p_partkey") % 3, _label("tag", F.col("p_brand")), _label("object", F.col("p_name"))
    some = F.when(n == 1, F.array(tag)).when(n == 2, F.array(thing, tag)).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    form = vocabulary.stored_form(some, F.array(thing, _label("object", F.lit("gone"))))
    return table(spark, sf_dir, "part").select("p_partkey", _shown(form["labels"]).alias("labels"), form["tags_only"].alias("tags_only"), F.size(form["by_hand"]).alias("by_hand"))


@query("first_values", "SELECT p_partkey, p_name AS object, NULL::VARCHAR AS party, p_name || chr(10) || upper(p_name) AS searched FROM part")
def first_values(spark, sf_dir):
    """PRJ2, FTS10: the first value of a kind, and all of them as lines to search."""
    some = _part_labels()
    return table(spark, sf_dir, "part").select("p_partkey", L.first_value(some, "object").alias("object"), L.first_value(some, "party").alias("party"), L.search_text(some, "object").alias("searched"))


# Filters, orders and sets.


@query("filtered_documents", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey % 10 = 3 AND o_orderpriority = '1-URGENT'")
def filtered_documents(spark, sf_dir):
    """FLT1, FLT2: statuses, a folder and labels together."""
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("/in/"), (F.col("o_custkey") % 10).cast("string"), F.lit("/"), _text("o_orderkey")).alias("path"))
    marks = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("topic").alias("kind"), F.col("o_orderpriority").alias("value"))
    return filters.DocumentFilter(statuses=["F", "P"], labels=[("topic", "1 urgent")], within="/in/3").apply(docs, marks).select("doc_id")


@query("history_of_kinds", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND user_id = 5 AND ts < TIMESTAMP '2024-01-20'")
def history_of_kinds(spark, sf_dir):
    """FLT9: events of kinds and a document before an instant."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("doc_id"), F.col("ts").alias("at"))
    return filters.history(events, ["click", "error"], 5, "2024-01-20 00:00:00").select("event_id")


@query("orders_by_filing", "SELECT o_orderkey AS doc_id FROM orders ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 40 DAY) DESC NULLS LAST, o_orderkey DESC LIMIT 200")
def orders_by_filing(spark, sf_dir):
    """RNK6: a page of the newest by filing, or else by adding."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("filed_at"), (F.col("o_orderdate") - F.expr("INTERVAL 40 DAYS")).alias("added_at"))
    return docs.orderBy(*filters.other_order("filed_or_added")).limit(200).select("doc_id")


@query("ids_in_order", "SELECT doc_id, position FROM (SELECT unnest([17, 3, 99, 0, 42, 100000000]) AS doc_id, generate_subscripts([17, 3, 99, 0, 42, 100000000], 1) - 1 AS position) JOIN documents USING (doc_id)")
def ids_in_order(spark, sf_dir):
    """SRC19: documents of a list of ids, in its order."""
    return filters.in_order_of(table(spark, sf_dir, "documents").select("doc_id"), [17, 3, 99, 0, 42, 100_000_000]).select("doc_id", F.col("position").cast("long").alias("position"))


@query("added_by_labels", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000")
def added_by_labels(spark, sf_dir):
    """PIP12: the newest documents with a label that the set doesn't have."""
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("added_at"))
    marks = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("topic").alias("kind"), F.col("o_orderpriority").alias("value"))
    return tasks.add_by_labels(docs, marks, [("topic", "2-HIGH")], orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))).select("doc_id")


_ACTIONS = ["confirm", "hold", "undo", "remove", "retry", "putBack"]


@query("reviewed_states", """WITH a AS (SELECT user_id AS doc_id, list([['confirm', 'hold', 'undo', 'remove', 'retry', 'putBack'][event_id % 6 + 1]] ORDER BY event_id) AS listed FROM events GROUP BY 1),
d AS (SELECT doc_id, list_reduce(list_prepend([]::VARCHAR[], listed), lambda acc, x: CASE WHEN x[1] = 'undo' THEN acc[:-2] ELSE acc || x END) AS done FROM a)
SELECT doc_id, CASE done[-1] WHEN 'confirm' THEN 'filed' WHEN 'remove' THEN 'removed' WHEN 'retry' THEN 'pending' ELSE 'needsReview' END AS state, len(done) AS n FROM d""")
def reviewed_states(spark, sf_dir):
    """PIP9: what a document's review actions come to, undone ones taken back."""
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") % 6 + 1).cast("int"))
    return tasks.reviewed(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), action.alias("action")))


@query("export_places", """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Other' ELSE p_brand END || '/' || p_type AS folder, p_name || '.pdf' AS name, p_partkey % 7 = 0 AS bad FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY p_partkey) AS n FROM f) SELECT p_partkey, CASE WHEN NOT bad THEN folder || '/' || CASE WHEN n = 1 THEN name ELSE replace(name, '.pdf', '') || ' (' || n || ').pdf' END END AS path, CASE WHEN bad THEN 'unreadable' END AS skipped FROM r""")
def export_places(spark, sf_dir):
    """SNK6: folders by levels, names that collide numbered, unreadable files listed as skipped."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("sender"), "p_type", F.concat("p_name", F.lit(".pdf")).alias("name"))
    return tasks.export_manifest(parts, ["sender", "p_type"], "name", "p_partkey", F.col("p_partkey") % 7 != 0)


@query("timeline_places", """WITH b AS (SELECT conv_id, turn // 2 AS t, 1 AS o, turn AS id, role FROM conversations UNION ALL SELECT conv_id, turn // 2, 0, turn, 'change' FROM conversations WHERE role = 'assistant')
SELECT conv_id, id, role AS text, row_number() OVER (PARTITION BY conv_id ORDER BY t, o, id) AS place FROM b""")
def timeline_places(spark, sf_dir):
    """PIP13, WIN2: turns and changes of each conversation in one order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("at"), F.col("turn").alias("id"), F.col("role").alias("text"))
    changes = turns.where("text = 'assistant'").select("conv_id", "at", "id", F.lit("change").alias("summary"))
    return tasks.timeline(turns, changes, "conv_id").select("conv_id", F.col("position").alias("id"), "text", F.col("place").cast("long").alias("place"))


@query("enqueued_jobs", """WITH j AS (SELECT user_id, event_id AS id, event_type AS kind, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS s FROM events)
SELECT '/in/' || user_id AS source_path, arg_max(kind, (s, -id)) AS kind, arg_max(id, (s, -id)) AS id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS tags FROM j GROUP BY user_id""")
def enqueued_jobs(spark, sf_dir):
    """PIP3: one job per path, the stronger request wins, tags join."""
    strength = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    jobs = table(spark, sf_dir, "events").select(F.concat(F.lit("/in/"), _text("user_id")).alias("source_path"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), strength.alias("strength"), F.array("event_type").alias("tags"))
    return tasks.enqueue(jobs.where("id % 2 = 0"), jobs.where("id % 2 = 1")).withColumn("tags", F.array_join("tags", ","))


@query("reconciled_files", """SELECT 'u' || p_partkey AS uid, CASE p_partkey % 5 WHEN 1 THEN '/b/' WHEN 2 THEN '/c/' ELSE '/a/' END || p_partkey AS path, CASE p_partkey % 5 WHEN 1 THEN 'moved' WHEN 2 THEN 'moved' WHEN 3 THEN 'missing' ELSE 'kept' END AS fate FROM part
UNION ALL SELECT 'n' || p_partkey, '/n/' || p_partkey, 'new' FROM part WHERE p_partkey % 10 = 0""")
def reconciled_files(spark, sf_dir):
    """PIP6, PIP19: kept, moved by uid or by inode, missing and new files."""
    part, k, n = table(spark, sf_dir, "part"), _text("p_partkey"), F.col("p_partkey") % 5
    index = part.select(F.concat(F.lit("u"), k).alias("uid"), F.concat(F.lit("/a/"), k).alias("path"), F.col("p_partkey").alias("inode"), F.col("p_size").alias("size"))
    moved = F.when(n == 1, "/b/").when(n == 2, "/c/").otherwise("/a/")
    there = part.where(n != 3).select(F.concat(moved, k).alias("path"), F.when(n.isin(0, 1), F.concat(F.lit("u"), k)).alias("uid"), F.col("p_partkey").alias("inode"), F.col("p_size").alias("size"))
    fresh = part.where("p_partkey % 10 = 0").select(F.concat(F.lit("/n/"), k).alias("path"), F.concat(F.lit("n"), k).alias("uid"), (-F.col("p_partkey") - 1).alias("inode"), F.col("p_size").alias("size"))
    return tasks.reconcile(index, there.unionByName(fresh))


@query("merged_records", "SELECT p_partkey AS uid, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title, p_partkey % 6 = 0 AS conflict FROM part")
def merged_records(spark, sf_dir):
    """PIP8: parsed records win, the others stay, two paths of one uid are a conflict."""
    part = table(spark, sf_dir, "part")
    current = part.select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("title"))
    parsed = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("uid"), F.upper("p_name").alias("title"), F.lit("/a").alias("path"))
    again = part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("uid"), F.lit("other").alias("title"), F.lit("/b").alias("path"))
    return tasks.merge_records(current, parsed.unionByName(again)).select("uid", "title", "conflict")


@query("carriers", "SELECT p_partkey AS uid, CASE p_partkey % 3 WHEN 0 THEN '/rec/' || p_partkey WHEN 1 THEN '/x/moved' ELSE '/a' END AS path FROM part")
def carriers(spark, sf_dir):
    """PIP18, JN4: which of the files of one record is the document."""
    part, n, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3, _text("p_partkey")
    row = lambda path, inode: F.struct(path.alias("path"), inode.alias("inode"))
    there = F.when(n == 0, F.array(row(F.concat(F.lit("/rec/"), k), F.lit(5)), row(F.lit("/a"), F.lit(6)))).when(n == 1, F.array(row(F.lit("/x/moved"), F.lit(1)), row(F.lit("/a"), F.lit(7)))).otherwise(F.array(row(F.lit("/z/deep"), F.lit(8)), row(F.lit("/a"), F.lit(9))))
    some = part.select(F.col("p_partkey").alias("uid"), F.concat(F.lit("/rec/"), k).alias("recorded_path"), F.lit(1).alias("recorded_inode"), F.lit(False).alias("unsure"), F.inline(there))
    return tasks.carrier(some).where("carrier").select("uid", "path")


# Dates and identifiers.


@query("dated_texts", "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def dated_texts(spark, sf_dir):
    """DT1-DT3, WIN4, WIN5, FLT13: a document's own date among a due date and a birthday, in four writings."""
    n = F.col("o_orderkey") % 4
    written = lambda c: F.when(n == 0, F.date_format(c, "dd.MM.yyyy")).when(n == 1, F.date_format(c, "yyyy-MM-dd")).when(n == 2, F.date_format(c, "d MMMM yyyy")).otherwise(F.date_format(c, "MMMM d, yyyy"))
    text = F.concat(F.lit("Invoice "), _text("o_orderkey"), F.lit("\nInvoice date: "), written(F.col("o_orderdate")), F.lit("\nDue date: "), written(F.date_add("o_orderdate", 30)), F.lit("\nBorn 01.02.1950\nNot a day: 31.02.1995"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.array().cast("array<string>").alias("metadata_days"))
    return dates.document_dates(docs, "2002-01-01").select("doc_id", "date")


@query("date_fallbacks", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'pdfMeta' WHEN 2 THEN 'created' ELSE 'modified' END AS source, o_orderdate + to_days((o_orderkey % 4)::INT) AS date FROM orders")
def date_fallbacks(spark, sf_dir):
    """DT4: the first of what text, EXIF, metadata and the file say."""
    at = lambda i: F.when(F.col("o_orderkey") % 4 <= i, F.col("o_orderdate") + F.make_dt_interval(F.lit(i)))
    found = dates.fallback(at(0), F.lit(None).cast("timestamp_ntz"), at(1), at(2), at(3))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["source"].alias("source"), found["date"].alias("date"))


@query("events_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY) AS recent FROM events GROUP BY 1")
def events_by_month(spark, sf_dir):
    """DT7: the month of an instant, and a window of days."""
    recent = dates.since(F.col("ts").cast("timestamp"), "2024-02-01", 10)
    return table(spark, sf_dir, "events").groupBy(dates.month_key(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("recent"))


def _iban() -> Column:
    """German IBANs of order numbers, every third with another check number."""
    bank = F.lpad(_text("o_orderkey"), 18, "0")
    check = F.lit(98) - F.expr("CAST(concat(lpad(CAST(o_orderkey AS STRING), 18, '0'), '131400') AS DECIMAL(38, 0)) % 97").cast("int") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    return F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), bank)


_IBAN_SQL = "i AS (SELECT o_orderkey, 'DE' || lpad((98 - ((lpad(o_orderkey::VARCHAR, 18, '0') || '131400')::HUGEINT % 97) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR, 2, '0') || lpad(o_orderkey::VARCHAR, 18, '0') AS iban FROM orders)"
_IBAN_GOOD = "(iban[5:] || '1314' || iban[3:4])::HUGEINT % 97 = 1"


@query("iban_checks", f"WITH {_IBAN_SQL} SELECT o_orderkey FROM i WHERE {_IBAN_GOOD}")
def iban_checks(spark, sf_dir):
    """NUM2: account numbers whose check number is right, written in groups of four."""
    spaced = F.regexp_replace(_iban(), "(.{4})", "$1 ")
    return table(spark, sf_dir, "orders").where(identifiers.is_iban(spaced)).select("o_orderkey")


@query("vat_forms", r"WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'SE' WHEN 1 THEN 'ATU' ELSE 'DE' END || (o_orderkey + 12345678) || CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '0001' ELSE '0002' END ELSE '' END AS t FROM orders) SELECT o_orderkey FROM v WHERE regexp_full_match(t, 'ATU\d{8}|SE\d{10}01|DE\d{9}')")
def vat_forms(spark, sf_dir):
    """NUM4: eight digits are an Austrian number behind `U`, but no German one; a Swedish one ends in 01."""
    key = F.col("o_orderkey")
    end = F.when(key % 3 != 0, "").when(key % 2 == 0, "0001").otherwise("0002")
    text = F.concat(F.when(key % 3 == 0, "SE").when(key % 3 == 1, "ATU").otherwise("DE"), (key + 12345678).cast("string"), end)
    return table(spark, sf_dir, "orders").where(identifiers.is_vat(text)).select("o_orderkey")


@query("found_identifiers", f"WITH {_IBAN_SQL} SELECT o_orderkey, CASE WHEN {_IBAN_GOOD} THEN 'iban:' || iban || '|' ELSE '' END || 'bik:04' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS found FROM i")
def found_identifiers(spark, sf_dir):
    """NUM5, NUM6: identifiers in running text, in order of appearance."""
    text = F.concat(F.lit("Pay to IBAN: "), F.regexp_replace(_iban(), "(.{4})", "$1 "), F.lit(" today.\nБИК 04"), F.lpad((F.col("o_orderkey") % 10000000).cast("string"), 7, "0"), F.lit(", thanks"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(identifiers.stable_keys(text), "|").alias("found"))


# Texts.


@query("file_names", "SELECT p_partkey, p_name || '.tar.gz' AS name FROM part")
def file_names(spark, sf_dir):
    """PRJ1: the last part of a path."""
    return table(spark, sf_dir, "part").select("p_partkey", T.file_name(F.concat_ws("/", F.lit("/in"), "p_brand", F.concat("p_name", F.lit(".tar.gz")))).alias("name"))


@query("folded_words", "SELECT doc_id, lower(strip_accents(lower(text))) AS folded FROM documents WHERE text IS NOT NULL")
def folded_words(spark, sf_dir):
    """TXT8, FTS1: case and accents folded."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("shortened_texts", "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN contains(text[:81], ' ') THEN left(text, 81 - strpos(reverse(text[:81]), ' ')) ELSE text[:80] END AS short FROM documents")
def shortened_texts(spark, sf_dir):
    """TXT10: cut after a word."""
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text"), 80).alias("short"))


@query("bounded_names", "SELECT o_orderkey, left(repeat('order ' || o_orderkey || '-', 20), 120) || '.pdf' AS name FROM orders")
def bounded_names(spark, sf_dir):
    """TXT16: at most 120 characters, and the extension."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.bounded_name(F.repeat(F.concat(F.lit("order "), _text("o_orderkey"), F.lit("-")), 20), F.lit(".pdf")).alias("name"))


@query("embedding_summaries", "SELECT doc_id, left(concat_ws(chr(10), 'sender: ' || source, 'language: ' || lang, coalesce(text, '')), 300) AS summary FROM documents")
def embedding_summaries(spark, sf_dir):
    """TXT18: header lines that there are, then the text, to a limit."""
    head = [F.concat(F.lit("sender: "), F.col("source")), F.concat(F.lit("language: "), F.col("lang"))]
    return table(spark, sf_dir, "documents").select("doc_id", T.embedding_summary(head, F.coalesce("text", F.lit("")), 300).alias("summary"))


@query("phrase_hits", r"SELECT p_partkey, p_partkey % 3 <> 2 AS found FROM part")
def phrase_hits(spark, sf_dir):
    """TXT13: label phrases with free white space, dots that may lack and any word for `*`."""
    pattern = settings.phrase_pattern(["inv. no. : *", "total due"])
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Inv No:"), _text("p_partkey"))).when(F.col("p_partkey") % 3 == 1, "the total   due").otherwise(F.concat(F.lit("totaldue "), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", text.rlike(f"(?i){pattern}").alias("found"))


@query("highlight_runs", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS runs, 1 AS hits, p_name || p_brand || p_type AS plain FROM part")
def highlight_runs(spark, sf_dir):
    """TXT20: runs of a marked snippet, and its plain text."""
    marked = F.concat("p_name", F.lit(""), "p_brand", F.lit(""), "p_type")
    runs = T.highlights(marked)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(runs, lambda r: r["text"]), "|").alias("runs"), F.size(F.filter(runs, lambda r: r["hit"])).alias("hits"), T.unmarked(marked).alias("plain"))


@query("package_digests", "SELECT l_orderkey, sha256(string_agg(length(p) || ':' || p, '' ORDER BY p)) AS digest FROM (SELECT l_orderkey, l_linenumber || '/' || l_partkey AS p FROM lineitem) GROUP BY 1")
def package_digests(spark, sf_dir):
    """HSH2: one digest of ordered parts."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat_ws("/", "l_linenumber", "l_partkey")).alias("parts"))  # of one order
    return parts.select("l_orderkey", T.package_digest(F.col("parts")).alias("digest"))


@query("same_files", "SELECT o_orderkey, o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS same FROM orders")
def same_files(spark, sf_dir):
    """HSH3: size, inode where both are known, and time decide."""
    key = F.col("o_orderkey")
    node = F.when(key % 3 == 0, key + 1).when(key % 2 == 0, key)
    same = T.same_file(F.col("o_custkey"), F.col("o_custkey") + F.col("o_custkey") % 2, F.lit(10.0), F.when(key % 5 == 0, 11.5).otherwise(10.5), key, node)
    return table(spark, sf_dir, "orders").select("o_orderkey", same.alias("same"))


# Readers and records.


@query("mail_texts", "SELECT conv_id, turn, 'Turn ' || turn AS subject, 'x' || conv_id || ' said ' || role AS text FROM conversations")
def mail_texts(spark, sf_dir):
    """SRC7, SRC8, SRC13: mails with a header and a quoted-printable body."""
    raw = F.concat(F.lit("Subject: Turn "), _text("turn"), F.lit("\r\nFrom: a@b.example\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n=78"), _text("conv_id"), F.lit(" sa=\r\nid "), F.col("role"), F.lit("\r\n"))
    mails = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("/", F.lit("/in"), "conv_id", F.concat(_text("turn"), F.lit(".eml"))).alias("path"), F.encode(raw, "UTF-8").alias("content"))
    found = files.extract(mails.withColumn("length", F.octet_length("content")))
    return found.join(mails.select("path", "conv_id", "turn"), "path").select("conv_id", "turn", found["metadata"]["subject"].alias("subject"), "text")


@query("csv_texts", "WITH r AS (SELECT *, c_custkey // 300 AS file, row_number() OVER (PARTITION BY c_custkey // 300 ORDER BY c_custkey) AS n FROM customer) SELECT file, 'name' || chr(9) || 'balance' || string_agg(chr(10) || c_name || chr(9) || printf('%.2f', c_acctbal), '' ORDER BY c_custkey) FILTER (n <= 200) AS text, count(*) > 200 AS truncated FROM r GROUP BY 1")
def csv_texts(spark, sf_dir):
    """SRC9: delimiter found, quoted cells read, as tab-separated text; files of 300 customers, of which the reader shows 200 rows."""
    rows = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 300").alias("file"), "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('";'), F.printf(F.lit("%.2f"), F.col("c_acctbal"))).alias("line"))
    books = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))).alias("some"))
    content = F.encode(F.concat(F.lit("name;balance\n"), F.array_join(F.transform("some", lambda x: x["line"]), "\n"), F.lit("\n")), "UTF-8")
    found = files.extract(books.select(F.concat(F.lit("/in/"), _text("file"), F.lit(".csv")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content")))
    return found.select(F.regexp_extract("path", r"(\d+)\.csv$", 1).cast("long").alias("file"), "text", F.array_contains("warnings", "truncated").alias("truncated"))


@query("markdown_fields", "SELECT p_partkey, p_brand AS sender, p_type AS kind, p_name AS body FROM part")
def markdown_fields(spark, sf_dir):
    """SRC17, SNK4, SNK5: a record written as Markdown with front matter, and read again."""
    text = records.rendered({"key": F.col("p_partkey"), "sender": F.col("p_brand"), "kind": F.col("p_type"), "none": F.lit(None).cast("string")}, F.col("p_name"))
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit("/rec/"), _text("p_partkey"), F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content")).withColumn("length", F.octet_length("content"))
    found = files.extract(raw)
    return found.select(found["metadata"]["key"].cast("long").alias("p_partkey"), found["metadata"]["sender"].alias("sender"), found["metadata"]["kind"].alias("kind"), F.col("text").alias("body"))


@query("file_kinds", "SELECT p_partkey, ['txt', 'pdf', 'png', 'unknown'][p_partkey % 4 + 1] AS kind, p_partkey % 4 = 0 AS read FROM part")
def file_kinds(spark, sf_dir):
    """SRC6, SRC7: kinds by extension or first bytes; without a reader there is a warning and no text."""
    n = F.col("p_partkey") % 4
    content = F.when(n == 1, F.unhex(F.lit("255044462D"))).when(n == 2, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.encode(F.col("p_name"), "UTF-8"))
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit("/in/"), _text("p_partkey"), F.when(n == 0, ".txt").otherwise("")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content"))
    return files.extract(raw).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("p_partkey"), "kind", F.col("text").isNotNull().alias("read"))


@query("oversized_files", "SELECT doc_id, octet_length(encode(text)) > 2000 AS too_large, CASE WHEN octet_length(encode(text)) <= 2000 THEN length(text) END AS chars FROM documents WHERE text IS NOT NULL")
def oversized_files(spark, sf_dir):
    """SRC7: files over the limit stay as rows with metadata alone."""
    raw = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("/in/"), _text("doc_id"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")).withColumn("length", F.octet_length("content"))
    return files.extract(raw, 2000).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), F.array_contains("warnings", "tooLarge").alias("too_large"), F.length("text").cast("long").alias("chars"))


# Grounding and answers.

_LONG = "list_filter(regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3)"


@query("passages_grounded", f"SELECT doc_id, len(list_filter({_LONG.format('passage')}, lambda w: NOT list_contains({_LONG.format('text')}, w))) = 0 AS grounded FROM (SELECT doc_id, text, text[:60] || CASE WHEN doc_id % 2 = 0 THEN ' ' || source ELSE '' END AS passage FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)")
def passages_grounded(spark, sf_dir):
    """JN13: every long word of a passage is in its document."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    passages = docs.select("doc_id", F.concat(F.substring("text", 1, 60), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("source"))).otherwise("")).alias("passage"))
    return tasks.contained(passages, docs.select("doc_id", "text")).select("doc_id", "grounded")


@query("title_words_missing", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_name || ' ' || p_brand, ' ') AS t FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS missing, p_partkey % 3 = 0 AS year, p_partkey % 2 = 0 AS number FROM w")
def title_words_missing(spark, sf_dir):
    """GRD1, GRD3-GRD5: the share of a title's words, the year and the number that a document has or lacks."""
    n = F.col("p_partkey")
    body = F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), F.when(n % 3 == 0, "from 03/2021").otherwise("undated"), F.when(n % 2 == 0, "AB 12 3").otherwise("AB 13"))
    title = F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), F.when(n % 2 == 0, "absentword").otherwise("a"))
    words = grounding.written_words(body)
    return table(spark, sf_dir, "part").select("p_partkey", grounding.unwritten_share(title, words).alias("missing"), grounding.year_is_written(F.lit("2021-05-01"), words).alias("year"), grounding.number_is_written(F.lit("ab-123"), grounding.written_numbers(body)).alias("number"))


@query("validated_answers", "SELECT p_partkey AS id, 'sender:' || p_brand || '|topic:' || p_type AS labels, 'unknownKinds,ungrounded' AS notes FROM part")
def validated_answers(spark, sf_dir):
    """VAL1: known kinds, grounded senders and references; notes say what went."""
    answer = F.concat(F.lit('{"labels":[{"kind":"sender","value":"'), "p_brand", F.lit('"},{"kind":"colour","value":"red"},{"kind":"sender","value":"Nowhere Ltd"},{"kind":"topic","value":"'), "p_type", F.lit('"}]}'))
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")).select(F.col("p_partkey").alias("id"), answer.alias("answer"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("body"))
    return grounding.validated(rows).select("id", _shown(F.col("labels")).alias("labels"), F.array_join("notes", ",").alias("notes"))


@query("cited_answers", "SELECT p_partkey, 'See ' || p_name || ' and .' AS answer, 1 AS sources FROM part")
def cited_answers(spark, sf_dir):
    """VAL4: marks become the shown names, sources that weren't shown go."""
    found = grounding.cited(F.lit("See [1] and [7]."), F.array(F.col("p_partkey"), F.lit(-1).cast("long")), F.array("p_partkey"), F.array("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", found["answer"].alias("answer"), F.size(found["sources"]).alias("sources"))


@query("judgements", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'different' END AS judged FROM orders")
def judgements(spark, sf_dir):
    """VAL5: a judgement read from JSON, null when it can't be."""
    n = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", grounding.judged(F.when(n == 0, '{"same": true}').when(n == 1, '{"same": false}').otherwise("neither")).alias("judged"))


@query("layout_fields", "SELECT p_partkey, p_brand AS sender, p_type AS below FROM part")
def layout_fields(spark, sf_dir):
    """VAL2: a field's value in the next cell, or below."""
    text = F.concat(F.lit("Sender:\t"), "p_brand", F.lit("\nSubject\n"), "p_type", F.lit("\tx"))
    return table(spark, sf_dir, "part").select("p_partkey", requests.field_value(text, "sender").alias("sender"), requests.field_value(text, "subject").alias("below"))


@query("asked_models", "SELECT p_partkey AS id, 'ok ' || p_partkey AS answer, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS attempts FROM part")
def asked_models(spark, sf_dir):
    """LLM1, UDF1: a model asked again with the fault named until its answer is valid."""
    prompts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p "), _text("p_partkey")).alias("prompt"))
    model = lambda p: f"ok {p.split()[1]}" if int(p.split()[1]) % 2 == 0 or "could not be read" in p else "?"
    return grounding.ask(prompts, model, lambda a: a.startswith("ok"))


# Observability.

_STAGES = ["hash", "dedupe", "extract", "entities", "analyse", "filed", "index"]
_FUNNEL = """WITH d AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'filed' WHEN 'HOUSEHOLD' THEN 'done' WHEN 'MACHINERY' THEN 'needsReview' ELSE 'failed' END AS status FROM customer),
l AS (SELECT o_custkey AS doc_id, max(o_orderkey) AS trace_id FROM orders GROUP BY 1),
w AS (SELECT l_orderkey AS trace_id, l_linenumber AS stage, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END) AS sev, sum(l_quantity) AS ms FROM lineitem GROUP BY 1, 2),
m AS (SELECT d.id, d.status, w.sev, w.ms, CASE w.stage WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 5 END AS step FROM d LEFT JOIN l ON l.doc_id = d.id LEFT JOIN w ON w.trace_id = l.trace_id),
f AS (SELECT id, any_value(status) AS status, coalesce(max(step), 0) AS furthest FROM m GROUP BY 1),
s AS (SELECT i AS step, (SELECT count(*) FROM f WHERE furthest >= i) AS reached, (SELECT count(*) FROM f WHERE furthest = i AND status NOT IN ('filed', 'done')) AS stopped FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i)),
p AS (SELECT *, greatest(0, least(coalesce(lead(reached) OVER (ORDER BY step), reached - stopped), reached)) AS passed FROM s),
t AS (SELECT step, count(*) FILTER (sev = 3) AS warned, avg(ms) FILTER (sev <> 4) AS mean_ms FROM m WHERE step IS NOT NULL GROUP BY 1)"""


def _funnel(spark, sf_dir):
    segment = F.col("c_mktsegment")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(segment == "BUILDING", "filed").when(segment == "HOUSEHOLD", "done").when(segment == "MACHINERY", "needsReview").otherwise("failed").alias("status"))
    traces = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"))
    flag = F.col("l_returnflag")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.get(F.array(*map(F.lit, _STAGES)), F.col("l_linenumber") - 1).alias("stage"), F.when(flag == "A", "ok").when(flag == "N", "warn").otherwise("error").alias("status"), F.col("l_quantity").alias("duration_ms"))
    return observability.funnel(docs, traces, steps)


@query("funnel_outcomes", f"{_FUNNEL} SELECT p.step::BIGINT AS step_index, reached, passed, stopped, coalesce(warned, 0) AS warned, round(mean_ms, 4) AS mean_ms, round(CASE WHEN reached > 0 THEN passed / reached END, 6) AS pass_rate, round(reached / max(CASE WHEN p.step = 0 THEN reached END) OVER (), 6) AS cumulative FROM p LEFT JOIN t USING (step)")
def funnel_outcomes(spark, sf_dir):
    """OBS1, OBS2, AGG13, JN7: the funnel of the latest traces, with rates."""
    found = observability.funnel_rates(_funnel(spark, sf_dir))
    return found.select(F.col("step_index").cast("long").alias("step_index"), "reached", "passed", "stopped", "warned", F.round("mean_ms", 4).alias("mean_ms"), F.round("pass_rate", 6).alias("pass_rate"), F.round("cumulative", 6).alias("cumulative"))


@query("funnel_main_stop", f"{_FUNNEL} SELECT (SELECT ['arrived', 'deduplicated', 'read', 'understood', 'analysed', 'filed'][step + 1] FROM p ORDER BY stopped DESC, step LIMIT 1) AS main_stop, (SELECT ['arrived', 'deduplicated', 'read', 'understood', 'analysed', 'filed'][step + 1] FROM t ORDER BY coalesce(mean_ms, -1) DESC LIMIT 1) AS slowest, round((SELECT passed FROM p WHERE step = 5) / (SELECT reached FROM p WHERE step = 0), 6) AS straight_through")
def funnel_main_stop(spark, sf_dir):
    """OBS2: where most stop, the slowest step, the share that goes straight through."""
    return observability.funnel_summary(_funnel(spark, sf_dir)).withColumn("straight_through", F.round("straight_through", 6))


def _expectations(spark, sf_dir):
    key = F.col("o_orderkey")
    price = F.round("o_totalprice", 2).cast("decimal(18,2)")
    found = F.when(key % 4 == 0, price + F.lit("0.02").cast("decimal(4,2)")).otherwise(price)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("expected_status"), F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("actual_status"), F.lit("invoice").alias("expected_type"), F.when(key % 2 == 0, "invoice").otherwise("letter").alias("actual_type"),
        F.lit("en").alias("expected_language"), F.lit("en").alias("actual_language"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expected_date"), F.date_format(F.date_add("o_orderdate", (key % 3 == 0).cast("int")), "yyyy-MM-dd").alias("actual_date"),
        F.lit("edp").alias("expected_sender"), F.when(key % 7 == 0, "Galp").otherwise("EDP Comercial").alias("actual_sender"), F.array(F.lit("order"), _text("o_custkey")).alias("title_words"), F.concat(F.lit("Order of "), F.when(key % 6 == 0, "nobody").otherwise(_text("o_custkey"))).alias("title"),
        F.array(_label("amount", F.concat(price.cast("string"), F.lit(" EUR"))), _label("object", F.lit("missing|Meter"))).alias("expected_labels"), F.array(_label("amount", F.concat(found.cast("string"), F.lit(" EUR"))), _label("object", F.lit("meter 123"))).alias("labels"), (key % 10).cast("double").alias("seconds"),
    )


@query("evaluation_rows", "SELECT o_orderkey, o_orderkey % 5 <> 0 AS status_right, o_orderkey % 2 = 0 AS type_right, o_orderkey % 3 <> 0 AS date_right, o_orderkey % 7 <> 0 AS sender_right, o_orderkey % 6 <> 0 AS title_right, 2 AS labels_expected, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS labels_found FROM orders")
def evaluation_rows(spark, sf_dir):
    """EVL1, EVL2: what of a row's expectations was met."""
    return observability.row_score(_expectations(spark, sf_dir)).select("o_orderkey", "status_right", "type_right", "date_right", "sender_right", "title_right", "labels_expected", "labels_found")


@query("evaluation_summary", "SELECT round(avg((o_orderkey % 5 <> 0 OR o_orderstatus = 'X')::INT), 6) AS status, round(avg((o_orderkey % 2 = 0)::INT), 6) AS type, round(avg((o_orderkey % 7 <> 0)::INT), 6) AS sender, round(avg((o_orderkey % 3 <> 0)::INT), 6) AS date, (list((o_orderkey % 10)::DOUBLE ORDER BY o_orderkey % 10))[count(*) // 2 + 1] AS median_seconds FROM orders")
def evaluation_summary(spark, sf_dir):
    """AGG14: accuracies and the upper median."""
    found = observability.evaluation(_expectations(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in ("status", "type", "sender", "date")], "median_seconds")


@query("evaluation_kinds", "SELECT 'amount' AS kind, count(*) AS rows, count(*) AS expected, count(*) FILTER (o_orderkey % 4 <> 0) AS found FROM orders UNION ALL SELECT 'object', count(*), count(*), count(*) FROM orders")
def evaluation_kinds(spark, sf_dir):
    """AGG14: coverage and expected labels found, by kind."""
    return observability.labels_by_kind_found(_expectations(spark, sf_dir))


@query("sender_writings", """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END AS value FROM documents WHERE source IS NOT NULL), s AS (SELECT lower(value) AS who, count(DISTINCT doc_id) AS docs, count(DISTINCT value) AS writings FROM l GROUP BY 1)
SELECT (SELECT count(DISTINCT value) FROM l) AS distinct_labels, round((SELECT avg(writings) FROM s WHERE docs > 1), 6) AS mean_writings""")
def sender_writings(spark, sf_dir):
    """AGG14: writings per recurring sender, different labels by kind."""
    value = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.upper("source"))
    some = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.lit("sender").alias("kind"), value.alias("value"))
    return observability.writings_per_sender(some).select("distinct_labels", F.round("mean_writings", 6).alias("mean_writings"))


@query("job_counts", "SELECT count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'click') AS reindexing, count(*) FILTER (event_type = 'purchase') AS reading_again FROM events WHERE event_id % 3 <> 0")
def job_counts(spark, sf_dir):
    """AGG12: active jobs by what they do."""
    kind = F.col("event_type")
    jobs = table(spark, sf_dir, "events").select(F.when(kind == "view", "ingest").when(kind == "click", "reindex").when(kind == "purchase", "reanalyse").otherwise("other").alias("kind"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("hashing").alias("state"))
    return observability.job_counts(jobs)


@query("trimmed_steps", """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' AND event_type = 'click' THEN '{"k":"' || user_id || '","n":' || event_id || ',"o":{"list":[1,"x"],"ok":true}}' ELSE '{"k":"' || user_id || '","n":' || event_id || ',"o":{"list":[1,"x"],"ok":true},"exchange":{"asked":"long"}}' END AS output FROM events""")
def trimmed_steps(spark, sf_dir):
    """PIP10: exchanges of model stages in old traces go."""
    steps = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("started_at"), F.concat(F.lit('{"k":"'), _text("user_id"), F.lit('","n":'), _text("event_id"), F.lit(',"o":{"list":[1,"x"],"ok":true},"exchange":{"asked":"long"}}')).alias("output"))
    return observability.trim_steps(steps, "2024-01-15", ["click"]).select("event_id", "output")


@query("redacted_logs", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS kept, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN props END AS stage FROM events")
def redacted_logs(spark, sf_dir):
    """SNK8: of a log line's fields the allowed ones stay."""
    name = F.when(F.col("event_id") % 2 == 0, "stage").otherwise("secret")
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), name, F.col("props")).alias("fields"))
    out = observability.redact(rows, "fields", ["kind", "stage"])
    return out.select("event_id", F.size("fields").alias("kept"), F.col("fields")["kind"].alias("kind"), F.try_element_at("fields", F.lit("stage")).alias("stage"))


# Vectors.


@query("vector_changes", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN label = 2 THEN 2 * x ELSE x END)), 3) + 0.0::DOUBLE AS total FROM embeddings WHERE label <> 1")
def vector_changes(spark, sf_dir):
    """VEC5: a snapshot after its changes: removed, and replaced twice."""
    vectors = table(spark, sf_dir, "embeddings")
    times = lambda n: F.transform("embedding", lambda x: (x * n).cast("float"))
    two = vectors.where("label = 2")
    changes = vectors.where("label = 1").select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(1).alias("seq")).unionByName(two.select("vec_id", times(9).alias("embedding"), F.lit(1).alias("seq"))).unionByName(two.select("vec_id", times(2).alias("embedding"), F.lit(2).alias("seq")))
    kept = search.with_changes(vectors, changes)
    return kept.select("vec_id", (F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 3) + 0.0).alias("total"))


@query("vector_bytes", "SELECT vec_id, 4 * len(embedding) AS size, round(list_sum(embedding::DOUBLE[]), 3) + 0.0::DOUBLE AS total FROM embeddings")
def vector_bytes(spark, sf_dir):
    """VEC2: vectors as little-endian bytes, and back."""
    packed = table(spark, sf_dir, "embeddings").select("vec_id", search.bytes_of_vector("embedding").alias("b"))
    return packed.select("vec_id", F.octet_length("b").cast("long").alias("size"), (F.round(F.aggregate(search.vector_of_bytes("b"), F.lit(0.0), lambda s, x: s + x), 3) + 0.0).alias("total"))


# Streams: everything there is now, each batch once, then what was written.


def _streamed(stream: DataFrame, spark: SparkSession) -> DataFrame:
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    folder = f"{base}/dossier-stream-{uuid.uuid4().hex}"
    arrivals.into(stream, f"{folder}/checkpoint", arrivals.snapshot_writer(f"{folder}/out")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


@query("settled_polls", "WITH p AS (SELECT user_id, ts, event_id % 2 AS size, event_type <> 'error' AS readable FROM events), l AS (SELECT *, readable AND size > 0 AND lag(size) OVER w = size AND lag(readable) OVER w AS alike FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, min(ts) AS settled_at, 1 AS size FROM l WHERE alike GROUP BY 1")
def settled_polls(spark, sf_dir):
    """SRC2: files whose polls say twice the same."""
    polls = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("polled_at"), (F.col("event_id") % 2).alias("size"), F.lit(0).alias("mtime"), (F.col("event_type") != "error").alias("readable"))
    return arrivals.settled(polls).select(F.col("path").alias("user_id"), "settled_at", F.col("size").cast("int").alias("size"))


@query("windowed_users", "SELECT user_id, date_trunc('day', d) AS day, count(*) AS n FROM (SELECT user_id, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY ALL")
def windowed_users(spark, sf_dir):
    """STR7, STR9: seven-day windows a day apart, by user."""
    found = arrivals.windowed(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at")), "at", ["user_id"])
    return found.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("streamed_contents", "SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM documents")
def streamed_contents(spark, sf_dir):
    """SRC1, SRC3, STR1, STR3, STR4, SNK3, SNK7: the first file of each content of a stream, written once per batch."""
    stream = arrivals.arrivals(spark, f"{sf_dir}/documents.parquet*", "doc_id long, text string")
    return _streamed(arrivals.without_copies(stream.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))), spark)


@query("streamed_events", "SELECT event_id, event_type FROM events WHERE value > 20")
def streamed_events(spark, sf_dir):
    """STR3, SNK7: a filtered stream, exactly once."""
    stream = arrivals.arrivals(spark, f"{sf_dir}/events.parquet*", "event_id long, event_type string, value double")
    return _streamed(stream.where("value > 20").select("event_id", "event_type"), spark)

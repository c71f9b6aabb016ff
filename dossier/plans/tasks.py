"""Search plans, grouping trees, task sets, conversations and contexts (FLT6-7, AGG16, SNK6, TXT17, PIP2-3, PIP6-19)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.labels import TIMES, overlaps, span
from dossier.functions.text import fold, natural_key, search_key
from dossier.operators.filters import positions, with_labels
from dossier.operators.search import Phrase, bm25


def _has(labels: Column, kind: str, asked: Sequence[str]) -> Column:
    """Whether one of a kind's labels fits one of the asked values: spans overlap, other values are within as whole words."""
    padded = lambda c: F.concat(F.lit(" "), search_key(c), F.lit(" "))
    if kind in TIMES:
        spans = F.array(*[span(F.lit(v)) for v in asked])
        return F.exists(labels, lambda x: (x["kind"] == kind) & F.coalesce(F.exists(spans, lambda s: overlaps(span(x["value"]), s)), F.lit(False)))
    values = F.array(*map(F.lit, asked))
    return F.exists(labels, lambda x: (x["kind"] == kind) & F.exists(values, lambda v: padded(x["value"]).contains(padded(v))))


@dataclass(frozen=True)
class SearchPlan:
    """Labels (kind, value): one kind's are alternatives, kinds narrow; words all occur; grouping kinds."""

    labels: Sequence[tuple[str, str]] = ()
    words: Sequence[str] = ()
    grouping: Sequence[str] = field(default_factory=lambda: ("type", "sender"))

    def matches(self, labels: Column) -> Column:
        """FLT6 on a document's array of labels."""
        out = F.lit(True)
        for kind in dict.fromkeys(k for k, _ in self.labels):
            out = out & _has(labels, kind, [v for k, v in self.labels if k == kind])
        return out

    def documents(self, docs: DataFrame, fields: dict[str, str], limit: int = 1000) -> DataFrame:
        """FLT7: docs (doc_id, labels, ..) that the plan finds, newest document date first; an empty plan finds none."""
        if not self.labels and not self.words:
            return docs.limit(0)
        found = docs.where(self.matches(F.col("labels")))
        if self.words:
            hits = bm25(docs, fields, [Phrase((w,)) for w in self.words])
            found = found.join(hits.select("doc_id"), "doc_id", "left_semi")
        date = F.get(F.filter("labels", lambda x: x["kind"] == "date"), 0)["value"]
        return found.orderBy(F.desc_nulls_last(date), "doc_id").limit(limit)


def group_values(labels: Column, kinds: Sequence[str]) -> list[Column]:
    """The level of each kind: its first label, the year for kinds of time, null without one."""
    first = lambda k: F.get(F.filter(labels, lambda x: x["kind"] == k), 0)["value"]
    return [F.when(F.lit(k in TIMES), F.substring(first(k), 1, 4)).otherwise(first(k)) for k in kinds]


def grouping_tree(docs: DataFrame, levels: Sequence[str]) -> DataFrame:
    """AGG16: documents at every prefix of the levels (columns), by rollup."""
    return docs.rollup(*levels).agg(F.count(F.lit(1)).alias("documents"), F.grouping_id().alias("depth_mask"))


def folded_groups(docs: DataFrame, levels: Sequence[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """AGG16: (depth, <kinds>, documents, place): the groups of a tree with a level (kind, column) for each kind.

    Values that are alike when folded are one group, named as its document of the least key has it; values of kinds of time
    are grouped as they are, the newest first; the others stand in natural order, documents without a value last. place is
    a group's place in the tree, before its own groups.
    """
    kinds = [k for k, _ in levels]
    folded = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.nullif(search_key(F.col(c)), F.lit("")), F.col(c)))
    keyed = docs.select(key, *[(F.col(c) if k in TIMES else folded(c)).alias(f"k_{k}") for k, c in levels], *[F.col(c).alias(f"v_{k}") for k, c in levels])
    grouped, groups = [f"k_{k}" for k in kinds], None
    # A level's name is that of its own group, not of the groups below it.
    for depth in range(1, len(kinds) + 1):
        name = F.min_by(f"v_{kinds[depth - 1]}", key).alias("name")
        one = keyed.groupBy(*grouped[:depth]).agg(F.count(F.lit(1)).alias("documents"), name)
        if groups is not None:
            same = [F.col(f"up.{c}").eqNullSafe(F.col(f"own.{c}")) for c in grouped[: depth - 1]]
            one = one.alias("own").join(groups[-1].alias("up"), same).select("own.*", *[F.col(f"up.{k}") for k in kinds[: depth - 1]])
        groups = [*(groups or []), one.withColumnRenamed("name", kinds[depth - 1])]
    out = None
    for depth, one in enumerate(groups, 1):
        row = one.select(F.lit(depth).alias("depth"), *[(F.col(k) if n < depth else F.lit(None).cast("string")).alias(k) for n, k in enumerate(kinds)], "documents")
        out = row if out is None else out.unionByName(row)
    order = []
    for n, k in enumerate(kinds):
        here = F.col("depth") > n
        order += [F.when(here, F.when(F.col(k).isNull(), 2).otherwise(1)).otherwise(0), *([F.desc_nulls_last(k)] if k in TIMES else [natural_key(F.coalesce(k, F.lit(""))), F.col(k)])]
    return positions(out, order, "place")


def collision_names(files: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """TXT17, SNK6: `name (n)` from the second file of a folded name in a folder."""
    place = F.row_number().over(Window.partitionBy(folder, fold(F.col(name))).orderBy(key))
    stem, dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("export_name", F.when(place == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), place.cast("string"), F.lit(")"), dot)))


def export_manifest(files: DataFrame, levels: Sequence[str], name: str, key: str, readable: Column) -> DataFrame:
    """SNK6: (path, key, skipped): each file's place in the export by its levels, `Other` without one, with a reason if it is skipped."""
    parts = [F.coalesce(F.nullif(F.regexp_replace(F.trim(F.col(c)), r"[/:\\\\]", "-"), F.lit("")), F.lit("Other")) for c in levels]
    placed = collision_names(files.withColumn("folder", F.concat_ws("/", *parts)).withColumn("skipped", F.when(~readable, "unreadable")), "folder", name, key)
    return placed.select(F.when(F.col("skipped").isNull(), F.concat_ws("/", "folder", "export_name")).alias("path"), key, "skipped")


def add_by_labels(docs: DataFrame, labels: DataFrame, selected: Sequence[tuple[str, str]], members: DataFrame, most: int = 1000) -> DataFrame:
    """PIP12: documents with all the selected labels that aren't in the set yet, the newest ``most`` of them."""
    found = with_labels(docs, labels, selected).join(members, "doc_id", "left_anti")
    return found.orderBy(F.desc_nulls_last("added_at"), F.desc("doc_id")).limit(most)


#: PIP9: what a review action makes of a document's state; undo takes the last one back.
REVIEW = {"confirm": "filed", "hold": "needsReview", "remove": "removed", "putBack": "needsReview", "retry": "pending"}


def reviewed(events: DataFrame) -> DataFrame:
    """PIP9: (doc_id, state, n): each document's state after its review events (doc_id, id, action), in order.

    An undo takes back the last action that isn't taken back yet.
    """
    state = F.create_map(*[F.lit(x) for pair in REVIEW.items() for x in pair])
    ordered = events.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "action"))).alias("all"))  # of one document
    done = F.aggregate("all", F.array().cast("array<string>"), lambda acc, e: F.when(e["action"] == "undo", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(F.map_contains_key(state, e["action"]), F.concat(acc, F.array(e["action"]))).otherwise(acc))
    return ordered.select("doc_id", done.alias("done")).select("doc_id", F.coalesce(F.try_element_at(state, F.element_at(F.when(F.size("done") > 0, F.col("done")), -1)), F.lit("needsReview")).alias("state"), F.size("done").cast("long").alias("n"))


def maintain_set(members: DataFrame, found: DataFrame) -> DataFrame:
    """PIP11: (doc_id, inclusion, seq): found ones join, stale matches leave, removed stay out, added stay in."""
    both = members.join(found.select("doc_id", F.lit(True).alias("found")).distinct(), "doc_id", "full_outer")
    inclusion = F.when(F.col("inclusion").isin("added", "removed"), F.col("inclusion")).when(F.col("found"), "matched")
    kept = both.withColumn("inclusion", inclusion).where("inclusion IS NOT NULL")
    last = members.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    known = kept.where("seq IS NOT NULL").select("doc_id", "inclusion", F.col("seq").cast("long").alias("seq"))
    fresh = positions(kept.where("seq IS NULL").select("doc_id", "inclusion"), ["doc_id"], "seq").crossJoin(F.broadcast(last))  # last is one row
    return known.unionByName(fresh.select("doc_id", "inclusion", (F.col("last") + F.col("seq")).alias("seq"))).withColumn("seq", F.col("seq").cast("int"))


def timeline(turns: DataFrame, events: DataFrame, key: str | None = None) -> DataFrame:
    """PIP13: turns and later changes of a conversation in one order, changes before a turn of the same instant.

    With a key the conversations of a whole table, each row with its place in its own.
    """
    some = [key] if key else []
    both = turns.select(*some, "at", F.lit(1).alias("order"), F.col("id").alias("position"), "text").unionByName(events.select(*some, "at", F.lit(0).alias("order"), F.col("id").alias("position"), F.col("summary").alias("text")))
    if key is None:
        return both.orderBy("at", "order", "position")
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at", "order", "position")))


def history_budget(turns: DataFrame, task: str, seq: str, text: str, budget: int = 4000) -> DataFrame:
    """PIP14, WIN6: the newest turns whose texts together fit the budget."""
    used = F.sum(F.length(text)).over(Window.partitionBy(task).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("used", used).where(F.col("used") <= budget)


def context_order(members: DataFrame, sources: DataFrame, relevance: DataFrame, seen: str = "seq", score: str = "place", date: str = "date") -> DataFrame:
    """PIP14: members (question, doc_id, ..) with their place in a question's context.

    First what the last answer was made from, in its order (sources: question, doc_id, seq), then what is relevant
    (relevance: question, doc_id, place), then the others by date, the newest first, without one last; of equals the
    smaller id. Sources and relevant documents that are no members don't count.
    """
    by = ["question", "doc_id"]
    first = sources.groupBy(*by).agg(F.min(seen).alias("_seq"))
    near = relevance.groupBy(*by).agg(F.min(score).alias("_near"))
    both = members.join(first, by, "left").join(near, by, "left")
    order = Window.partitionBy("question").orderBy(F.asc_nulls_last("_seq"), F.when(F.col("_seq").isNull(), F.col("_near")).asc_nulls_last(), F.desc_nulls_last(date), "doc_id")
    return both.withColumn("place", F.row_number().over(order)).select(*members.columns, "place")


def pack_context(candidates: DataFrame, budget: int = 20_000, each: int = 8000, listed: int = 30) -> DataFrame:
    """PIP14: per question, documents in order while they fit; those passed over are listed. (question, doc_id, use, taken).

    A question ends when its list is full and a text no longer fits. Rows come sorted; nothing but the question's room
    and list are kept, whatever its number of candidates.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        question, room, passed, over = None, budget, 0, False
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if r.question != question:
                    question, room, passed, over = r.question, budget, 0, False
                size = min(int(r.chars), each)
                if over:
                    continue
                if size <= room:
                    room -= size
                    rows.append((r.question, r.doc_id, "shown", size))
                elif passed < listed:
                    passed += 1
                    rows.append((r.question, r.doc_id, "listed", 0))
                else:
                    over = True
            yield pd.DataFrame(rows, columns=["question", "doc_id", "use", "taken"])

    kind = candidates.schema["question"].dataType.simpleString()
    some = candidates.select("question", "doc_id", "place", "chars").repartition("question").sortWithinPartitions("question", "place", "doc_id")
    return some.mapInPandas(pack, f"question {kind}, doc_id long, use string, taken long")


#: States of a job that has not ended; "running" is that of stores without stages.
ACTIVE = ("pending", "hashing", "extracting", "analysing", "filing", "running")
#: Kinds of the jobs that read a document in, and the states of these that need no model yet.
READING_IN, BEFORE_THE_MODEL = ("ingest", "adopt"), ("pending", "hashing")


def due_jobs(jobs: DataFrame, now: str, giving_way: bool = True, before_the_model: bool = False) -> DataFrame:
    """FLT11, PIP2: active jobs whose time has come, in the queue's order.

    A reanalyse job waits while its document's reading in is active; jobs without kind and doc_id wait for none.
    before_the_model keeps only those whose next stage needs no model, which needs their kind.
    """
    active = jobs.where(F.col("state").isin(*ACTIVE))
    due = active.where(F.col("next_run_at").isNull() | (F.col("next_run_at") <= F.lit(now).cast("timestamp")))
    if {"kind", "doc_id"} <= set(jobs.columns):
        read_in = active.where(F.col("kind").isin(*READING_IN)).select(F.lit("reanalyse").alias("kind"), "doc_id").distinct()
        due = due.join(read_in, ["kind", "doc_id"], "left_anti").select(*jobs.columns)
    if before_the_model:
        due = due.where(F.col("kind").isin(*READING_IN) & F.col("state").isin(*BEFORE_THE_MODEL))
    if not giving_way:
        due = due.where(~F.col("gives_way"))
    return positions(due, ["gives_way", "id"], "turn")


def enqueue(active: DataFrame, requests: DataFrame) -> DataFrame:
    """PIP3: one job per path; the stronger request wins, tags join."""
    both = active.unionByName(requests)
    merged = both.groupBy("source_path").agg(F.max_by(F.struct("kind", "id"), F.struct("strength", -F.col("id"))).alias("j"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    return merged.select("source_path", "j.kind", "j.id", "tags")


def reconcile(index: DataFrame, found: DataFrame) -> DataFrame:
    """PIP6, PIP19: what became of indexed files: kept, moved (by uid, else by inode and size), missing, or new."""
    by_path = index.join(found.select(F.col("path"), F.col("uid").alias("f_uid")), "path")
    kept = by_path.where(F.col("f_uid").isNull() | (F.col("uid") == F.col("f_uid"))).select("uid", F.col("path"), F.lit("kept").alias("fate"))
    rest, free = index.join(kept, "uid", "left_anti"), found.join(kept, "path", "left_anti")
    by_uid = rest.join(free.where("uid IS NOT NULL").select("uid", F.col("path").alias("to")), "uid").groupBy("uid").agg(F.min("to").alias("path")).withColumn("fate", F.lit("moved"))
    rest, free = rest.join(by_uid, "uid", "left_anti"), free.join(by_uid, "path", "left_anti")
    single = free.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("inode", "size"))).where("n = 1")
    by_node = rest.join(single.select("inode", "size", F.col("path").alias("to")), ["inode", "size"]).select("uid", F.col("to").alias("path"), F.lit("moved").alias("fate"))
    missing = rest.join(by_node, "uid", "left_anti").select("uid", "path", F.lit("missing").alias("fate"))
    new = free.join(by_node, "path", "left_anti").select("uid", "path", F.lit("new").alias("fate"))
    return kept.unionByName(by_uid.select("uid", "path", "fate")).unionByName(by_node).unionByName(missing).unionByName(new)


def merge_records(current: DataFrame, parsed: DataFrame, replacing: bool = False) -> DataFrame:
    """PIP8: records by uid: parsed ones win; others stay unless replacing; two paths of one uid are a conflict."""
    chosen = parsed.groupBy("uid").agg(F.min_by(F.struct(*[c for c in parsed.columns if c != "uid"]), "path").alias("p"), (F.countDistinct("path") > 1).alias("conflict"))
    both = current.withColumn("known", F.lit(True)).join(chosen, "uid", "full_outer")
    kept = both.where("p IS NOT NULL") if replacing else both
    columns = [F.coalesce(F.col(f"p.{c}"), F.col(c)).alias(c) for c in current.columns if c != "uid"]
    return kept.select("uid", *columns, F.coalesce("conflict", F.lit(False)).alias("conflict"))


def carrier(files: DataFrame) -> DataFrame:
    """PIP18: which of the files of one uid is the document; the others are copies."""
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    rank = F.when(n == 1, 0).when((F.col("path") == F.col("recorded_path")) & ~F.col("unsure"), 1).when(F.col("inode") == F.col("recorded_inode"), 2).when(F.col("path") == F.col("recorded_path"), 3).otherwise(4)
    depth = F.size(F.split("path", "/"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy("rank", "depth", "path"))
    return files.withColumn("rank", rank).withColumn("depth", depth).withColumn("carrier", place == 1).drop("rank", "depth")


def contained(passages: DataFrame, texts: DataFrame, passage: str = "passage", text: str = "text") -> DataFrame:
    """JN13: passages grounded in the text of the same row's document: every word of three letters or more is in it."""
    long = lambda c: F.filter(F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    joined = passages.join(texts, "doc_id")
    return joined.withColumn("grounded", F.size(F.array_except(long(F.col(passage)), long(F.col(text)))) == 0)


def holders(passages: DataFrame, texts: DataFrame, key: str, text: str = "text", most: int = 20_000) -> DataFrame:
    """JN13: (key, doc_id): documents that hold a whole passage, word for word.

    A document meets the passages whose first words it has in a row; only of these it is asked whether it holds them. Up to
    ``most`` passages, which are counted, their first words go to the documents; more are met by a shuffled join.
    """
    words = lambda c: F.split(c, r"\s+")
    head = lambda w: F.xxhash64(F.array_join(F.slice(w, 1, 4), " "))
    asked = passages.where(F.col(text).isNotNull()).select(key, F.col(text).alias("passage"), head(words(F.col(text))).alias("h"))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 4), " ")))
    docs = texts.select("doc_id", text, words(F.col(text)).alias("w"))
    known = [r["h"] for r in asked.select("h").distinct().limit(most + 1).collect()]
    if len(known) <= most:
        # The passages' heads are a literal: what a document doesn't share is never a row.
        some = docs.select("doc_id", text, F.explode(F.array_intersect(heads, F.array(*map(F.lit, known)).cast("array<bigint>"))).alias("h"))
        met = some.join(asked, "h")
    else:
        pairs = docs.select("doc_id", F.explode(F.array_distinct(heads)).alias("h")).join(asked.select(key, "h"), "h").select("doc_id", key)
        met = pairs.join(asked.select(key, "passage"), key).join(docs.select("doc_id", text), "doc_id")
    return met.where(F.col(text).contains(F.col("passage"))).select(key, "doc_id")

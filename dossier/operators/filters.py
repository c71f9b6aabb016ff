"""Filters, facets, joins and orders over documents and their labels (FLT*, JN*, AGG1-AGG4, AGG17, RNK5-6, SRT*)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.labels import kind_rank
from dossier.functions.text import fold, natural_key
from dossier.operators.vocabulary import key_literal, keys_of, same_writing

#: Sets of statuses, and their severity where a step's worst counts.
STATUSES = {
    "waits_for_user": ["needsReview", "failed"], "set_aside": ["duplicate", "cancelled"], "unfinished": ["pending", "processing"], "processed": ["filed", "done", "duplicate", "needsReview"],
    "in_archive": ["filed", "done"], "takes_copies": ["filed", "done", "needsReview"],
}
SEVERITY = ["skipped", "ok", "warn", "error"]


def in_folder(path: Column, root: str) -> Column:
    """FLT3: paths below a folder, as a range that a scan can prune."""
    return (path >= f"{root}/") & (path < f"{root}0")


@dataclass(frozen=True)
class DocumentFilter:
    """FLT1: statuses, selected labels (kind, value) and a folder, all of which must hold."""

    statuses: Sequence[str] = ()
    labels: Sequence[tuple[str, str]] = ()
    within: str | None = None
    written: bool = field(default=True)  # labels match by writing, not by the exact value

    def apply(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
        out = docs
        if self.statuses:
            out = out.where(F.col("status").isin(sorted(self.statuses)))
        if self.within:
            out = out.where(in_folder(F.col("path"), self.within))
        return with_labels(out, labels, self.labels, self.written, key)


def with_labels(docs: DataFrame, labels: DataFrame, selected: Sequence[tuple[str, str]], written: bool = True, key: str = "doc_id") -> DataFrame:
    """FLT4, FLT5: documents that have every selected label; one pass over the labels for all of them."""
    if not selected:
        return docs
    if written:
        labels = labels.where(F.col("kind").isin(sorted({k for k, _ in selected}))).withColumn("_k", keys_of("value"))
        fits = [(F.col("kind") == k) & same_writing(F.col("_k"), key_literal(v)) for k, v in selected]
    else:
        fits = [(F.col("kind") == k) & (F.col("value") == v) for k, v in selected]
    any_fit = fits[0]
    for f in fits[1:]:
        any_fit = any_fit | f
    found = labels.where(any_fit).groupBy(key).agg(*[F.bool_or(f).alias(f"has{i}") for i, f in enumerate(fits)])
    return docs.join(found.where(" AND ".join(f"has{i}" for i in range(len(fits)))), key, "left_semi")


def usage(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG1: documents by label."""
    return labels.groupBy("kind", "value").agg(F.countDistinct(key).alias("documents"))


def listing(labels: DataFrame, added: DataFrame) -> DataFrame:
    """AGG3: usage with the added labels (kind, value) that no document has yet."""
    used = usage(labels)
    return used.unionByName(added.join(used, ["kind", "value"], "left_anti").distinct().withColumn("documents", F.lit(0).cast("long")))


def ranked(used: DataFrame) -> DataFrame:
    """AGG4: place of each label in its kind, by use and then value."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("documents"), "value"))
    return used.select("kind", "value", "documents", place.alias("place"), kind_rank(F.col("kind")).cast("long").alias("kind_order"))


def matching_labels(used: DataFrame, text: str) -> DataFrame:
    """FLT12: labels whose folded value holds the folded text."""
    return used.where(fold(F.col("value")).contains(fold(F.lit(text))))


def newest_of_label(labels: DataFrame, docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """AGG17: the newest n documents of each label."""
    place = F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.desc("added_at"), F.desc(key)))
    return labels.join(docs, key).withColumn("place", place).where(F.col("place") <= n)


def in_order_of(docs: DataFrame, ids: Sequence[int], key: str = "doc_id") -> DataFrame:
    """SRC19: the documents of a list of ids in the list's order, with their position in it."""
    asked = docs.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, position int")
    return docs.join(F.broadcast(asked), key).orderBy("position")  # the caller's own list


def positions(rows: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """rows with their place in an order of the whole table, from 1, without bringing it to one task.

    Rows are sorted in ranges; a range's places begin after the ranges before it. Ties are the caller's to break.
    """
    # One shuffle: an id has the range in its upper bits and the place in the sorted range in its lower 33.
    numbered = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", numbered).persist()  # read twice: ranges must not move
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    counted = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = counted.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + place).select(*rows.columns, name)


def document_order(date: Column, name: Column, key: Column) -> list[Column]:
    """RNK5: newest date first, without a date last, then names in natural order."""
    return [F.desc_nulls_last(date), natural_key(name), key]


#: RNK6: the other orders of a listing.
OTHER_ORDERS = {"added": ["added_at"], "filed_or_added": ["filed_at", "added_at"], "filed": ["filed_at"]}


def other_order(name: str, key: str = "doc_id") -> list[Column]:
    """RNK6: newest first by when a document was added, filed (or else added), or filed; without a date last."""
    return [F.desc_nulls_last(F.coalesce(*OTHER_ORDERS[name])), F.desc(key)]


def history(events: DataFrame, kinds: Sequence[str] = (), document: int | None = None, before: str | None = None, at: str = "at") -> DataFrame:
    """FLT9: events of some kinds, of a document, before an instant, as far as given."""
    out = events.where(F.col("kind").isin(list(kinds))) if kinds else events
    out = out if document is None else out.where(F.col("doc_id") == document)
    return out if before is None else out.where(F.col(at) < F.lit(before).cast(events.schema[at].dataType))


def page_before(events: DataFrame, before: str, size: int, at: str = "at", key: str = "id") -> DataFrame:
    """SRT3: the newest events before an instant."""
    return events.where(F.col(at) < F.lit(before).cast("timestamp")).orderBy(F.desc(at), F.desc(key)).limit(size)


def oldest_copy(docs: DataFrame, digest: Column, key: str = "doc_id", takes: Column | None = None) -> DataFrame:
    """JN12, PIP5: (key, copy_of): documents whose content an older one has that takes copies."""
    rows = docs.select(F.col(key), digest.alias("digest"), (takes if takes is not None else F.lit(True)).alias("takes"))
    oldest = rows.where("takes").groupBy("digest").agg(F.min(key).alias("copy_of"))
    return rows.join(oldest, "digest").where(F.col(key) > F.col("copy_of")).select(key, "copy_of")


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """WIN3, SNK1, SNK2: the row of the greatest `by` of each key, by an aggregation that combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("row"))
    return best.select(*keys, "row.*")

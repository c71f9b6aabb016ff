"""A stored full-text index (FTS1, FTS4-FTS7, FTS11): positional postings, read by the terms of a query.

``build`` cuts the documents into blocks of a bounded number of tokens, and writes a row per term, field and block: the
documents of the block that hold the term, the places of the term in each, and the number of tokens of each in all
fields. Rows lie in folders by a hash of the term's first two characters (``slot``), ordered by term in files dealt by
term and document, so that a frequent term is many files and a rare one part of some. A query names its terms: an exact
word or a prefix of two characters or more reads one folder, there the row groups whose range holds it. Neither texts nor
lengths of documents are read. Corpus statistics are one stored row.

A phrase is met by its places: per document and field, the places of its words, each moved back by its place in the
phrase, have to agree. Scores are those of ``search.bm25``.

Later documents go in by ``append``: a segment beside the others. A document that is written again, or removed, counts
in its last segment only; the list of documents with their last segment is read only when there is more than one.

Defined cases: null and empty texts have no terms, but count as documents; a null id is left out, since nothing could
tell what to find; rows of one id in one segment are one document, whose texts follow each other. An empty table gives
an index that finds nothing. A query without a term finds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import tokens
from dossier.operators.search import B, CANDIDATES, FLOOR, K1, LEAST_IDF, WEIGHTS, Phrase, folded_words, fuse, top, vector_top

LEAD, SLOTS = 2, 128
#: Tokens of a block, about, and the folder of the rows that list a block's documents.
BLOCK, LISTED = 1 << 19, -1
PACKED = "term string, field string, docs array<long>, dls array<int>, starts array<int>, places array<int>"


@dataclass(frozen=True)
class TextIndex:
    """A folder of segments with postings, documents and statistics."""

    spark: SparkSession
    path: str

    def segments(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        # The statistics are written last: a segment without them isn't there yet.
        return sorted(int(n[8:]) for n in names if n.startswith("segment=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/stats/_SUCCESS")))

    def read(self, kind: str) -> DataFrame:
        schema = {"postings": f"{PACKED}, slot int", "documents": "doc_id long, dl int, removed boolean", "stats": "docs long, tokens long"}[kind]
        found = None
        for n in self.segments():
            one = self.spark.read.schema(schema).parquet(f"{self.path}/segment={n}/{kind}").withColumn("segment", F.lit(n))
            found = one if found is None else found.unionByName(one)
        return found


def slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LEAD)), F.lit(SLOTS)).cast("int")


def _packed(fields: list[str]):
    """(doc_id, dl, tokens of each field) to PACKED rows of a block: one per term and field, and one of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(batch.column("dl").to_numpy().astype(np.int64)) // BLOCK
            cuts = np.r_[0, np.flatnonzero(np.diff(held)) + 1, batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end > start:
                    some = batch.slice(start, end - start)
                    docs, dls = some.column("doc_id").to_numpy(), some.column("dl").to_numpy()
                    yield _rows_of(None, None, np.array([0]), docs, dls, np.zeros(len(docs) + 1, np.int32), np.empty(0, np.int32), np.array([0, len(docs)]))
                    for f in fields:
                        if (made := _terms(f, some.column(f"t_{f}"), docs, dls)) is not None:
                            yield made

    return run


def _terms(field: str, lists: pa.ListArray, docs: np.ndarray, dls: np.ndarray) -> pa.RecordBatch | None:
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return None
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")  # documents and places stay in order
    codes, row = codes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    place = (order - (np.cumsum(sizes) - sizes)[row]).astype(np.int32)
    new = np.r_[True, codes[1:] != codes[:-1]]
    first = np.flatnonzero(new | np.r_[True, row[1:] != row[:-1]])  # of a term in a document
    terms = np.flatnonzero(new[first])
    return _rows_of(coded.dictionary.take(pa.array(codes[first[terms]])), field, np.append(first, len(place)), docs[row[first]], dls[row[first]], None, place, np.append(terms, len(first)))


def _rows_of(terms: pa.Array | None, field: str | None, at: np.ndarray, docs: np.ndarray, dls: np.ndarray, starts: np.ndarray | None, places: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Rows over stretches ``cuts`` of documents; at: where each document's places start, and where the last one's end."""
    n = len(cuts) - 1
    if starts is None:  # of each row from 0, one more than it has documents
        sizes = np.diff(cuts)
        begin = np.repeat(cuts[:-1], sizes + 1)
        index = np.arange(len(docs) + n) - np.repeat(np.arange(n), sizes + 1)
        starts, ends = (at[index] - at[begin]).astype(np.int32), at[cuts]
    else:
        ends = np.zeros(n + 1, np.int64)
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.string()) if terms is None else terms, pa.array([field] * n, pa.string()), listed(cuts, docs), listed(cuts, dls), listed(cuts + np.arange(n + 1), starts), listed(ends, places)],
        ["term", "field", "docs", "dls", "starts", "places"],
    )


def _write(docs: DataFrame, fields: dict[str, str], path: str, key: str, partitions: int | None) -> None:
    spark = docs.sparkSession
    cut = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), *[tokens(F.col(c)).alias(f"t_{f}") for f, c in fields.items()])
    dl = sum((F.size(f"t_{f}") for f in fields), F.lit(0))
    rows = cut.withColumn("dl", dl.cast("int")).mapInArrow(_packed(list(fields)), PACKED).withColumn("slot", F.when(F.col("term").isNull(), LISTED).otherwise(slot(F.col("term"))))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The one shuffle: a folder's rows are dealt to several tasks by document.
    pieces = -(-8 * n // SLOTS)
    rows.repartition(n, "slot", F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(pieces))).sortWithinPartitions("slot", "term").write.option("compression", "zstd").partitionBy("slot").parquet(f"{path}/postings")
    listed = spark.read.schema(f"{PACKED}, slot int").parquet(f"{path}/postings").where(F.col("slot") == LISTED)
    listed.select(F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("dls").alias("dl")))).select("doc_id", "dl", F.lit(False).alias("removed")).write.parquet(f"{path}/documents")


def _stats(spark: SparkSession, path: str) -> None:
    held = spark.read.parquet(f"{path}/documents").where("NOT removed")
    held.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")).coalesce(1).write.parquet(f"{path}/stats")


def build(docs: DataFrame, fields: dict[str, str], path: str, key: str = "doc_id", partitions: int | None = None) -> TextIndex:
    """An index of a table in a folder of its own; fields: name of a field to its column."""
    one = _whole_documents(docs, fields, key)
    _write(one, fields, f"{path}/segment=0", key, partitions)
    _stats(docs.sparkSession, f"{path}/segment=0")
    return TextIndex(docs.sparkSession, path)


def _whole_documents(docs: DataFrame, fields: dict[str, str], key: str) -> DataFrame:
    """Rows of one id joined to one row; where ids are unique, which is counted, the table as it is."""
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return docs
    columns = sorted(set(fields.values()))
    marked = docs.select(key, *columns).join(repeated, key, "left_semi").groupBy(key).agg(*[F.array_join(F.sort_array(F.collect_list(c)), "\n").alias(c) for c in columns])  # of one document
    return docs.select(key, *columns).join(repeated, key, "left_anti").unionByName(marked)


def append(index: TextIndex, docs: DataFrame, fields: dict[str, str], removed: DataFrame | None = None, key: str = "doc_id", partitions: int | None = None) -> TextIndex:
    """Documents that are new, or replace what stood under their ids, and ids (key) that go."""
    number = max(index.segments(), default=-1) + 1
    path = f"{index.path}/segment={number}"
    _write(_whole_documents(docs, fields, key), fields, path, key, partitions)
    if removed is not None:
        gone = removed.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id")).distinct().join(docs.select(F.col(key).cast("long").alias("doc_id")), "doc_id", "left_anti")
        gone.select("doc_id", F.lit(0).alias("dl"), F.lit(True).alias("removed")).write.mode("append").parquet(f"{path}/documents")
    _stats(index.spark, path)
    return index


def kept(docs: DataFrame, fields: dict[str, str], key: str = "doc_id") -> TextIndex:
    """The index of a table of files, built once and found again while the files are the same ones.

    It lies in the folder that all executors share, named by a digest of the files' paths, sizes and times.
    """
    spark = docs.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    listed = []
    for name in sorted(docs.inputFiles()):
        file = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = file.getFileSystem(conf).getFileStatus(file)
        listed.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    digest = hashlib.sha256("\n".join([*listed, key, *map(str, sorted(fields.items())), "2"]).encode()).hexdigest()[:24]
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    index = TextIndex(spark, f"{folder.rstrip('/')}/dossier-index-{digest}")
    if not index.segments():
        path = spark._jvm.org.apache.hadoop.fs.Path(index.path)
        path.getFileSystem(conf).delete(path, True)  # an unfinished one
        build(docs, fields, index.path, key)
    return index


def _fits(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def _either(some: list[Column]) -> Column:
    out = some[0]
    for one in some[1:]:
        out = out | one
    return out


def _rows(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(term, field, segment, doc_id, dl, places) of the phrases' words. Both conditions reach the scan: the folders, and the terms' ranges in them."""
    asked = [(w, p.prefix and j == len(words) - 1, p.field) for p in phrases for words in [folded_words(p)] for j, w in enumerate(words)]
    if not any(prefix and len(w) < LEAD for w, prefix, _ in asked):
        postings = postings.where(_either([F.col("slot") == slot(F.lit(w)) for w in dict.fromkeys(w for w, _, _ in asked)]))
    found = postings.where(_either([_fits(w, prefix) & (F.col("field") == f) if f else _fits(w, prefix) for w, prefix, f in asked]))
    start = lambda i: F.get("starts", i)
    one = lambda i: F.struct(F.get("docs", i).alias("doc_id"), F.get("dls", i).alias("dl"), F.slice("places", start(i) + 1, start(i + 1) - start(i)).alias("places"))
    return found.select("term", "field", "segment", F.inline(F.transform(F.sequence(F.lit(0), F.size("docs") - 1), one)))


def _hits(rows: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(doc_id, dl, tf0, tf1, ...) of postings: weighted hits of each phrase."""
    words = [folded_words(p) for p in phrases]
    fits = lambda i, j: _fits(words[i][j], phrases[i].prefix and j == len(words[i]) - 1)
    weight = F.coalesce(F.try_element_at(F.create_map(*[x for f, w in WEIGHTS.items() for x in (F.lit(f), F.lit(w))]), F.col("field")), F.lit(1.0))
    several = [i for i, w in enumerate(words) if len(w) > 1]
    hits = [F.sum(F.when(fits(i, 0), F.size("places")).otherwise(0)).alias(f"h{i}") if i not in several else _together([fits(i, j) for j in range(len(w))]).alias(f"h{i}") for i, w in enumerate(words)]
    by_field = rows.groupBy("doc_id", "dl", "field").agg(*hits)
    return by_field.groupBy("doc_id", "dl").agg(*[F.sum(F.when(F.lit(p.field is None) | (F.col("field") == F.lit(p.field)), weight * F.col(f"h{i}")).otherwise(0.0)).alias(f"tf{i}") for i, p in enumerate(phrases)])


def _together(fits: list[Column]) -> Column:
    """Places at which words stand in a row: those of each word (of one document and field), moved back, that agree."""
    back = lambda j: F.transform("places", lambda x: x - j)
    moved = [F.flatten(F.collect_list(F.when(fit, back(j)))) for j, fit in enumerate(fits)]
    out = moved[0]
    for more in moved[1:]:
        out = F.array_intersect(out, more)
    return F.size(out)


def bm25(index: TextIndex, phrases: list[Phrase], any_of: bool = False, within: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """FTS5, FTS6: (key, score) of the documents with all phrases, or any; statistics are the whole corpus's."""
    phrases = [p for p in phrases if folded_words(p)]
    segments = index.segments()
    if not phrases or not segments:
        return index.spark.createDataFrame([], f"`{key}` long, score double")
    rows = _rows(index.read("postings"), phrases)
    stats = index.read("stats").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    if len(segments) > 1:
        last = Window.partitionBy("doc_id").orderBy(F.desc("segment"))
        current = index.read("documents").withColumn("turn", F.row_number().over(last)).where("turn = 1 AND NOT removed").select("doc_id", "dl", "segment")
        rows = rows.join(current.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        stats = current.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
    found = _hits(rows, phrases)
    n = range(len(phrases))
    one = stats.crossJoin(found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in n])).select("*", (F.col("tokens") / F.col("docs")).alias("avgdl"))  # rows of one
    scored = found.where(" OR ".join(f"tf{i} > 0" for i in n) if any_of else " AND ".join(f"tf{i} > 0" for i in n))
    if within is not None:
        scored = scored.join(within.select(F.col(key).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    scored = scored.crossJoin(F.broadcast(one))  # a single row
    idf = lambda i: F.greatest(F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select(F.col("doc_id").alias(key), sum((part(i) for i in n), F.lit(0.0)).alias("score"))


def within_set(index: TextIndex, phrases: list[Phrase], vectors: DataFrame, query: list[float], ids: DataFrame, floor: float = FLOOR, key: str = "doc_id", column: str = "embedding", digits: tuple[int, int] | None = None) -> DataFrame:
    """FTS11: the documents of a set that words or meaning find, in one order; statistics are the whole corpus's.

    digits: scores and similarities are rounded to so many; those that are equal then are ties, which the key decides.
    """
    words, meaning = bm25(index, phrases, any_of=True, within=ids, key=key), vector_top(vectors, query, CANDIDATES, key, column, ids)
    if digits:  # the nearest are those by the whole similarity, the best those by the score that is shown
        words, meaning = words.select(key, F.round("score", digits[0]).alias("score")), meaning.select(key, F.round("similarity", digits[1]).alias("similarity"))
    return fuse(top(words, CANDIDATES, key), meaning, floor, key=key)


def listing(index: Callable[[], TextIndex], docs: DataFrame, text: str, phrases: list[Phrase], newest: Column, limit: int, key: str = "doc_id") -> DataFrame:
    """FTS7, FTS8: (key, score) of the best; for a query without a term, which needs no index, the newest documents with score 0."""
    if not text.strip():
        return docs.orderBy(newest.desc(), key).limit(limit).select(key, F.lit(0.0).alias("score"))
    return top(bm25(index(), phrases, key=key), limit, key)

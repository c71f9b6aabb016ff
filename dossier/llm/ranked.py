"""Ranked lexical search with block-max pruning (operator 12).

``index`` writes a forward index. A block is a range of documents in the order of the table; it holds its distinct
terms, for each term the largest impact that any of its documents gives it, and for each document its terms and their
impacts. ``search`` adds, for a query, the weighted maxima of a block's terms: no document of the block can score more.
The blocks of a query are sorted by that bound and scored from their forward index, the best few first, then more of
them; what they give is the threshold of the query, and a block whose bound is below it is never scored. A block with a
bound equal to the threshold is scored, since ties go by id. The ranks are those of scoring everything.

Queries are taken in groups of at most ``group_terms`` terms (one query may alone have more), so that what a task holds
of them doesn't grow with their number. Per group the index is read a few times: its terms for the documents that hold
each, its terms and maxima for bounds, its impacts for the blocks that are scored. Nothing is shuffled but the best few
blocks and documents of each task.

Impacts hang on the corpus's number of documents and words, which are counted first; an index of more documents is
written anew.

Defined cases: a null or empty text, and one without a term, is no document: it isn't counted, nor ever found. Rows of
one id are documents of their own; equal scores go by ascending id, null last. A query without a term that some document
holds finds nothing, as does any query of an empty table. Queries of one id are searched each for itself. Other columns
are left out, whatever their names. Texts of any length are read whole; a block may be one long text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import forget, release, runs, stored

#: What cuts terms: all ASCII but letters and digits. Upper-case ASCII letters become lower-case ones.
SPLIT = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))
#: The same as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order and with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(SPLIT).split() if text else []


@dataclass
class Index:
    """blocks: the stored forward index; documents and words: of the whole corpus."""

    blocks: DataFrame
    documents: int
    words: int


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term gives to a document of n words that holds it tf times, in whole numbers below 1,000,000."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // max(words, 1)))


def _squeeze(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(kind)).tobytes())


def _open(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind).astype(np.int64)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_docs: int = 256, block_bytes: int = 1 << 20) -> Index:
    """The forward index of a table, in blocks of at most so many documents, each ended by the text that fills block_bytes."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(terms(value.as_py())) for batch in batches for value in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["documents", "words"])

    total = texts.select("text").mapInArrow(count, "documents long, words long").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    documents, words = total["documents"], total["words"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = []
        ids: list[int | None] = []
        task, made, weight = TaskContext.get().partitionId() << 32, 0, 0

        def block() -> pa.RecordBatch:
            n = np.fromiter(map(len, held), np.int64, len(held))
            coded = pa.array([t for some in held for t in some], pa.binary()).dictionary_encode()
            listed = coded.dictionary.to_pylist()
            pairs, tf = np.unique((np.repeat(np.arange(len(held)), n) << 32) | coded.indices.to_numpy(), return_counts=True)
            doc, term = pairs >> 32, pairs & 0xFFFFFFFF
            impact = impacts(tf, n[doc], documents, words)
            by_term = np.argsort(term, kind="stable")
            starts, holders = runs(term[by_term])
            most = np.maximum.reduceat(impact[by_term], starts)
            columns = [pa.array([task + made], pa.int64()), pa.array([b" ".join(listed)], pa.binary()), pa.array([_squeeze(most, "<u4")]), pa.array([_squeeze(holders, "<u4")])]
            columns += [pa.array([ids], pa.list_(pa.int64())), pa.array([_squeeze(np.bincount(doc, minlength=len(held)), "<u4")]), pa.array([_squeeze(term, "<u4")]), pa.array([_squeeze(impact, "<u4")])]
            return pa.RecordBatch.from_arrays(columns, ["block", "terms", "most", "holders", "ids", "sizes", "codes", "impacts"])

        for batch in batches:
            for doc_id, value in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = terms(value.as_py())
                if not found:
                    continue
                held.append(found)
                ids.append(doc_id)
                weight += sum(map(len, found))
                if len(held) == block_docs or weight >= block_bytes:
                    yield block()
                    held, ids, weight, made = [], [], 0, made + 1
        if held:
            yield block()
        release()

    schema = "block long, terms binary, most binary, holders binary, ids array<long>, sizes binary, codes binary, impacts binary"
    return Index(stored(texts.mapInArrow(build, schema)), documents, words)


class Queries:
    """A group of queries: numbers of its terms, and of each term the queries that have it."""

    def __init__(self, asked: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.of: list[list[int]] = []
        for q, some in enumerate(asked):
            for term in dict.fromkeys(some):
                t = self.number.setdefault(term, len(self.of))
                if t == len(self.of):
                    self.of.append([])
                self.of[t].append(q)
        self.size = len(asked)
        self.weights = np.zeros(len(self.of), np.int64)

    def weigh(self, holders: dict[int, int], documents: int) -> None:
        """Weights from the number of documents that hold each term; a term that none holds weighs nothing."""
        for t, df in holders.items():
            self.weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def here(self, listed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's terms those that the queries have: their places in the block, and their numbers here."""
        get = self.number.get
        found = np.fromiter((get(w, -1) for w in listed.split(b" ")), np.int64)
        at = np.flatnonzero(found >= 0)
        return at, found[at]

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in numbers, query) for every query of each of these terms."""
        lists = [self.of[t] for t in numbers.tolist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.repeat(np.arange(len(lists)), sizes), np.fromiter((q for some in lists for q in some), np.int64, int(sizes.sum()))

    def bounds(self, listed: bytes, most: bytes) -> np.ndarray:
        """The bound of a block for every query."""
        at, numbers = self.here(listed)
        out = np.zeros(self.size, np.int64)
        which, query = self.pairs(numbers)
        np.add.at(out, query, (self.weights[numbers] * _open(most, "<u4")[at])[which])
        return out

    def scores(self, row: dict, wanted: np.ndarray) -> np.ndarray:
        """(query of wanted, document of the block): the scores, from the forward index."""
        at, numbers = self.here(row["terms"])
        column = np.full(row["terms"].count(b" ") + 1, -1)
        column[at] = np.arange(len(at))
        asked = np.full(self.size, -1)
        asked[wanted] = np.arange(len(wanted))
        which, query = self.pairs(numbers)
        mine = asked[query] >= 0
        doc = np.repeat(np.arange(len(row["ids"])), _open(row["sizes"], "<u4"))
        term, impact = column[_open(row["codes"], "<u4")], _open(row["impacts"], "<u4")
        doc, term, impact = doc[term >= 0], term[term >= 0], impact[term >= 0]
        out = np.zeros((len(wanted), len(row["ids"])), np.int64)
        # Slabs of queries and documents: matrices of whole numbers, which doubles add exactly up to 2**53.
        query, which = asked[query[mine]], which[mine]
        heaviest = np.bincount(query, self.weights[numbers][which], len(wanted)).max(initial=0)
        kind = np.float64 if heaviest * 1e6 < 2**53 else np.int64
        for first in range(0, len(wanted), 128):
            some = (query >= first) & (query < first + 128)
            weights = np.zeros((min(128, len(wanted) - first), len(at)), kind)
            weights[query[some] - first, which[some]] = self.weights[numbers][which[some]]
            for begin in range(0, len(row["ids"]), 64):
                some = (doc >= begin) & (doc < begin + 64)
                slab = np.zeros((len(at), min(64, len(row["ids"]) - begin)), kind)
                slab[term[some], doc[some] - begin] = impact[some]
                out[first : first + len(weights), begin : begin + slab.shape[1]] = weights @ slab
        return out


def _holders(index_: Index, queries: Queries) -> dict[int, int]:
    """Number of documents that hold each term of the queries: a row per term and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(queries.of), np.int64)
        for batch in batches:
            for listed, holders in zip(batch.column("terms").to_pylist(), batch.column("holders").to_pylist(), strict=True):
                at, numbers = queries.here(listed)
                out[numbers] += _open(holders, "<u4")[at]
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(out[held], pa.int64())], ["t", "df"])

    return {r["t"]: r["df"] for r in index_.blocks.select("terms", "holders").mapInArrow(count, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()}


@dataclass
class Reached:
    """How far each query of a group is: its threshold, and the bound and number of the block scored last."""

    threshold: np.ndarray
    bound: np.ndarray
    block: np.ndarray

    def open(self, block: int, bounds: np.ndarray) -> np.ndarray:
        """The queries for which this block isn't scored and may still hold a document of the best."""
        after = (bounds < self.bound) | ((bounds == self.bound) & (block > self.block))
        return np.flatnonzero(after & (bounds > 0) & (bounds >= self.threshold))


def _next_blocks(index_: Index, queries: Queries, reached: Reached, width: int) -> list[tuple[int, int, int]]:
    """(query, block, bound) of the next ``width`` blocks of each query in the order of their bounds."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, listed, most in zip(*(batch.column(c).to_pylist() for c in ("block", "terms", "most")), strict=True):
                bounds = queries.bounds(listed, most)
                some = reached.open(block, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block), pa.int64()), pa.array(bounds[some], pa.int64())], ["q", "block", "bound"])

    found = index_.blocks.select("block", "terms", "most").mapInArrow(bound, "q int, block long, bound long")
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    return [tuple(r) for r in found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= width).select("q", "block", "bound").collect()]  # at most width rows for each query of the group


def _score(index_: Index, queries: Queries, wanted, only: list[int] | None, best: int) -> DataFrame:
    """(q, doc_id, score): of each task the best documents of each query, in the blocks that wanted(row) asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one block at a time
                some = wanted(row)
                if not len(some):
                    continue
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
                null = np.array([i is None for i in row["ids"]])
                for q, found in zip(some.tolist(), queries.scores(row, some), strict=True):
                    least = kept[q][0][-1] if q in kept and len(kept[q][0]) >= best else 1
                    at = np.flatnonzero(found >= max(least, 1))
                    score, doc, none = (np.r_[a, b] for a, b in zip(kept.get(q, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))), (found[at], ids[at], null[at]), strict=True))
                    order = np.lexsort((none, doc, -score))[:best]
                    kept[q] = score[order], doc[order], none[order]
        for q, (score, doc, none) in kept.items():
            columns = [pa.array(np.full(len(score), q), pa.int32()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "doc_id", "score"])
        release()

    blocks = index_.blocks if only is None else index_.blocks.where(F.col("block").isin(only))
    return blocks.mapInArrow(run, "q int, doc_id long, score long")


def _merged(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(index_: Index, asked: DataFrame, key: str = "item_id", text: str = "text", best: int = 50, waves: tuple[int, ...] = (4, 32), group_terms: int = 100_000) -> DataFrame:
    """(key, rank int, doc_id long, score long): the best documents of every query with a score above 0.

    waves: how many blocks of each query are scored in the first rounds; what then remains above the threshold is scored
    in one pass.
    """
    spark, key_type = asked.sparkSession, asked.schema[key].dataType.simpleString()
    out: DataFrame | None = None
    group: list[tuple] = []
    size = 0

    def settle() -> DataFrame:
        keys = [k for k, _ in group]
        found = _searched(index_, Queries([t for _, t in group]), best, waves)
        names = spark.createDataFrame(list(enumerate(keys)), f"q int, `{key}` {key_type}")
        return found.join(F.broadcast(names), "q").select(key, "rank", "doc_id", "score")

    for row in asked.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        mine = terms(row["text"])
        group.append((row["key"], list(dict.fromkeys(mine))))
        size += len(group[-1][1])
        if size >= group_terms:
            out = settle() if out is None else out.unionByName(settle())
            group, size = [], 0
    if group:
        out = settle() if out is None else out.unionByName(settle())
    return out if out is not None else spark.createDataFrame([], f"`{key}` {key_type}, rank int, doc_id long, score long")


def _searched(index_: Index, queries: Queries, best: int, waves: tuple[int, ...]) -> DataFrame:
    """(q, rank, doc_id, score) of a group of queries, stored."""
    queries.weigh(_holders(index_, queries), index_.documents)
    end = np.iinfo(np.int64).max
    reached = Reached(np.zeros(queries.size, np.int64), np.full(queries.size, end), np.full(queries.size, -1))
    found, remain = None, True
    for width in waves:
        chosen = _next_blocks(index_, queries, reached, width)
        if not chosen:
            remain = False
            break
        by_block: dict[int, list[int]] = defaultdict(list)
        for q, block, bound in chosen:
            by_block[block].append(q)
            if (bound, -block) < (reached.bound[q], -reached.block[q]):
                reached.bound[q], reached.block[q] = bound, block
        wave = _score(index_, queries, lambda row, by=dict(by_block): np.array(sorted(by.get(row["block"], [])), np.int64), sorted(by_block), best)
        merged = stored(_merged(wave if found is None else found.select("q", "doc_id", "score").unionByName(wave), best))
        if found is not None:
            forget(found)
        found = merged
        for r in found.where(F.col("rank") == best).select("q", "score").collect():  # a row per query of the group
            reached.threshold[r["q"]] = r["score"]
    if remain or found is None:
        rest = _score(index_, queries, lambda row: reached.open(row["block"], queries.bounds(row["terms"], row["most"])), None, best)
        merged = stored(_merged(rest if found is None else found.select("q", "doc_id", "score").unionByName(rest), best))
        if found is not None:
            forget(found)
        found = merged
    return found.select("q", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

"""Substring deduplication by super-k-mers (operator 1).

Removed is every word covered by a window of ``window`` consecutive words whose sequence also starts in a document of
a smaller doc_id, judged on the input.

1. A window's minimiser is the least hash of its runs of ``piece`` words. Consecutive windows with one minimiser are a
   super-k-mer, one packed string of words. Equal windows have equal minimisers, so that they meet in its bucket.
2. A bucket whose super-k-mers all come from one document has nothing to remove; one whose packed strings are all
   equal is settled by their least document. The index of (minimiser, digest of the packed string, document) decides
   both, so that most text never travels.
3. For the other buckets one packed string per distinct content goes to the bucket, where its windows are sorted and
   each gets the least document that holds it. Buckets of over ``crowd`` windows (a passage that a third of all
   documents share has as many different surroundings) are counted by window, pre-aggregated before the shuffle.
4. The stretches found go back to the documents. Minimisers, windows and strings that more rows have than an even
   share of a partition are dealt apart from the others.

Digests are 64-bit and only compared within one minimiser, or 128-bit.

Defined cases: null or empty texts have no words and lose none; texts of fewer words than a window lose none; a null
doc_id has no order: it loses nothing and no other loses by it; repeated rows are equals, neither being smaller, and
are worked on once; an empty table gives an empty result; other columns are passed through, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import beside, runs, shuffle_partitions, stored, text_key, word_offsets, words

MIX = np.uint64(0x9E3779B97F4A7C15)


def minimisers(some: list[bytes], window: int, piece: int) -> np.ndarray:
    """The minimiser of each window, as signed longs; empty if there is no window."""
    n = len(some)
    if n < window:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, n)
    count = n - piece + 1
    g = np.zeros(count, np.uint64)
    for j in range(piece):
        g = g * MIX + h[j : j + count]
    g ^= g >> np.uint64(32)
    g *= MIX
    g ^= g >> np.uint64(29)
    reach, span, low = window - piece + 1, 1, g
    while span * 2 <= reach:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if rest := reach - span:
        low = np.minimum(low[:-rest], low[rest:])
    return low.view(np.int64)


def _index(docs: DataFrame, window: int, piece: int) -> DataFrame:
    """(doc_id, tk, mini, pid, at, n): the super-k-mers of every document, n windows from word `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts: list[tuple[np.ndarray, ...]] = []
            for row, text in enumerate(batch.column(2)):
                some = words(text.as_py())
                mini = minimisers(some, window, piece)
                if not len(mini):
                    continue
                at, n = runs(mini)
                joined, offsets = b" ".join(some), word_offsets(some)
                starts, ends = offsets[at].tolist(), (offsets[at + n + window - 1] - 1).tolist()
                pid = np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64)
                parts.append((np.full(len(at), ids[row]), np.full(len(at), keys[row]), mini[at], pid, at.astype(np.int32), n.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["doc_id", "tk", "mini", "pid", "at", "n"])

    return docs.select("doc_id", "tk", "text").mapInArrow(run, "doc_id long, tk long, mini long, pid long, at int, n int")


def _packed(texts: DataFrame, window: int) -> DataFrame:
    """(mini, pid, first, packed): the packed strings of the wanted super-k-mers of (doc_id, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, doc, text, wanted in zip(*batch.columns, strict=True):
                some, asked = words(text.as_py()), wanted.as_py()
                joined, offsets = b" ".join(some), word_offsets(some)
                packed = [joined[offsets[w["at"]] : offsets[w["at"] + w["n"] + window - 1] - 1] for w in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["mini"] for w in asked], pa.int64()), pa.array([w["pid"] for w in asked], pa.int64()), pa.array([doc.as_py()] * len(asked), pa.int64()), pa.array(packed, pa.binary())],
                    ["mini", "pid", "first", "packed"],
                )

    return texts.select("row", "doc_id", "text", "wanted").mapInArrow(run, "mini long, pid long, first long, packed binary")


def _windows(packed: bytes, window: int) -> list[bytes]:
    some = packed.split()
    at = word_offsets(some).tolist()
    return [packed[at[k] : at[k + window] - 1] for k in range(len(some) - window + 1)]


def _stretches(mini: list[int], pid: list[int], firsts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (mini, pid, off, len, first) of equal neighbours."""
    columns: list[list] = [[], [], [], [], []]
    for m, p, first in zip(mini, pid, firsts, strict=True):
        at, n = runs(first)
        for c, values in zip(columns, ([m] * len(at), [p] * len(at), at.tolist(), n.tolist(), first[at].tolist()), strict=True):
            c += values
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["mini", "pid", "off", "len", "first"])


OWNERS = "mini long, pid long, off int, len int, first long"


def _sorted_buckets(packed: DataFrame, window: int) -> DataFrame:
    """Counts windows by sorting them within each minimiser's bucket: the least document of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []  # (pid, packed, first) of the bucket that is being read
        mini, out = None, ([], [], [])

        def solve() -> None:
            firsts = [np.empty(0, np.int64)] * len(held)
            every = []
            for r, (_, packed_, first) in enumerate(held):
                listed = _windows(packed_, window)
                firsts[r] = np.full(len(listed), first)
                every += [(w, first, r, k) for k, w in enumerate(listed)]
            every.sort()
            last, least = None, 0
            for w, first, r, k in every:
                if w != last:
                    last, least = w, first
                firsts[r][k] = least
            out[0].extend([mini] * len(held))
            out[1].extend(h[0] for h in held)
            out[2].extend(firsts)

        for batch in batches:
            for m, p, first, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m != mini and held:
                    solve()
                    held = []
                    if len(out[0]) > 20_000:
                        yield _stretches(*out)
                        out = ([], [], [])
                mini = m
                held.append((p, string, first))
        if held:
            solve()
        if out[0]:
            yield _stretches(*out)

    n = shuffle_partitions(packed.sparkSession)
    return packed.repartition(n, "mini").sortWithinPartitions("mini").mapInArrow(run, OWNERS)


def _crowded_buckets(packed: DataFrame, window: int) -> DataFrame:
    """The same for buckets too large for one task: a row per window, grouped by its 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, p, first, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = word_offsets(string.split()).tolist()
                n = len(at) - window
                for done in range(0, n, 50_000):
                    digests = [xxhash.xxh3_128_digest(string[at[k] : at[k + window] - 1]) for k in range(done, min(done + 50_000, n))]
                    k = len(digests)
                    yield pa.RecordBatch.from_arrays([pa.array([m] * k, pa.int64()), pa.array([p] * k, pa.int64()), pa.array(range(done, done + k), pa.int32()), pa.array(digests, pa.binary()), pa.array([first] * k, pa.int64())], ["mini", "pid", "off", "digest", "mine"])

    rows = stored(packed.mapInArrow(run, "mini long, pid long, off int, digest binary, mine long"))
    least = stored(rows.groupBy("digest").agg(F.min("mine").alias("first"), F.count(F.lit(1)).alias("_n")))
    owned = beside(rows, least, ["digest"]).select("mini", "pid", "off", "first")
    # Neighbouring windows of one least document are one stretch, as in the sorted buckets.
    string = Window.partitionBy("mini", "pid").orderBy("off")
    goes_on = (F.lag("first").over(string) == F.col("first")) & (F.lag("off").over(string) == F.col("off") - 1)
    runs_ = owned.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(string))
    return runs_.groupBy("mini", "pid", "run").agg(F.min("off").alias("off"), F.count(F.lit(1)).cast("int").alias("len"), F.min("first").alias("first")).drop("run")


def repeated_stretches(docs: DataFrame, window: int = 50, piece: int = 8, crowd: int = 200_000) -> DataFrame:
    """(doc_id, tk, at, n): n windows from word `at` that also start in a smaller document.

    docs has row, doc_id long (not null), tk and text, as made by remove_repeats. The row is carried along so that this
    join and the caller's share one shuffle of the documents.
    """
    index = stored(_index(docs, window, piece))
    shared = index.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("pid") == F.max("pid")).alias("same"), F.count(F.lit(1)).alias("_n")).where("low < high").select("mini", "low", "same", "_n")
    hits = stored(beside(index, stored(shared), ["mini"]))
    plain = hits.where("same AND doc_id > low").select("doc_id", "tk", "at", "n")
    mixed = hits.where("NOT same")
    kept = stored(mixed.groupBy("mini", "pid").agg(F.min(F.struct("doc_id", "tk", "at", "n")).alias("x"), F.count(F.lit(1)).alias("copies")))
    sizes = stored(kept.groupBy("mini").agg((F.sum("x.n") > crowd).alias("crowded"), F.count(F.lit(1)).alias("_n")))
    wanted = stored(beside(kept, sizes, ["mini"]).select("x.doc_id", "x.tk", F.struct("mini", "pid", "x.at", "x.n").alias("w"), "crowded"))

    def packed(which: DataFrame) -> DataFrame:
        asked = which.groupBy("doc_id", "tk").agg(F.collect_list("w").alias("wanted"))  # of one document
        return _packed(docs.join(asked.hint("shuffle_hash"), ["doc_id", "tk"]), window)

    owners = _sorted_buckets(packed(wanted.where("NOT crowded")), window)
    if not wanted.where("crowded").isEmpty():
        owners = owners.unionAll(_crowded_buckets(packed(wanted.where("crowded")), window))
    # Strings with more copies than an even share of a partition, at most one per partition, are dealt by a salt.
    salts = shuffle_partitions(docs.sparkSession)
    even = max(1000, kept.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"] // salts)
    hot = F.broadcast(kept.where(F.col("copies") > even).select("mini", "pid", F.lit(True).alias("hot")))
    dealt = mixed.join(hot, ["mini", "pid"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    copied = owners.join(hot, ["mini", "pid"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    found = dealt.join(copied, ["mini", "pid", "salt"]).where("first < doc_id").select("doc_id", "tk", (F.col("at") + F.col("off")).alias("at"), F.col("len").alias("n"))
    return plain.unionAll(found)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, tk, text, cut) rows with n_words, n_removed and kept in place of cut."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for value, cut in zip(batch.column("text"), batch.column("cut"), strict=True):
                some = words(value.as_py())
                covered = np.zeros(len(some) + 1, np.int64)
                for c in cut.as_py() or []:
                    covered[c["at"]] += 1
                    covered[min(c["at"] + c["n"] + window - 1, len(some))] -= 1
                stays = np.cumsum(covered)[:-1] == 0
                total.append(len(some))
                gone.append(len(some) - int(stays.sum()))
                kept.append(b" ".join(some if not gone[-1] else [w for w, s in zip(some, stays.tolist(), strict=True) if s]).decode("utf-8", "surrogatepass"))
            passed = [batch.column(c) for c in ("row", "doc_id", "tk", "text")]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["row", "doc_id", "tk", "text", "n_words", "n_removed", "kept"])

    return rows.select("row", "doc_id", "tk", "text", "cut").mapInArrow(run, f"row {schema['row'].dataType.simpleString()}, doc_id long, tk long, text string, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = 50, piece: int = 8, crowd: int = 200_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs with n_words, n_removed and kept: the words left, joined by one space.

    Rows of one id and text are worked on once, and each gets that result.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    rows = docs.select(F.struct(*[F.col(c) for c in names if c != text]).alias("row"), F.col(key).cast("long").alias("doc_id"), text_key(F.col(text)).alias("tk"), F.col(text).alias("text"))
    known, by = rows.where("doc_id IS NOT NULL"), ["doc_id", "tk"]
    repeats = stored(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    again = None
    if not repeats.isEmpty():
        marked = beside(known, repeats.withColumn("twice", F.lit(True)), by, "left")
        again = marked.where("twice")
        once = again.groupBy(*by).agg(F.first("text").alias("text"))  # combined before the shuffle
        known = marked.where("twice IS NULL").select("row", *by, "text").unionByName(once.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    each = repeated_stretches(known, window, piece, crowd).groupBy(*by).agg(F.collect_list(F.struct("at", "n")).alias("cut"))  # of one document
    out = known.join(each.hint("shuffle_hash"), by, "left").select("row", *by, "text", "cut")
    out = _cut(out.unionAll(rows.where("doc_id IS NULL").select("row", *by, "text", F.lit(None).cast("array<struct<at:int,n:int>>").alias("cut"))), window)
    if again is not None:
        cut = out.where("row IS NULL AND doc_id IS NOT NULL").select(*by, "n_words", "n_removed", "kept")
        copies = stored(cut.join(repeats, by))
        out = out.where("row IS NOT NULL").unionByName(beside(again.select("row", *by, "text"), copies, by))
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in names], "n_words", "n_removed", "kept")

"""SimHash near-deduplication with a Gray-order hierarchical index (operator 6).

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints become one node.
2. Two fingerprints at ``distance`` bits or fewer agree on at least one of ``distance + 1`` bands of bits, so that each
   node goes to one bucket per band. A bucket with more than ``crowd`` nodes is dealt again by bands of its other bits,
   which is as exact.
3. In a bucket the fingerprints are sorted by Gray rank, so that neighbours share bits. Nodes over stretches of them
   keep the bits on which all below agree; two stretches whose agreed bits already differ too much are passed over
   whole, else their children are looked at. Stretches that are linked with each other already are passed over too,
   which keeps groups of thousands of near copies linear.
4. A bucket returns links to the least document of each of its groups, never all pairs; large-star and small-star
   rounds over these links give the components.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a null doc_id gets its fingerprint
and a null component_id and links nothing; repeated rows stay; rows of one doc_id are one document; an empty table
gives an empty result; other columns don't matter and aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import beside, shuffle_partitions, stored, word_offsets, words

BITS = 64
FANOUT = 16
#: Pairs of stretches that are opened at once.
OPENED = 4096


def fingerprint(some: list[bytes], shingle: int, seed: int) -> int:
    """SimHash of words: a bit is set if it is set in over half of the shingles' XXH64 values."""
    if not some:
        return 0
    joined, at = b" ".join(some), word_offsets(some)
    last = max(1, len(some) - shingle + 1)
    starts, ends = at[:last].tolist(), (at[min(shingle, len(some)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # bytes.lower() changes A-Z alone
            found = np.array([fingerprint([w.lower() for w in words(t.as_py())], shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Groups:
    """Components over positions, kept as the least position of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label] != label).any():
                label[up] = label[label[up]]


def bucket_groups(fps: np.ndarray, distance: int) -> np.ndarray:
    """For distinct fingerprints, the position of the least member of each one's group within the bucket."""
    n = len(fps)
    order = np.argsort(gray_rank(fps), kind="stable")
    held = fps[order]
    groups = Groups(n)
    far = np.bitwise_count
    for turn in (0, 16, 32, 48) if n > 64 else (0,):  # neighbours in Gray order of the turned bits
        turned = (held << np.uint64(turn)) | (held >> np.uint64(BITS - turn)) if turn else held
        by = np.argsort(gray_rank(turned), kind="stable")
        near = far(held[by[:-1]] ^ held[by[1:]]) <= distance
        groups.link(by[:-1][near], by[1:][near])
    # Levels from single fingerprints up: agreed bits and their values.
    levels = [(np.full(n, ~np.uint64(0)), held)]
    while len(levels[-1][0]) > 2 * FANOUT:
        mask, value = levels[-1]
        cuts = np.arange(0, len(mask), FANOUT)
        both, some = np.bitwise_and.reduceat(value, cuts), np.bitwise_or.reduceat(value, cuts)
        mask = np.bitwise_and.reduceat(mask, cuts) & ~(both ^ some)
        levels.append((mask, both & mask))
    top = len(levels[-1][0])
    stack = [(len(levels) - 1, *np.triu_indices(top, 0 if len(levels) > 1 else 1))]
    while stack:
        level, i, j = stack.pop()
        mask, value = levels[level]
        near = far((value[i] ^ value[j]) & mask[i] & mask[j]) <= distance
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level == 0:
            groups.link(i, j)
            continue
        span = FANOUT**level
        if n > 64:  # stretches that are one group already have nothing new to link
            cuts = np.arange(0, n, span)
            low, high = np.minimum.reduceat(groups.label, cuts), np.maximum.reduceat(groups.label, cuts)
            fresh = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[fresh], j[fresh]
        below = len(levels[level - 1][0])
        if len(i) > OPENED:
            stack += [(level, i[k : k + OPENED], j[k : k + OPENED]) for k in range(0, len(i), OPENED)]
            continue
        step = np.arange(FANOUT)
        a = (i[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
        b = (j[:, None, None] * FANOUT + 0 * step[None, :, None] + step[None, None, :]).ravel()
        fits = (a < below) & (b < below) & ((a < b) if level == 1 else (a <= b))
        stack.append((level - 1, a[fits], b[fits]))
    out = np.empty(n, np.int64)
    out[order] = order[groups.label]
    return out


def _field(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _bands(widths: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of bands that cover so many bits."""
    cuts = [round(k * widths / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(nodes: DataFrame, distance: int = 4, crowd: int = 16384) -> DataFrame:
    """(a, b): documents of nodes (fp, first) tied to a lesser document, enough of them to connect all near ones."""
    n = shuffle_partitions(nodes.sparkSession)
    bands = _bands(BITS, distance + 1)
    dealt = nodes.select("fp", "first", F.posexplode(F.array(*[_field(F.col("fp"), *b) for b in bands])).alias("band", "value"))
    sizes = dealt.groupBy("band", "value").count().where(F.col("count") > crowd).select("band", "value", F.lit(True).alias("crowded"))
    marked = dealt.join(sizes, ["band", "value"], "left")
    # The bits of a crowded bucket that aren't its band, moved together, are cut into bands again.
    rest = None
    for k, (start, width) in enumerate(bands):
        low = F.col("fp").bitwiseAND(F.lit((1 << start) - 1))
        high = F.shiftrightunsigned("fp", start + width) if start + width < BITS else F.lit(0).cast("long")
        other = low.bitwiseOR(F.shiftleft(high, start))
        again = F.array(*[F.struct(F.lit(s).alias("sub"), _field(other, *b).alias("field")) for s, b in enumerate(_bands(BITS - width, distance + 1))])
        rest = F.when(F.col("band") == k, again) if rest is None else rest.when(F.col("band") == k, again)
    once = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("field")))
    keyed = marked.select("fp", "first", "band", "value", F.inline(F.when(F.col("crowded"), rest).otherwise(once))).select("fp", "first", F.xxhash64("band", "value", "sub", "field").alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
            froms, tos = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                first = rows[a:b, 2]
                group = bucket_groups(rows[a:b, 1].view(np.uint64), distance)
                tied = np.flatnonzero(group != np.arange(b - a))
                if len(tied):
                    least = first.copy()
                    np.minimum.at(least, group, first)
                    mine = least[group]
                    other = np.flatnonzero(mine != first)
                    froms.append(first[other])
                    tos.append(mine[other])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (froms, tos)], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            if not len(rows):
                continue
            ends = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            if len(ends) or held and held[-1][-1, 0] != rows[0, 0]:
                if held and held[-1][-1, 0] != rows[0, 0]:
                    yield solve(np.concatenate(held))
                    held = []
                if len(ends):
                    yield solve(np.concatenate([*held, rows[: ends[-1]]]))
                    held, rows = [], rows[ends[-1] :]
            held.append(rows)
        if held:
            yield solve(np.concatenate(held))

    by_bucket = keyed.select("bucket", "fp", "first").repartition(n, "bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, of every node with a link; edges are pairs (a, b) of longs.

    Large-star and small-star rounds (Kiveris and others, 2014), each written to the shared folder, until nothing
    changes. The centre of a large star is a hot key: such stars' least nodes are broadcast.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("_n")))
        large = stored(beside(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")))
        small = beside(large, least, ["a"]).select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()
        edges = stored(small)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, crowd: int = 16384) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marks = stored(fingerprints(docs, shingle, seed))
    nodes = marks.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").cast("long").alias("first"))
    # Rows of one doc_id are one document: its fingerprints are tied to each other.
    tied = marks.where("doc_id IS NOT NULL").join(nodes, "fp").select(F.col("doc_id").cast("long").alias("a"), F.col("first").alias("b")).where("a <> b")
    several = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    roots = components(links(nodes, distance, crowd).unionAll(tied.join(several.select(F.col("doc_id").cast("long").alias("a")), "a", "left_semi")))
    known = nodes.join(roots, nodes["first"] == roots["node"], "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    out = marks.join(known, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

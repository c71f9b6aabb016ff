"""Language-model scores by stupid backoff (operator 2).

The model is one of word n-grams up to ``order`` over folded text (A-Z lower-cased, words cut at ASCII white space):
every n-gram of every whole document is counted, so that the model grows with the corpus. A word's value is the relative
frequency of the longest n-gram that ends in it and was seen elsewhere, times ``backoff`` for each order given up
(Brants and others, 2007). Each n-gram counts one occurrence less than the corpus holds, the one that is being scored;
so a text is never its own evidence. A document's score is the mean log10 value of its words.

Relationally: a task explodes its part of the table (a *batch* of at most ``batch_words`` words) into n-grams and sums
them, so that a frequent n-gram is one entry per batch and none is hot. The count table is partitioned by the n-gram's
hash: a bucket holds all batches' entries of its hashes, sums them by n-gram and joins the totals back to the entries.
These return to the batches, where the words' values are summed per document. Rows are packed (sorted hashes as
differences): plain rows of exploded word n-grams would be several times the input on disk.

An n-gram is known by 56 bits of hash: of N different ones, one shares its hash with another with a chance of N / 2**56.

Defined cases: null and empty texts have no words and a null score; documents of one id stay separate rows; repeated
rows are evidence for each other; an empty table gives an empty result; other columns are left out unless in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import after_shuffle, release, shuffle_partitions

FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
HASH_BITS = 56
MIX = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _OTHER
    return x ^ (x >> np.uint64(29))


def gram_codes(hashes: np.ndarray, place: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order the n-grams as (at, code): where each one's last word is, and its hash.

    hashes has a long per word, place each word's place in its document.
    """
    state = _mixed(hashes * MIX)
    out = [(np.arange(len(hashes)), state >> np.uint64(64 - HASH_BITS))]
    for n in range(2, order + 1):
        longer = np.zeros_like(state)
        longer[1:] = _mixed(state[:-1] * MIX + hashes[1:] + np.uint64(n))
        state = longer
        at = np.flatnonzero(place >= n - 1)
        out.append((at, state[at] >> np.uint64(64 - HASH_BITS)))
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of so many bytes by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype(f"u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel()


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of the texts one after the other, each text's number of words, the distinct words."""
    split = pc.split_pattern(pa.array(texts, pa.large_binary()), " ")
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    offsets = split.offsets.to_numpy()
    sizes = np.diff(ends[offsets - offsets[0]])
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), sizes, coded.dictionary


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _batches(docs: DataFrame, keep: list[str], order: int, batch_words: int, bits: int) -> DataFrame:
    """Rows of a batch by kind: 0 a document (its word numbers), 1 the words' hashes, 2 a bucket's n-grams and counts.

    The column to says where a row is dealt: the batch, or below zero the bucket.
    """
    schema = docs.select(*keep).schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId() << 24, 0, 0
        texts: list[bytes] = []
        beside: list[pa.RecordBatch] = []
        shift = np.uint64(HASH_BITS - bits)

        def batch_of(kind, bucket, codes, more, size, kept) -> pa.RecordBatch:
            n = len(codes)
            to = [-1 - b for b in bucket] if kind == 2 else [part + k] * n
            arrays = [pa.array(to, pa.int64()), pa.array([part + k] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(codes, pa.binary()), pa.array(more, pa.binary()), pa.array(size, pa.int64())]
            arrays += [pa.nulls(n, f.type) for f in beside[0].schema] if kept is None else kept.columns
            return pa.RecordBatch.from_arrays(arrays, ["to", "batch", "kind", "bucket", "codes", "more", "size", *keep])

        def flush() -> Iterator[pa.RecordBatch]:
            numbers, sizes, listed = _numbered(texts)
            texts.clear()
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in listed.to_pylist()], np.uint64)
            yield batch_of(1, [0], [_pack(hashes, 8)], [None], [0], None)
            ends, done = np.r_[0, np.cumsum(sizes)].tolist(), 0
            for others in beside:
                mine = range(done, done + others.num_rows)
                yield batch_of(0, [0] * len(mine), [_pack(numbers[ends[i] : ends[i + 1]], 4) for i in mine], [None] * len(mine), sizes[mine.start : mine.stop], others)
                done = mine.stop
            found = [np.unique(code, return_counts=True) for _, code in gram_codes(hashes[numbers], _places(sizes), order)]
            del numbers, hashes, listed
            cuts = [np.searchsorted(code >> shift, np.arange((1 << bits) + 1).astype(np.uint64)) for code, _ in found]
            for bucket in range(1 << bits):
                codes, counts = (np.concatenate([x[i][c[bucket] : c[bucket + 1]] for x, c in zip(found, cuts, strict=True)]) for i in (0, 1))
                if len(codes):
                    yield batch_of(2, [bucket], [_pack(np.diff(codes, prepend=np.uint64(0)), 8)], [_pack(counts, 4)], [0], None)
            beside.clear()
            del found
            release()

        for rows_in in rows:
            others, done = rows_in.select(keep), 0
            for n, value in enumerate(rows_in.column(len(keep))):
                texts.append(folded(value.as_py() or ""))
                held += texts[-1].count(b" ") + 1
                if held >= batch_words:
                    beside.append(others.slice(done, n + 1 - done))
                    yield from flush()
                    done, held, k = n + 1, 0, k + 1
            if done < rows_in.num_rows:
                beside.append(others.slice(done))
        if texts:
            yield from flush()

    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"to long, batch long, kind int, bucket int, codes binary, more binary, size long{fields}")


def _sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words there are in the partition's rows."""
    n = sum(pc.sum(batch.column("size")).as_py() or 0 for batch in rows)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _totals(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bucket, totals): a bucket's entries summed by n-gram, and the sums beside the entries that asked.

    The rows come sorted by bucket; one bucket is held at a time.
    """
    held: list[tuple[int, bytes, bytes]] = []
    current = None

    def settle() -> Iterator[pa.RecordBatch]:
        codes = [np.cumsum(_unpack(c, 8)) for _, c, _ in held]
        counts = np.concatenate([_unpack(m, 4) for _, _, m in held]).astype(np.int64)
        every = np.concatenate(codes)
        order = np.argsort(every)
        ordered = every[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sums = np.add.reduceat(counts[order], starts)
        totals = np.empty(len(every), np.int64)
        totals[order] = np.repeat(sums, np.diff(np.r_[starts, len(every)]))
        packed = [_pack(x, 8) for x in np.split(totals, np.cumsum([len(c) for c in codes])[:-1])]
        n = len(held)
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([current] * n, pa.int32()), pa.array(packed, pa.binary())], ["part", "bucket", "totals"])
        held.clear()

    for batch in rows:
        for owner, bucket, codes, more in zip(*(batch.column(c).to_pylist() for c in ("batch", "bucket", "codes", "more")), strict=True):
            if bucket != current and held:
                yield from settle()
            current = bucket
            held.append((owner, codes, more))
    if held:
        yield from settle()
    release()


def _values(grams: list[tuple[np.ndarray, np.ndarray]], totals: list[np.ndarray], n_words: int, corpus: int, backoff: float) -> np.ndarray:
    """The value of every word, from the n-grams that end in it and the corpus's counts of the distinct ones."""
    order = len(grams)
    value = np.empty(n_words)
    context = np.empty(0, np.int64)
    for n, ((at, code), total) in enumerate(zip(grams, totals, strict=True), 1):
        _, which = np.unique(code, return_inverse=True)
        count = np.zeros(n_words, np.int64)
        count[at] = total[which] - 1  # without the occurrence that is scored
        if n == 1:
            value[:] = np.maximum(count, 0.5) / max(corpus - 1, 1) * backoff ** (order - 1)
        else:
            seen = np.flatnonzero(count > 0)
            value[seen] = count[seen] / np.maximum(context[seen - 1], 1) * backoff ** (order - n)
        context = count
    return value


def scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, keep: tuple[str, ...] = ("doc_id",), text: str = "text", batch_words: int = 2_000_000, buckets: int = 4) -> DataFrame:
    """The columns in keep with n_words, log10_sum and score, the mean log10 value of a word.

    buckets is the least number of them per shuffle partition.
    """
    if order < 1:
        raise ValueError("order is 1 or more")
    names = [f"_{i}" for i in range(len(keep))]
    rows_in = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], F.col(text).alias("_text"))
    types = [rows_in.schema[a].dataType.simpleString() for a in names]
    n = shuffle_partitions(docs.sparkSession)
    rows = _batches(rows_in, names, order, batch_words, (buckets * n - 1).bit_length()).repartition(n, "to")
    asked, held = rows.where(after_shuffle(F.col("kind") == 2)).sortWithinPartitions("bucket"), rows.where(after_shuffle(F.col("kind") < 2))
    corpus = held.mapInArrow(_sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("corpus"))
    back = asked.mapInArrow(_totals, "part long, bucket int, totals binary").crossJoin(F.broadcast(corpus))  # one row

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = left.column("kind").to_numpy()
        documents = left.filter(pa.array(kinds == 0))
        numbers = [_unpack(c.as_py(), 4) for c in documents["codes"]]
        sizes = np.array([len(x) for x in numbers], np.int64)
        sums: list[float | None] = [None] * len(numbers)
        if sizes.sum():
            hashes = _unpack(left.filter(pa.array(kinds == 1))["codes"][0].as_py(), 8)[np.concatenate(numbers)]
            grams = gram_codes(hashes, _places(sizes), order)
            # A bucket's totals stand by order and hash, like its entries; buckets are the hash's first bits.
            by = np.argsort(right["bucket"].to_numpy())
            listed = right["totals"].to_pylist()
            shift = np.uint64(HASH_BITS - (buckets * n - 1).bit_length())
            places = right["bucket"].to_numpy()[by].astype(np.uint64)
            sections = []
            for _, code in grams:
                distinct = np.unique(code) >> shift
                sections.append((np.searchsorted(distinct, places, "left"), np.searchsorted(distinct, places, "right")))
            totals = [np.empty(int(high[-1]), np.int64) for _, high in sections]
            for b, row in enumerate(by.tolist()):
                some, done = _unpack(listed[row], 8).astype(np.int64), 0
                for total, (low, high) in zip(totals, sections, strict=True):
                    total[low[b] : high[b]] = some[done : (done := done + int(high[b] - low[b]))]
            value = np.log10(_values(grams, totals, len(hashes), int(right["corpus"][0].as_py()), backoff))
            each = np.bincount(np.repeat(np.arange(len(sizes)), sizes), value, len(sizes))
            sums = [s if size else None for s, size in zip(each.tolist(), sizes.tolist(), strict=True)]
        release()
        return pa.table([*[documents[a] for a in names], pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], [*names, "n_words", "log10_sum"])

    fields = ", ".join([f"{a} {t}" for a, t in zip(names, types, strict=True)] + ["n_words long", "log10_sum double"])
    out = held.groupBy("to").cogroup(back.groupBy("part")).applyInArrow(meet, fields)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], "n_words", "log10_sum", (F.col("log10_sum") / F.col("n_words")).alias("score"))

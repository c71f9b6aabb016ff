"""Byte-level BPE encoding and decoding (operator 3).

A text is cut by the tokenizer's pattern into words; every *distinct* word of the corpus is encoded once, by a fold of
ranked merges over its bytes in Spark's higher-order functions. The rank map is one literal: short lists of (pair of
tokens, rank), dealt by the pair, so that a lookup looks at an entry or two. Decoding concatenates the binary pieces of
a document's ids, by a literal list of pieces.

How documents meet their words without a shuffle of every occurrence: a task numbers the distinct words of its part of
the table (a *batch*) and keeps each document as a compressed list of numbers. Only a batch's distinct words travel to
the word's bucket, where each is encoded once, and the ids back to the batch. A batch is bounded by ``batch_bytes`` and
words are held a bucket at a time, so that what meets in one task is bounded too, whatever the words' frequencies.

Defined cases: a null text counts as empty and gives no tokens; decoding gives back the text's bytes; documents with
equal ids or texts stay separate rows; an empty table gives an empty result; other columns are left out of the result
unless named in ``keep``. Words of over ``fold_bytes`` bytes (runs of one letter a book long, say) would make the fold
quadratic; these are merged with a heap in Python, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import after_shuffle, release, small_batches

#: Bits of a token id, and of a place in a word, in the fold's state.
BITS = 20
ID = (1 << BITS) - 1
#: The token before the first and after the last one, which no pair has.
END = ID


class Vocabulary:
    """Ranks of byte pieces and the pattern that cuts texts.

    ``ranks`` must hold every single byte, as byte-level vocabularies do. It is a fixed file of a published tokenizer:
    its size doesn't depend on the data.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, buckets: int = 32_771):
        if max(ranks.values(), default=0) >= END:
            raise ValueError(f"ranks are below {END}")
        self.ranks, self.pattern, self.buckets = ranks, pattern, buckets

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines of a base64 piece and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}, pattern)

    @cached_property
    def parts(self) -> dict[bytes, list[int]]:
        """The tokens that merge last in each piece of several bytes; of over two the merges don't lead to the piece.

        Two tokens stand side by side in a text only if merging their bytes alone leads to the two: no merge has crossed
        the ends of what they cover, and of the merges inside the same come first. A piece is so made of one pair only.
        """
        return {piece: merged(piece, self.ranks, whole=False) for piece in self.ranks if len(piece) > 1}

    def pairs(self) -> Column:
        """The rank map as one literal: lists of pair, rank - 2**BITS, pair, ... dealt by the pair's remainder.

        Only pairs that can occur are in it: the driver describes a plan with all its literals whenever the plan changes.
        """
        lists: list[list[int]] = [[] for _ in range(self.buckets)]
        for piece, some in self.parts.items():
            if len(some) == 2:
                pair = some[0] << BITS | some[1]
                lists[pair % self.buckets] += [pair, self.ranks[piece] - (1 << BITS)]
        return _literal(lists, "array<array<bigint>>")

    def whole(self) -> Column | None:
        """Ranks of the words by hex form that their merges don't lead to; published vocabularies have few or none."""
        apart = {word.hex().upper(): self.ranks[word] for word, some in self.parts.items() if len(some) > 2}
        return _literal(apart, "map<string,int>") if apart else None

    def first(self) -> Column:
        """Ids of the single bytes."""
        return _literal([self.ranks[bytes([b])] for b in range(256)], "array<bigint>")

    def pieces(self) -> Column:
        """Pieces by id, a character for each byte."""
        named = {rank: piece.decode("latin-1") for piece, rank in self.ranks.items()}
        return _literal([named.get(i) for i in range(max(named, default=-1) + 1)], "array<string>")


def _literal(value, kind: str) -> Column:
    """A nested value as one literal: Spark folds the call when it plans."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_encode(word: Column, vocabulary: Vocabulary) -> Column:
    """Token ids of one word (binary) by the ranked fold: at each step the leftmost pair of lowest rank merges."""
    ids = _bind(vocabulary.pairs(), lambda table: _fold(word, table, vocabulary))
    apart = vocabulary.whole()
    if apart is not None:
        ids = F.coalesce(_bind(F.try_element_at(apart, F.hex(word)), lambda k: F.when(k.isNotNull(), F.array(k))), ids)
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(ids)


def _fold(word: Column, table: Column, vocabulary: Vocabulary) -> Column:
    """The fold over a state of one long per token: rank of the pair that begins there, place in the word, token id.

    A pair's rank counts from -2**BITS, no pair being 0, so that the least long is the leftmost pair of lowest rank.
    """

    def rank(left: Column, right: Column) -> Column:
        pair = F.shiftleft(left, BITS) + right
        bucket = F.get(table, (pair % vocabulary.buckets).cast("int"))
        # The entry after the pair is its rank; without the pair it is a pair or null.
        return F.shiftleft(F.least(F.get(bucket, F.array_position(bucket, pair).cast("int")), _long(0)), 2 * BITS)

    below = lambda e: e.bitwiseAND(_long((1 << 2 * BITS) - 1))
    id_of = lambda e: e.bitwiseAND(_long(ID))

    def merge(state: Column, _: Column) -> Column:
        def at(acc: Column, i: Column) -> Column:
            least, before, after = F.get(acc, i - 1), F.get(acc, i - 2), F.get(acc, i + 1)
            token = F.shiftright(least, 2 * BITS) + (1 << BITS)
            fresh = F.array(rank(id_of(before), token) + below(before), rank(token, id_of(after)) + below(least) - id_of(least) + token)
            return F.when(least < 0, F.flatten(F.array(F.slice(acc, F.lit(1), i - 2), fresh, F.slice(acc, i + 2, F.size(acc))))).otherwise(acc)

        return F.aggregate(F.array(F.array_position(state, F.array_min(state)).cast("int")), state, at)

    def over(ids: Column) -> Column:
        tokens = F.transform(ids, lambda a, i: rank(a, F.coalesce(F.get(ids, i + 1), _long(END))) + F.shiftleft(i.cast("bigint"), BITS) + a)
        ends = F.array(_long(END))
        return F.aggregate(F.sequence(F.lit(2), F.size(ids)), F.concat(ends, tokens, ends), merge, lambda done: F.transform(F.slice(done, F.lit(2), F.size(done) - 2), lambda e: id_of(e).cast("int")))

    letters = F.split(F.decode(word, "ISO-8859-1"), "")
    return _bind(vocabulary.first(), lambda first: _bind(F.transform(letters, lambda c: F.get(first, F.ascii(c))), over))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of token ids: their pieces, one after the other."""
    return F.encode(F.array_join(_bind(vocabulary.pieces(), lambda pieces: F.transform(ids, lambda i: F.get(pieces, i))), ""), "ISO-8859-1")


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids in n log n, for words too long for the fold."""
    return [ranks[word]] if word in ranks else merged(word, ranks)


def merged(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The ranked merges with a heap, but for that into the whole word if not whole."""
    ends = list(range(1, len(word) + 1))  # end of the piece that starts at i, 0 when it was merged away
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < len(word) and (whole or ends[j] - i < len(word)) and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not j or j >= len(word) or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        if end < len(word):
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


#: White space besides the space itself, as the pattern sees it (Unicode's White_Space).
OTHER_WHITE = [chr(c) for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _single_spaced(text: str) -> bool:
    """No space touches other white space, an end of the text or a space."""
    return bool(text) and text[0] != " " != text[-1] and "  " not in text and not any(w in text and (f" {w}" in text or f"{w} " in text) for w in OTHER_WHITE)


#: The pattern of which the cuts of plain units are known without it.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _finder(pattern: str):
    """Cuts a unit, and the space before it if there is one, by the pattern. Latin letters with one mark at most behind need no search."""
    import regex

    find = regex.compile(pattern).findall
    if pattern != PLAIN:
        return lambda space, unit: find(space + unit)

    def cut(space: str, unit: str) -> list[str]:
        if unit and max(unit) < "\u0250":
            if unit.isalpha():
                return [space + unit]
            if unit[-1] in ",.;:!?" and unit[:-1].isalpha():
                return [space + unit[:-1], unit[-1]]
        return find(space + unit)

    return cut


def _listed(array: pa.Array) -> list:
    """The values of an array of strings or bytes without nulls, as to_pylist gives them, in a fraction of its time."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _pack(values: np.ndarray, level: int = 3) -> bytes:
    """Whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _numbered(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings of the parts in the order of their coming, and of each string its number."""
    coded = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _batches(docs: DataFrame, text: str, pattern: str, batch_bytes: int, buckets: int) -> DataFrame:
    """Rows of a batch by kind: 0 a document (its unit numbers), 1 the units (sizes, then word numbers), 2 a bucket's words.

    A unit is a stretch of text between single spaces. The pattern always cuts there, so that equal units hold equal
    words and only a batch's distinct units need the pattern. A text with other spacing is one unit. The column to says
    where a row is dealt: the batch, or below zero the bucket.
    """
    passed = [c for c in docs.columns if c != text]
    schema = docs.select(*passed).schema

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(pattern)
        press = zstandard.ZstdCompressor(level=3).compress
        part, k, held = TaskContext.get().partitionId() << 24, 0, 0
        texts: list[str] = []
        beside: list[pa.RecordBatch] = []  # the other columns of texts

        def batch_of(kind, bucket, codes, more, kept) -> pa.RecordBatch:
            n = len(codes)
            to = [-1 - b for b in bucket] if kind == 2 else [part + k] * n
            arrays = [pa.array(to, pa.int64()), pa.array([part + k] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(codes, pa.binary()), pa.array(more, pa.binary())]
            arrays += [pa.nulls(n, f.type) for f in beside[0].schema] if kept is None else kept.columns
            return pa.RecordBatch.from_arrays(arrays, ["to", "batch", "kind", "bucket", "codes", "more", *passed])

        def flush() -> Iterator[pa.RecordBatch]:
            # The first unit of a text has no space before it; the others are split and numbered at once. All goes in
            # slices, of which Arrow's arrays alone stay: texts and units are never held whole a second time.
            heads, sizes, rests = [], [], []
            for at in range(0, len(texts), 1024):
                some = []
                for i in range(at, min(at + 1024, len(texts))):
                    s, texts[i] = texts[i], ""
                    head, space, rest = s.partition(" ") if _single_spaced(s) else (s, "", "")
                    heads.append(head)
                    some.append(rest if space else None)
                split = pc.split_pattern(pa.array(some, pa.string()), " ")
                sizes.append(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
                rests.append(split.flatten())
            texts.clear()
            del some, split
            units, numbers = _numbered(rests)
            del rests
            first, at_head = _numbered([pa.array(heads, pa.string())])
            del heads
            at_head = at_head + len(units)
            ends = np.r_[0, np.cumsum(np.concatenate(sizes))].tolist()
            done = 0
            for others in beside:
                codes = [_pack(np.r_[at_head[i], numbers[ends[i] : ends[i + 1]]]) for i in range(done, done + others.num_rows)]
                yield batch_of(0, [0] * len(codes), codes, [None] * len(codes), others)
                done += others.num_rows
            del numbers, at_head, ends, codes
            inside, lengths = [], []
            for space, listed in ((" ", units), ("", first)):
                for at in range(0, len(listed), 1 << 14):
                    found = [find(space, unit) for unit in _listed(listed.slice(at, 1 << 14))]
                    lengths += map(len, found)
                    inside.append(pa.array(chain.from_iterable(found), pa.string()))
            del units, first, found, listed
            words_, inside = _numbered(inside)
            yield batch_of(1, [0], [_pack(np.array(lengths))], [_pack(inside)], None)
            listed = _listed(words_.cast(pa.binary()))
            bucket = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed)) % buckets
            order = np.argsort(bucket, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(members):
                    some = [listed[m] for m in members.tolist()]
                    yield batch_of(2, [int(bucket[members[0]])], [_pack(np.r_[members, [len(w) for w in some]])], [press(b"".join(some))], None)
            beside.clear()
            del words_, inside, lengths, listed
            release()

        for rows_in in rows:
            # A copy: else the texts stay as long as the columns beside them.
            others, done = rows_in.select(passed).take(pa.array(range(rows_in.num_rows))) if passed else rows_in.select(passed), 0
            for n, value in enumerate(rows_in.column(rows_in.schema.get_field_index(text))):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= batch_bytes:
                    beside.append(others.slice(done, n + 1 - done))
                    yield from flush()
                    done, held, k = n + 1, 0, k + 1
            if done < rows_in.num_rows:
                beside.append(others.slice(done))
        if texts:
            yield from flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(cut, f"to long, batch long, kind int, bucket int, codes binary, more binary{', ' if fields else ''}{fields}")


def _distinct_words(ranks: dict[bytes, int], fold_bytes: int):
    """(word, owners, numbers, known): each word of a bucket once, with the batches and their numbers that ask for it.

    The rows come sorted by bucket, and one bucket is held at a time. known has the ids of words too long for the fold,
    else null.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        owners: dict[bytes, list[int]] = defaultdict(list)
        numbers: dict[bytes, list[int]] = defaultdict(list)
        current = None

        def settle() -> Iterator[pa.RecordBatch]:
            listed = list(owners)
            for at in range(0, len(listed), 10_000):
                some = listed[at : at + 10_000]
                known = [heap_encode(w, ranks) if len(w) > fold_bytes else None for w in some]
                columns = [pa.array([owners[w] for w in some], pa.list_(pa.int64())), pa.array([numbers[w] for w in some], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *columns, pa.array(known, pa.list_(pa.int32()))], ["word", "owners", "numbers", "known"])
            owners.clear()
            numbers.clear()

        for batch in rows:
            for owner, bucket, codes, more in zip(*(batch.column(c).to_pylist() for c in ("batch", "bucket", "codes", "more")), strict=True):
                if bucket != current:
                    yield from settle()
                    current = bucket
                members, lengths = np.split(_unpack(codes), 2)
                bytes_, at = expand(more), 0
                for number, size in zip(members.tolist(), lengths.tolist(), strict=True):
                    word = bytes_[at : at + size]
                    owners[word].append(owner)
                    numbers[word].append(number)
                    at += size
        yield from settle()
        release()

    return run


#: Places and ids that a task gathers before it packs them.
PACKED = 1 << 19


def _answers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, numbers, sizes, ids): what words are in each batch, packed."""
    held: list[tuple[np.ndarray, ...]] = []
    weight = 0

    def pack() -> Iterator[pa.RecordBatch]:
        size, flat, word, owner, number = (np.concatenate(x) for x in zip(*held, strict=True))
        start = np.cumsum(size) - size
        order = np.lexsort((number, owner))
        owner, number, word = owner[order], number[order], word[order]
        for a, b in zip(cuts := np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), np.r_[cuts[1:], len(owner)], strict=True):
            mine = word[a:b]
            within = np.arange(int(size[mine].sum())) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
            taken = flat[np.repeat(start[mine], size[mine]) + within]
            packed = [_pack(np.diff(number[a:b], prepend=0)), _pack(size[mine]), _pack(taken)]
            yield pa.RecordBatch.from_arrays([pa.array([owner[a]], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], ["part", "numbers", "sizes", "ids"])

    seen = 0
    for batch in rows:
        listed, owners, numbers = (batch.column(c) for c in ("ids", "owners", "numbers"))
        asked = pc.list_value_length(owners).to_numpy(zero_copy_only=False)
        size = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((size, listed.flatten().to_numpy(), np.repeat(np.arange(seen, seen + len(asked)), asked), owners.flatten().to_numpy(), numbers.flatten().to_numpy()))
        seen += len(asked)
        weight += len(held[-1][1]) + len(held[-1][3])
        if weight >= PACKED:
            yield from pack()
            held, weight, seen = [], 0, 0
    if seen:
        yield from pack()
    held.clear()
    release()


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at start and are size long, for each of which, one after the other."""
    mine = size[which]
    within = np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
    return flat[np.repeat(start[which], mine) + within]


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, digests: bool = False, batch_bytes: int = 16 << 20, fold_bytes: int = 256) -> DataFrame:
    """Tokens of every document.

    Returns the columns ``keep`` (all but the text by default) with ids array<int>, n_tokens long and decoded binary;
    with ``digests`` the SHA-256 of the comma-joined ids and of the decoded bytes stand for these two.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    renamed = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    rows = _batches(renamed, "_text", vocabulary.pattern, batch_bytes, 16 * n).repartition(n, "to")
    asked, held = rows.where(after_shuffle(F.col("kind") == 2)).sortWithinPartitions("bucket"), rows.where(after_shuffle(F.col("kind") < 2))
    words_ = asked.mapInArrow(_distinct_words(vocabulary.ranks, fold_bytes), "word binary, owners array<long>, numbers array<long>, known array<int>")
    ids = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(fold_encode(F.col("word"), vocabulary))
    back = words_.select(ids.alias("ids"), "owners", "numbers").mapInArrow(_answers, "part long, numbers binary, sizes binary, ids binary")
    types = [renamed.schema[f"_{i}"].dataType.simpleString() for i in range(len(keep))]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = left.column("kind").to_numpy()
        answers = [[_unpack(x.as_py()) for x in right.column(c)] for c in ("numbers", "sizes", "ids")]
        number = np.concatenate([np.empty(0, np.int64), *map(np.cumsum, answers[0])]).astype(np.int64)
        size = np.concatenate([np.empty(0, np.uint32), *answers[1]]).astype(np.int64)
        flat = np.concatenate([np.empty(0, np.uint32), *answers[2]]).astype(np.int32)
        place = np.empty(len(number), np.int64)
        place[number] = np.arange(len(number))
        units = left.filter(pa.array(kinds == 1))
        sizes, inside = _unpack(units.column("codes")[0].as_py()).astype(np.int64), place[_unpack(units.column("more")[0].as_py())]
        # Once per distinct unit of the batch: its ids, one unit after the other.
        of_units = _gathered(flat, np.cumsum(size) - size, size, inside)
        ends = np.r_[0, np.cumsum(size[inside])][np.r_[0, np.cumsum(sizes)]]
        start, long = ends[:-1], np.diff(ends)
        documents = left.filter(pa.array(kinds == 0))
        del answers, flat
        # In slices: the table goes to Spark chunk by chunk.
        names, kind, out = [*(f"_{i}" for i in range(len(keep))), "ids"], pa.list_(pa.int32()), []
        for at in range(0, documents.num_rows, 256):
            some = documents.slice(at, 256).combine_chunks()
            ids_of = [_gathered(of_units, start, long, _unpack(code.as_py())) for code in some.column("codes")]
            out.append(pa.table([*(some.column(name) for name in names[:-1]), pa.array(ids_of, kind)], names))
        del of_units
        release()
        return pa.concat_tables(out) if out else pa.table([*(documents.column(name) for name in names[:-1]), pa.array([], kind)], names)

    fields = ", ".join([f"_{i} {t}" for i, t in enumerate(types)] + ["ids array<int>"])
    out = held.groupBy("to").cogroup(back.groupBy("part")).applyInArrow(join, fields)
    kept = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    count, decoded = F.size("ids").cast("long").alias("n_tokens"), decode(F.col("ids"), vocabulary)
    if digests:
        return out.select(*kept, count, F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
    return out.select(*kept, count, "ids", decoded.alias("decoded"))

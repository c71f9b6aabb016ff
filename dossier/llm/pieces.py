"""SentencePiece encoding and decoding over a table of distinct chunks (operator 13).

A text is normalised (a marker in front, a marker for every space) and cut into *chunks*: a run of markers with what
follows up to the next one. No piece of the vocabulary has a marker after another character (``Pieces`` checks this), so
that no merge crosses a chunk's edge and a chunk's ids don't hang on its neighbours. Every distinct chunk of the corpus
is segmented once; a document's ids are those of its chunks, joined by position. Ids are decoded by a table of pieces:
markers become spaces, stretches of byte pieces characters.

As in the byte-level operator, occurrences aren't shuffled: a task numbers the distinct chunks of a *batch* of documents
(``batch_bytes`` of text) and keeps each document as a compressed list of numbers. A batch's distinct chunks travel to
the bucket of their hash, and their ids back to the batch. A bucket's number of chunks is held down by the number of
buckets, which is derived from the size of the corpus.

Defined cases: null counts as empty; an empty text has the begin and end ids alone. Equal ids or texts stay separate
rows, an empty table gives an empty result, columns not named in ``keep`` are left out. Characters without a piece become
their bytes' pieces. Chunks of any length are merged with a heap, in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.bpe import _answers as answers
from dossier.llm.bpe import _gathered as gathered
from dossier.llm.bpe import _pack as pack
from dossier.llm.bpe import _unpack as unpack
from dossier.llm.common import after_shuffle, release

#: Fixed value: the whitespace marker.
MARK = "▁"
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Pieces:
    """The pieces of a BPE model file with byte fallback, whose normalisation is to put a marker in front and for spaces.

    The file is a published tokenizer's: its size doesn't depend on the data.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], begin: int, end: int):
        self.pieces, self.begin, self.end = pieces, begin, end
        if any(MARK in piece.lstrip(MARK) for piece, _, kind in pieces if kind == NORMAL):
            raise ValueError("a piece crosses a whitespace marker: chunks can't be segmented apart")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
            raise ValueError("pieces are normal, unknown, control or byte ones")
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = {int(piece[3:-1], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(self.bytes) < 256:
            raise ValueError("every byte has a piece")
        self.scores = {piece: score for piece, score, kind in pieces if kind == NORMAL}

    @classmethod
    def read(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as model

        with open(path, "rb") as file:
            found = model.ModelProto.FromString(file.read())
        norm = found.normalizer_spec
        if found.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or found.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models whose normalisation is a marker in front and for spaces are read")
        return cls([(p.piece, p.score, p.type) for p in found.pieces], found.trainer_spec.bos_id, found.trainer_spec.eos_id)

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk: neighbours whose union is a piece merge, the highest score first, then the leftmost."""
        ends = list(range(1, len(chunk) + 1))  # end of the piece that starts at i, 0 when it was merged away
        before = list(range(-1, len(chunk) - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < len(chunk) and (score := self.scores.get(chunk[i : ends[j]])) is not None:
                heapq.heappush(heap, (-score, i, ends[j]))

        for i in range(len(chunk) - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= len(chunk) or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < len(chunk):
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < len(chunk):
            piece = chunk[i : ends[i]]
            out += [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            i = ends[i]
        return out

    def table(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Starts and lengths of every id's bytes in the bytes that follow; a marker's are a space's, control ids have none."""
        some = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        size = np.fromiter(map(len, some), np.int64, len(some))
        return np.cumsum(size) - size, size, b"".join(some)


def decoded(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, bytes], marked: np.ndarray) -> bytes:
    """The text of ids as UTF-8, without the space of a marker in front; bytes that are no character become U+FFFD each.

    marked: which ids begin with a marker.
    """
    start, size, flat = table
    out = gathered(np.frombuffer(flat, np.uint8), start, size, ids).tobytes()
    written = ids[size[ids] > 0]
    if len(written) and marked[written[0]]:
        out = out[1:]
    try:
        out.decode()
    except UnicodeDecodeError:
        out = _mended(out)
    return out


def _mended(found: bytes) -> bytes:
    out, at = [], 0
    while at < len(found):
        try:
            found[at:].decode()
            out.append(found[at:])
            break
        except UnicodeDecodeError as e:
            out += [found[at : at + e.start], "�".encode()]
            at += e.start + 1
    return b"".join(out)


def chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts, one after the other, and how many each text has."""
    marked = [MARK + s.replace(" ", MARK) if s else "" for s in texts]
    found = [CHUNKS.findall(s) for s in marked]
    return pa.array([c for some in found for c in some], pa.large_string()), np.fromiter(map(len, found), np.int64, len(found))


def _batches(docs: DataFrame, text: str, batch_bytes: int, buckets: int) -> DataFrame:
    """Rows of a batch by kind: 0 a document (its chunks' numbers), 1 the chunks of a bucket. to: the batch, or below zero the bucket."""
    passed = [c for c in docs.columns if c != text]
    schema = docs.select(*passed).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        part, k, held = TaskContext.get().partitionId() << 24, 0, 0
        texts: list[str] = []
        others: list[pa.RecordBatch] = []  # the other columns of texts

        def rows(to, kind, codes, more, kept) -> pa.RecordBatch:
            n = len(codes)
            arrays = [pa.array(to, pa.int64()), pa.array([part + k] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(codes, pa.binary()), pa.array(more, pa.binary())]
            arrays += [pa.nulls(n, f.type) for f in others[0].schema] if kept is None else kept.columns
            return pa.RecordBatch.from_arrays(arrays, ["to", "batch", "kind", "codes", "more", *passed])

        def flush() -> Iterator[pa.RecordBatch]:
            listed, sizes = chunks(texts)
            texts.clear()
            coded = listed.dictionary_encode()
            del listed
            numbers, ends, done = coded.indices.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)].tolist(), 0
            for some in others:
                codes = [pack(numbers[ends[i] : ends[i + 1]]) for i in range(done, done + some.num_rows)]
                yield rows([part + k] * len(codes), 0, codes, [None] * len(codes), some)
                done += some.num_rows
            distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
            bucket = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)) % buckets
            order = np.argsort(bucket, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(members):
                    some = [distinct[m] for m in members.tolist()]
                    yield rows([-1 - int(bucket[members[0]])], 1, [pack(np.r_[members, [len(w) for w in some]])], [press(b"".join(some))], None)
            others.clear()
            del coded, numbers, distinct
            release()

        for batch in batches:
            beside, done = batch.select(passed), 0
            for n, value in enumerate(batch.column(text)):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= batch_bytes:
                    others.append(beside.slice(done, n + 1 - done))
                    yield from flush()
                    done, held, k = n + 1, 0, k + 1
            if done < batch.num_rows:
                others.append(beside.slice(done))
        if texts:
            yield from flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(cut, f"to long, batch long, kind int, codes binary, more binary{', ' if fields else ''}{fields}")


def _segmented(pieces: Pieces):
    """Packed ids for each batch of the chunks it asks for. The rows come sorted by bucket: one is held at a time, each chunk once."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        askers: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        current = None

        def settle() -> Iterator[pa.RecordBatch]:
            listed = list(askers)
            for at in range(0, len(listed), 10_000):
                some = listed[at : at + 10_000]
                ids = [pieces.segment(c.decode("utf-8", "surrogatepass")) for c in some]
                columns = [pa.array(ids, pa.list_(pa.int32())), *(pa.array([askers[c][side] for c in some], pa.list_(pa.int64())) for side in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "owners", "numbers"])
            askers.clear()

        for batch in batches:
            for to, owner, codes, more in zip(*(batch.column(c).to_pylist() for c in ("to", "batch", "codes", "more")), strict=True):
                if to != current:
                    yield from settle()
                    current = to
                members, lengths = np.split(unpack(codes), 2)
                flat, at = expand(more), 0
                for number, size in zip(members.tolist(), lengths.tolist(), strict=True):
                    owners, numbers = askers[flat[at : at + size]]
                    owners.append(owner)
                    numbers.append(number)
                    at += size
        yield from settle()

    return lambda batches: answers(settled(batches))


def encode_decode(docs: DataFrame, pieces: Pieces, text: str = "text", keep: list[str] | None = None, digests: bool = False, batch_bytes: int = 16 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Ids of every document, with the begin and the end id, and what they decode to.

    Returns the columns ``keep`` (all but the text by default) with ids array<int>, n_tokens long and decoded string; with
    ``digests`` the SHA-256 of the ids as little-endian 32-bit integers and of the decoded text stand for these two.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(n, -(-total // bucket_bytes))
    renamed = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    rows = _batches(renamed, "_text", batch_bytes, buckets).repartition(n, "to")
    asked, held = rows.where(after_shuffle(F.col("kind") == 1)).sortWithinPartitions("to"), rows.where(after_shuffle(F.col("kind") == 0))
    back = asked.mapInArrow(_segmented(pieces), "part long, numbers binary, sizes binary, ids binary")
    names = [f"_{i}" for i in range(len(keep))]
    types = [renamed.schema[c].dataType.simpleString() for c in names]
    table, (begin, end) = pieces.table(), (pieces.begin, pieces.end)
    marked = np.array([p.startswith(MARK) for p, _, _ in pieces.pieces])

    def join(documents: pa.Table, found: pa.Table) -> pa.Table:
        parts = [[unpack(x.as_py()) for x in found.column(c)] for c in ("numbers", "sizes", "ids")]
        number = np.concatenate([np.empty(0, np.int64), *map(np.cumsum, parts[0])]).astype(np.int64)
        size = np.concatenate([np.empty(0, np.uint32), *parts[1]]).astype(np.int64)
        flat = np.concatenate([np.empty(0, np.uint32), *parts[2]]).astype(np.int32)
        start, long = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        start[number], long[number] = np.cumsum(size) - size, size
        del parts
        out = []
        for at in range(0, documents.num_rows, 256):  # in slices: the table goes to Spark chunk by chunk
            some = documents.slice(at, 256).combine_chunks()
            ids = [np.r_[begin, gathered(flat, start, long, unpack(code.as_py()).astype(np.int64)), end].astype(np.int32) for code in some.column("codes")]
            texts = [decoded(x, table, marked) for x in ids]
            count = pa.array(list(map(len, ids)), pa.int64())
            if digests:
                columns = [count, pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            else:
                columns = [count, pa.array(ids, pa.list_(pa.int32())), pa.array([x.decode() for x in texts], pa.string())]
            out.append(pa.table([*(some.column(c) for c in names), *columns], [*names, *results]))
        release()
        return pa.concat_tables(out)

    results = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kinds = ["long", "string", "string"] if digests else ["long", "array<int>", "string"]
    schema = ", ".join(f"{c} {t}" for c, t in zip([*names, *results], [*types, *kinds], strict=True))
    out = held.groupBy("to").cogroup(back.groupBy("part")).applyInArrow(join, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *results)

"""Full-text and vector search (FTS1-FTS11, VEC1-VEC5, RNK1-RNK7).

Words are searched in one scan: for each phrase of the query the scan counts hits per document and field, so that no
table of postings is shuffled; the corpus statistics are a single row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType

from dossier.functions.text import TOKEN, fold, fold_text

#: Weight of each field in BM25, in the fields' order.
WEIGHTS = {"filename": 3.0, "body": 1.0, "sender": 4.0, "party": 3.0, "type": 3.0, "topic": 3.0, "object": 4.0, "reference": 4.0, "date": 3.0, "period": 2.0, "deadline": 2.0, "amount": 2.0, "jurisdiction": 3.0, "language": 2.0, "tag": 4.0, "interpretation": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, FLOOR, CANDIDATES, RESULTS, SHORTEST = 60, 0.56, 200, 50, 3


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row, of one field or any; the last one may be a prefix."""

    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False

    def __str__(self) -> str:
        text = f'"{" ".join(self.words)}"' + " *" * self.prefix
        return f"{self.field} : {text}" if self.field else text


_TOKENS = re.compile(r"[^\W_]+")


def parse(text: str) -> list[Phrase]:
    """FTS2: the search box's language.

    Bare terms, "phrases", field:term and field:"phrase"; the last bare term of two or more characters is a prefix.
    An unknown field's sign is dropped, and an open quotation closes at the end.
    """
    found: list[tuple[str, str | None, bool]] = []
    at = 0
    part = re.compile(r'\s*(?:([^\s":]+):)?(?:"([^"]*)"?|([^\s"]+))')
    while at < len(text) and (m := part.match(text, at)):
        at = m.end()
        field = m[1].lower() if m[1] else None
        if m[2] is not None:
            if field and field not in WEIGHTS:
                found.append((field, None, False))
                field = None
            found.append((m[2].strip(), field, False))
        else:
            term = m[3] if field is None or field in WEIGHTS else f"{field}{m[3]}"
            term = "".join(c for c in term if c.isalnum() or c in "-.")
            found.append((term, field if field in WEIGHTS else None, at >= len(text.rstrip())))
    out = []
    for words, field, last in found:
        if _TOKENS.search(words):
            out.append(Phrase(tuple(w for w in words.split() if _TOKENS.search(w)) if " " in words else (words,), field, last and len(words) >= 2))
    return out


def parse_any(text: str) -> list[Phrase]:
    """FTS3: the distinct words of a question, any of which may occur."""
    return [Phrase((w,)) for w in dict.fromkeys(_TOKENS.findall(fold_text(text)))]


def folded_words(phrase: Phrase) -> list[str]:
    return [t for w in phrase.words for t in _TOKENS.findall(fold_text(w))]


def _hits(line: Column, phrase: Phrase) -> Column:
    """Occurrences of a phrase in tokens joined by spaces, with a space at both ends."""
    joined = " ".join(re.escape(t) for t in folded_words(phrase))
    return F.regexp_count(line, F.lit(f"(?= {joined}{'' if phrase.prefix else ' '})"))


def scan(docs: DataFrame, fields: dict[str, str], phrases: list[Phrase], key: str = "doc_id") -> DataFrame:
    """(key, dl, tf0, tf1, ...): tokens of a document over all fields, and weighted hits of each phrase.

    fields: name of a field to its column in docs.
    """
    words = lambda c: F.trim(F.regexp_replace(fold(F.coalesce(F.col(c), F.lit(""))), f"[^{TOKEN[1:-2]}]+", " "))
    split = docs.select(key, *[words(c).alias(f"t_{f}") for f, c in fields.items()])
    count = lambda f: F.when(F.col(f"t_{f}") == "", 0).otherwise(F.length(f"t_{f}") - F.length(F.replace(F.col(f"t_{f}"), F.lit(" "), F.lit(""))) + 1)
    lines = split.select(key, sum((count(f) for f in fields), F.lit(0)).cast("long").alias("dl"), *[F.concat(F.lit(" "), F.col(f"t_{f}"), F.lit(" ")).alias(f) for f in fields])
    tf = [sum((_hits(F.col(f), p) * F.lit(WEIGHTS[f]) for f in fields if p.field in (None, f)), F.lit(0.0)).alias(f"tf{i}") for i, p in enumerate(phrases)]
    return lines.select(key, "dl", *tf)


def bm25(docs: DataFrame, fields: dict[str, str], phrases: list[Phrase], any_of: bool = False, within: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """FTS5, FTS6: (key, score) of the documents with all phrases, or any; statistics are the whole corpus's."""
    # A row of numbers per document, read for the statistics and for the scores; lost parts are scanned again.
    found = scan(docs, fields, phrases, key).persist()
    n = range(len(phrases))
    stats = found.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in n])
    scored = found.where(" OR ".join(f"tf{i} > 0" for i in n) if any_of else " AND ".join(f"tf{i} > 0" for i in n))
    if within is not None:
        scored = scored.join(within.select(key).distinct(), key, "left_semi")
    scored = scored.crossJoin(F.broadcast(stats))  # a single row
    idf = lambda i: F.greatest(F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select(key, sum((part(i) for i in n), F.lit(0.0)).alias("score"))


def top(scored: DataFrame, limit: int = RESULTS, key: str = "doc_id", by: str = "score") -> DataFrame:
    """FTS7: the best, ties by key."""
    return scored.orderBy(F.desc(by), key).limit(limit)


@F.pandas_udf(StringType())
def _snippet(bodies: pd.Series, words: pd.Series) -> pd.Series:
    def one(body: str, asked: list[str]) -> str:
        spans = [(m.start(), m.end(), fold_text(m[0])) for m in _TOKENS.finditer(body or "")]
        best, at, size = -1, 0, 24
        for i in range(max(1, len(spans) - size + 1)):
            held = len({t for _, _, t in spans[i : i + size]} & asked)
            if held > best:
                best, at = held, i
        some = spans[at : at + size]
        if not some:
            return ""
        out, last = ["…"] if at else [], some[0][0]
        for a, b, t in some:
            out += [body[last:a], f"{body[a:b]}" if t in asked else body[a:b]]
            last = b
        return "".join(out) + ("…" if at + size < len(spans) else "")

    return pd.Series([one(b, set(w)) for b, w in zip(bodies, words, strict=True)])


def snippet(body: Column, phrases: list[Phrase]) -> Column:
    """FTS9: the 24 tokens with the most different query words, these between U+E000 and U+E001."""
    return _snippet(body, F.array(*[F.lit(w) for p in phrases for w in folded_words(p)]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """VEC1: of length one; a zero vector stays."""
    size = F.sqrt(dot(vector, vector))
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(F.transform(vector, lambda x: x.cast("double")))


@F.pandas_udf(ArrayType(FloatType()))
def vector_of_bytes(some: pd.Series) -> pd.Series:
    """VEC2: little-endian Float32 bytes to a vector."""
    return some.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))


@F.pandas_udf(BinaryType())
def bytes_of_vector(some: pd.Series) -> pd.Series:
    return some.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def modal_dimension(vectors: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """VEC4: the vectors of the commonest dimension, on ties the one of the first vector by ``key`` (the first column); empty ones go."""
    key = key or vectors.columns[0]
    filled = vectors.where(F.size(column) > 0)
    mode = filled.groupBy(F.size(column).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).orderBy(F.desc("n"), "first").limit(1).select("dim")
    return filled.join(F.broadcast(mode), F.size(column) == F.col("dim"), "left_semi")  # a single row


def with_changes(vectors: DataFrame, changes: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """VEC5: the snapshot after its changes (key, column, seq): the last change of a key wins, a null vector removes it."""
    last = changes.groupBy(key).agg(F.max_by(column, "seq").alias(column))
    kept = vectors.select(key, column).join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(column).isNotNull()))


def vector_top(vectors: DataFrame, query: list[float], limit: int, key: str, column: str, allowed: DataFrame | None = None) -> DataFrame:
    """VEC3: (key, similarity) of the nearest by dot product."""
    rows = vectors if allowed is None else vectors.join(allowed.select(key).distinct(), key, "left_semi")
    near = rows.where(F.size(column) == len(query)).select(key, dot(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    return near.orderBy(F.desc("similarity"), key).limit(limit)


def fuse(words: DataFrame, meaning: DataFrame, floor: float = FLOOR, k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """RNK1-RNK3: word hits (key, score) and hits by meaning (key, similarity) of limited lists in one order.

    Word hits come first, by the sum of reciprocal ranks, then their own rank; then the others by similarity.
    """
    first = words.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("word_rank"))
    near = meaning.where(F.col("similarity") >= floor)
    second = near.select(key, "similarity", F.row_number().over(Window.orderBy(F.desc("similarity"), key)).alias("meaning_rank"))
    both = first.join(second, key, "full_outer")
    score = F.coalesce(1.0 / (k + F.col("word_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("meaning_rank")), F.lit(0.0))
    ranked = both.withColumn("score", score)
    order = [F.col("word_rank").isNull(), F.when(F.col("word_rank").isNotNull(), -F.col("score")).otherwise(-F.col("similarity")), F.col("word_rank"), F.col(key)]
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(key, "place", "score", "word_rank", "meaning_rank")


def within_set(docs: DataFrame, fields: dict[str, str], phrases: list[Phrase], vectors: DataFrame, query: list[float], ids: DataFrame, floor: float = FLOOR, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """FTS11: the documents of a set that words or meaning find, in one order; statistics are the whole corpus's."""
    words = top(bm25(docs, fields, phrases, any_of=True, within=ids, key=key), CANDIDATES, key)
    near = vector_top(vectors, query, CANDIDATES, key, column, ids)
    return fuse(words, near, floor, key=key)


def gate(text: str, has_model: bool, has_vectors: bool) -> str | None:
    """RNK4: why a query is answered by words alone; null if it isn't."""
    if len(text.strip()) < SHORTEST:
        return "short"
    return None if has_model and has_vectors else "noVectors" if has_model else "noModel"


@F.pandas_udf(ArrayType(FloatType()))
def stub_embedding(some: pd.Series) -> pd.Series:
    """LLM2 stand-in: hashed words of over two characters (FNV-1a), of length one."""

    def one(text: str | None) -> np.ndarray:
        out = np.zeros(64)
        for word in _TOKENS.findall(fold_text(text or "")):
            if len(word) > 2:
                h = 0xCBF29CE484222325
                for byte in word.encode():
                    h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
                out[h % 64] += 1
        size = np.linalg.norm(out)
        return (out / size if size else out).astype(np.float32)

    return some.map(one)

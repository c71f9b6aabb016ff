"""TXT6: a guess of a text's language by ranked n-gram profiles.

A profile is the ``SIZE`` commonest n-grams of a language's words, by rank. A text is ranked likewise, and its distance
from a profile is the sum over its n-grams of how far they stand from their place there, or SIZE where they have none.
One minus the mean distance, as a share of SIZE, is how near a language is; ``SHARPNESS`` turns these into shares of one
over all languages, of which the largest is the guess.

Defined cases: a null text, and one without a letter, is ``und``; a guess of less than ``SURE`` is ``other``, or for a
text of fewer than ``WORDS`` words less than ``SURE_OF_SHORT``; of equal languages the first by name. Rows without a
language teach nothing; without any, every text with a letter is ``other``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, SHARPNESS = 300, 12.0
#: The least confidence, also of a text of few words, and how many are few.
SURE, SURE_OF_SHORT, WORDS = 0.5, 0.9, 4

Profiles = dict[str, dict[str, int]]

#: Characters of texts that are counted at once when profiles are learned; bits of a character in an n-gram's number.
CHUNK, BITS = 1 << 18, 21


def words(text: Column) -> Column:
    """A text's words in lower case, a space between two: as one string, which costs Python less than a list."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "))


def grams(some: str) -> tuple[np.ndarray, np.ndarray]:
    """The 3-grams of words with a space at both ends as numbers, in the order of their code points, and how often each occurs."""
    codes = np.frombuffer(f" {some} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    # An n-gram of one word has no space inside.
    return np.unique((codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:])[codes[1:-1] != ord(" ")], return_counts=True)


def ranked(some: str) -> np.ndarray:
    """The commonest, ties by the n-gram's code points."""
    found, n = grams(some)
    return found[np.argsort(-n, kind="stable")[:SIZE]]


def _number(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 2 * BITS | b << BITS | c


def _written(gram: int) -> str:
    return "".join(chr(gram >> k * BITS & (1 << BITS) - 1) for k in (2, 1, 0))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages of docs: counts are summed by task, then by n-gram; SIZE rows a language reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        waiting: dict[str, list[str]] = defaultdict(list)
        sizes: Counter = Counter()

        def settle(name: str) -> None:
            found, n = grams(" ".join(waiting.pop(name)))
            held[name].update(dict(zip(found.tolist(), n.tolist(), strict=True)))
            sizes[name] = 0

        for batch in batches:
            for name, some in zip(batch.column("lang").to_pylist(), batch.column("words"), strict=True):
                if some := some.as_py():
                    waiting[name].append(some)
                    sizes[name] += len(some)
                    if sizes[name] >= CHUNK:
                        settle(name)
        for name in list(waiting):
            settle(name)
        rows = [(name, _written(g), n) for name, c in held.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), words(F.col(text)).alias("words"))
    summed = known.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: Profiles = {}
    for row in summed.withColumn("place", place).where(F.col("place") <= SIZE).collect():
        out.setdefault(row["lang"], {})[row["gram"]] = row["place"] - 1
    return out


def guesser(profiles: Profiles) -> Callable[[str], tuple[str, float]]:
    """Language and confidence of a text's words; the profiles are one table, of n-grams by languages."""
    names = sorted(profiles)
    known = np.array(sorted({_number(g) for p in profiles.values() for g in p}), np.int64)
    places = np.full((len(known) + 1, len(names)), -1, np.int64)  # -1, as in the last row: no place
    for k, name in enumerate(names):
        for gram, place in profiles[name].items():
            places[np.searchsorted(known, _number(gram)), k] = place
    known = np.r_[known, -1]

    def guess(some: str) -> tuple[str, float]:
        if not some:
            return "und", 0.0
        mine = ranked(some)
        at = np.searchsorted(known[:-1], mine)
        there = places[np.where(known[at] == mine, at, -1)]
        apart = np.where(there < 0, SIZE, np.abs(np.arange(len(mine))[:, None] - there)).sum(axis=0).tolist()
        near = {name: (1 - d / (SIZE * len(mine))) ** SHARPNESS for name, d in zip(names, apart, strict=True)}
        total = sum(near[name] for name in names)
        if not total:
            return "other", 0.0
        best = min(near, key=lambda name: (-near[name], name))
        share = near[best] / total
        return (best if share >= (SURE_OF_SHORT if some.count(" ") + 1 < WORDS else SURE) else "other"), share

    return guess


def detect(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with language and confidence, which replace columns of these names."""
    names = [c for c in docs.columns if c not in ("language", "confidence")]
    row = docs.select(F.struct(*names).alias("row"), words(F.col(text)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = guesser(profiles)
        for batch in batches:
            found = [guess(some.as_py()) for some in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["row", "language", "confidence"])

    out = row.mapInArrow(run, f"row {row.schema['row'].dataType.simpleString()}, language string, confidence double")
    return out.select("row.*", "language", "confidence")

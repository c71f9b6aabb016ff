"""Toxicity by a weighted lexicon, matched with Aho-Corasick (operator 8).

Texts are folded one character to one: lower case, accents dropped, look-alike letters of other scripts and digits and
signs used as letters replaced; characters without width are removed first. Lexicon terms match at word boundaries of
the text as written. A match inside an exception phrase doesn't count. The weights of a text's matches, as such and
normalised by its length, give a score by a logistic function.

The lexicon starts from SEED at a small weight. Labels give weights: the smoothed log-odds of a folded word among toxic
and other labelled documents, cut at the bounds of the text as written; words that are frequent enough in the toxic ones (``least_count``, ``least_share``) and
telling enough (``least_odds``) join the lexicon. A two-word phrase around a term that labelled documents
hold without being toxic becomes an exception. Labels are learned from at most ``most_labels`` labelled rows, chosen by
a hash of their ids and texts; all that reaches the driver is counted from these.

Defined cases: null and empty texts have no match and get the score of no match; documents without a label train
nothing, and without any label the seed weights and a default function serve; a doc_id with two labels counts with
each; repeated rows train once; an empty table gives an empty result; other columns are passed
through unless named like a result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import labelled, stored, words

#: Insults to start from, and phrases in which such words are harmless.
SEED = "idiot idiots moron morons imbecile stupid dumb dumbass trash scum scumbag loser losers pathetic worthless disgusting clown filth vermin bastard bastards bitch asshole jerk freak retard subhuman degenerate".split()
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "class clown", "jerk chicken", "freak accident", "freak wave", "dumb waiter", "dumb bell", "sore loser", "control freak"]
SEED_WEIGHT = 2.0
#: Characters that look like Latin letters, or stand for them.
ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e",
}
HIDDEN = re.compile("[­​-‏⁠﻿]")
#: A word of a text as written: letters and digits, with signs that stand for letters in front and inside, not after.
WORD = re.compile(r"[@$€|]?[^\W_](?:[^\W_]|[@$!|€](?=[^\W_]))+")
LONGEST = 40
DEFAULT = (-3.0, 0.9, 0.4)


class _Fold(dict):
    """Translation table filled as characters occur."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)
        small = base[0].lower() if base else c
        small = ALIKE.get(small, small)
        self[code] = small = small if len(small) == 1 else c
        return small


_FOLD = _Fold()
_LATIN = "".join(_FOLD[c] if ord(_FOLD[c]) < 256 else chr(c) for c in range(256)).encode("latin-1")


def fold(text: str) -> tuple[str, str]:
    """The text without hidden characters, and its folded form of the same length."""
    if not text.isascii() and HIDDEN.search(text):
        text = HIDDEN.sub("", text)
    try:  # the characters of most texts: a table of 256
        return text, text.encode("latin-1").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        return text, text.translate(_FOLD)


def folded_words(text: str) -> set[str]:
    """The folded words of a text. Their bounds are those of the text as written, so that "idiot!" is the word "idiot"; words without a letter are none."""
    plain, folded = fold(text)
    found = {(m.start(), m.end()) for m in WORD.finditer(plain) if m.end() - m.start() <= LONGEST}
    return {folded[a:b] for a, b in found if any(map(str.isalpha, plain[a:b]))}


class Lexicon:
    """Terms with weights, exception phrases, and the automaton over both."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float] = DEFAULT):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, automaton, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms that count, on the folded text; of overlapping ones the first, and the longest that starts there."""
        if not len(automaton) or not text:
            return []
        plain, folded = fold(text)
        found, spared = [], []
        for last, (size, weight) in automaton.iter(folded):
            start, end = last + 1 - size, last + 1
            if (start and plain[start - 1].isalnum()) or (end < len(plain) and plain[end].isalnum()):
                continue
            (spared if weight is None else found).append((start, end, weight))
        if spared:
            # The furthest end of the phrases that have begun: a match that ends no later is inside one.
            spared.sort()
            begun, reach = [a for a, _, _ in spared], list(accumulate((b for _, b, _ in spared), max))
            found = [m for m in found if not (k := bisect_right(begun, m[0])) or reach[k - 1] < m[1]]
        apart, last = [], 0
        for m in sorted(found, key=lambda m: (m[0], -m[1])):
            if m[0] >= last:
                apart.append(m)
                last = m[1]
        return apart

    def score(self, weight: float, n_words: int) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(weight) + c * math.log1p(100 * weight / max(n_words, 1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, least_count: int = 6, least_share: float = 0.003, least_odds: float = 3.0) -> Lexicon:
    """A lexicon from labels (doc_id, toxic) of docs (doc_id, text)."""
    rows = stored(labelled(docs, labels, "toxic", most_labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, toxic = [""] * batch.num_rows, list(batch.column(0).to_pylist())  # the empty term counts the documents
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distinct = folded_words(text.as_py() or "")
                terms += distinct
                toxic += [label] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])

    counted = rows.mapInArrow(count, "term string, toxic int").groupBy("term").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("bad"), F.sum((F.col("toxic") == 0).cast("long")).alias("good"))
    total = counted.where("term = ''").first()
    weights = dict.fromkeys(SEED, SEED_WEIGHT)
    if not total or not total["bad"] or not total["good"]:
        return Lexicon(weights, EXCEPTIONS)
    bad, good = total["bad"], total["good"]
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    frequent = (F.col("bad") >= max(least_count, least_share * bad)) & (odds >= least_odds)
    found = counted.where("term <> ''").select("term", odds.alias("odds"), frequent.alias("frequent"), "bad", (F.col("bad") + F.col("good")).alias("n")).where(F.col("frequent") | F.col("term").isin(SEED))
    for term, weight, often, _, n in found.orderBy("term").collect():  # at most 1 / least_share terms of a toxic document's words
        weights[term] = weight if often else (SEED_WEIGHT * 20 + weight * n) / (20 + n)
    weights = {t: w for t, w in weights.items() if w > 0}
    draft = Lexicon(weights, EXCEPTIONS)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = draft.automaton()
        around = re.compile(r"([^\W\d_]{2,40}) $"), re.compile(r"^ ([^\W\d_]{2,40})\b")
        for batch in batches:
            out: list[tuple] = []
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                matches, folded = draft.matches(automaton, text), fold(text)[1]
                out.append((label, None, sum(m[2] for m in matches), len(words(text))))
                phrases = set()
                for start, end, _ in matches:
                    if before := around[0].search(folded[max(0, start - 42) : start]):
                        phrases.add(f"{before[1]} {folded[start:end]}")
                    if after := around[1].search(folded[end : end + 42]):
                        phrases.add(f"{folded[start:end]} {after[1]}")
                out += [(label, p, None, None) for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.float64(), pa.int64()))], ["toxic", "phrase", "weight", "n"])

    seen = rows.mapInArrow(contexts, "toxic int, phrase string, weight double, n long")
    phrases = seen.where("phrase IS NOT NULL").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("share")).where("n >= 5 AND share <= 0.1")
    exceptions = EXCEPTIONS + [r["phrase"] for r in phrases.orderBy("phrase").collect()]
    points = seen.where("phrase IS NULL").select("toxic", "weight", "n").toPandas()  # at most most_labels rows of labels per document
    return Lexicon(weights, exceptions, _fit(points["toxic"].to_numpy(float), points["weight"].to_numpy(float), points["n"].to_numpy(float)))


def _fit(y: np.ndarray, weight: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the weight and the weight by length, with a ridge; slopes aren't negative."""
    x = np.column_stack([np.ones(len(y)), np.log1p(weight), np.log1p(100 * weight / np.maximum(n, 1))])
    use = [0, 1, 2]
    while True:
        w = np.zeros(len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w, -30, 30)))
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + 0.5 * np.eye(len(use))
            step = np.linalg.solve(h, x[:, use].T @ (y - p) - 0.5 * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        below = [k for k, v in zip(use, w, strict=True) if k and v < 0]
        if not below:
            out = np.zeros(3)
            out[use] = w
            return tuple(out.tolist())
        use = [k for k in use if k not in below]


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with n_matches, weight and score (0 to 1)."""
    results = ("n_matches", "weight", "score")
    names = [c for c in docs.columns if c not in results]
    at, schema = names.index("text"), docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            n, weight, scores = [], [], []
            for value in batch.column(at):
                text = value.as_py() or ""
                found = lexicon.matches(automaton, text)
                n.append(len(found))
                weight.append(float(sum(m[2] for m in found)))
                scores.append(lexicon.score(weight[-1], len(words(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(scores, pa.float64())], [*names, *results])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["n_matches long", "weight double", "score double"])
    return docs.select(*names).mapInArrow(run, fields)

"""Language identification by error-correcting output codes (operator 5).

Every language has a codeword; each bit of it is predicted by a binary classifier of byte n-grams (naive Bayes over
hashed, position-free runs of bytes: the log-odds between the languages whose bit is 1 and those whose bit is 0).
Decoding takes the language whose codeword has the least sum of logistic losses against the predicted margins, each
bit weighted by how well it held on the training texts. A decision whose loss is close to the runner-up's is flagged as
ambiguous.

Training counts n-grams over *all* training rows of *all* languages: tasks count into tables of ``slots`` by language,
which Spark sums to the classifiers' weights. What reaches the driver is the languages' codewords and a table of slots
by bits, bits being 12 times the logarithm of the number of languages, whatever the input.

Defined cases: a null text, or one without a letter, is `und` with score 0 and not ambiguous; so is every text when
there is nothing to learn from; a null lang trains nothing; one known language is the answer for every text with
letters; repeated rows count as often as they occur; an empty table gives an empty result; other columns are passed
through unless named like a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import release, small_batches, stored

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case; other ASCII is a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str, slots: int) -> np.ndarray:
    """Slots of the byte 2- and 3-grams of a text."""
    x = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    pair = x[:-1] * np.uint32(257) + x[1:]
    three = pair[:-1] * np.uint32(263) + x[2:] + np.uint32(7)
    found = np.concatenate([pair * np.uint32(2654435761), three * np.uint32(2246822519)])
    return found >> np.uint32(32 - slots.bit_length() + 1)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of bits per language: all splits for up to five languages, else random codes.

    Of 50 random codes the one of the largest least distance is taken; beyond 256 languages the first one, since comparing
    codes costs the square of their number, and long random codes are far apart anyway.
    """
    if languages <= 1:
        return np.zeros((languages, 1), np.int8)
    if languages <= 5:
        columns = [bits for bits in product((0, 1), repeat=languages) if bits[0] == 1 and not all(bits)]
        return np.array(columns, np.int8).T
    rng, width, best = np.random.default_rng(seed), 12 * (languages - 1).bit_length(), None
    for _ in range(50 if languages <= 256 else 1):
        code = rng.integers(0, 2, (languages, width), np.int8)
        code = code[:, (code.sum(0) > 0) & (code.sum(0) < languages)]
        apart = min((int((code[i + 1 :] != code[i]).sum(1).min()) for i in range(languages - 1)), default=0)
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """Weights of the bit classifiers (slots by bits), codewords and bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """From a whole table of n-gram counts, languages by slots."""
        self.languages, self.slots = languages, counts.shape[1] if languages else 1 << 15
        if len(languages) < 2:
            return
        self.code = codewords(len(languages))
        share = counts + 0.5
        share = share / share.sum(1, keepdims=True)  # every language weighs the same
        weights = [np.log(share[self.code[:, b] == 1].mean(0)) - np.log(share[self.code[:, b] == 0].mean(0)) for b in range(self.code.shape[1])]
        self.weights = np.array(weights, np.float32).T.copy()
        signs = 2.0 * self.code - 1
        # How far each language's own n-grams lie on the right side of a bit, on average.
        mean = (counts / np.maximum(counts.sum(1, keepdims=True), 1)) @ self.weights
        self.bit = np.maximum((mean * signs).min(0), 1e-3)
        self.bit = self.bit / self.bit.mean()

    @classmethod
    def summed(cls, languages: list[str], slots: int, code: np.ndarray, weights: np.ndarray, bit: np.ndarray) -> Model:
        """From weights and bit weights that were summed elsewhere."""
        model = cls([], np.empty((0, slots)))
        model.languages, model.slots, model.code, model.weights, model.bit = languages, slots, code, weights, bit
        return model

    def decode(self, text: str) -> tuple[str, float, float]:
        """Language, its score and the runner-up's."""
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 0.0
        found = features(text, self.slots)
        if len(found) > 4096:
            total = np.bincount(found, minlength=self.slots).astype(np.float32) @ self.weights
        else:
            total = self.weights[found].sum(0)
        # The n-grams of a text depend on each other: their sum counts as that of its square root's number.
        margin = total / np.sqrt(len(found))
        loss = (np.logaddexp(0.0, -(2.0 * self.code - 1) * margin) * self.bit).sum(1)
        odds = np.exp(loss.min() - loss)
        odds = odds / odds.sum()
        first, second = np.argsort(-odds, kind="stable")[:2]
        return self.languages[first], float(odds[first]), float(odds[second])


def train(docs: DataFrame, slots: int = 1 << 15) -> Model:
    """Counts the n-grams of docs (text, lang) by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*batch.columns, strict=True):
                value = text.as_py() or ""
                if LETTER.search(value):
                    held = tables.setdefault(lang.as_py(), np.zeros(slots, np.int64))
                    held += np.bincount(features(value, slots), minlength=slots)
        for lang, held in tables.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "slot", "n"])
        release()

    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL").select("text", "lang")
    counted = stored(known.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["total"] for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row per language
    languages = sorted(totals)
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), slots)))
    code = codewords(len(languages))
    bits = range(code.shape[1])
    # Smoothed shares: every language weighs the same.
    rows = [(lang, float(totals[lang]), [int(b) for b in code[i]]) for i, lang in enumerate(languages)]
    coded = counted.join(F.broadcast(counted.sparkSession.createDataFrame(rows, "lang string, total double, code array<int>")), "lang")
    share = F.col("n") / (F.col("total") + 0.5 * slots)
    sums = coded.groupBy("slot").agg(F.sum(share).alias("every"), *[F.coalesce(F.sum(F.when(F.get("code", b) == 1, share)), F.lit(0.0)).alias(f"b{b}") for b in bits]).toPandas()  # slots by bits
    base = 0.5 / (np.array([totals[lang] for lang in languages]) + 0.5 * slots)
    one, every = np.tile(base @ (code == 1), (slots, 1)), np.full(slots, base.sum())
    at = sums["slot"].to_numpy()
    one[at] += sums[[f"b{b}" for b in bits]].to_numpy(float)
    every[at] += sums["every"].to_numpy(float)
    ones = code.sum(0)
    weights = (np.log(one / ones) - np.log((every[:, None] - one) / (len(languages) - ones))).astype(np.float32)
    # How far each language's own n-grams lie on the right side of a bit, on average.
    table = counted.sparkSession.createDataFrame(list(enumerate(weights.astype(float).tolist())), "slot int, w array<double>")
    mean = coded.join(F.broadcast(table), "slot").groupBy("lang").agg(*[F.sum(F.col("n") / F.col("total") * F.get("w", b) * (2 * F.get("code", b) - 1)).alias(f"b{b}") for b in bits])
    bit = np.maximum(mean.agg(*[F.min(f"b{b}") for b in bits]).toPandas().to_numpy(float)[0], 1e-3)
    return Model.summed(languages, slots, code, weights, bit / bit.mean())


def predict(docs: DataFrame, model: Model, ambiguous: float = 0.1) -> DataFrame:
    """docs with lang_pred, score and ambiguous: the runner-up's score is within `ambiguous` of the best."""
    small_batches(docs.sparkSession)
    results = ("lang_pred", "score", "ambiguous")
    names = [c for c in docs.columns if c not in results]
    held = docs.sparkSession.sparkContext.broadcast(model)  # slots by bits: bounded by the code's length
    at = names.index("text")
    schema = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = held.value.decode
        for batch in batches:
            found = [decode(t.as_py() or "") for t in batch.column(at)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] != UNKNOWN and f[1] - f[2] < ambiguous for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *results])
        release()

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["lang_pred string", "score double", "ambiguous boolean"])
    return docs.select(*names).mapInArrow(run, fields)


def accepted() -> Column:
    """A document whose language is known and not ambiguous."""
    return (F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")

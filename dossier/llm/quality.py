"""Quality classifier by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of ``passage`` words. Every passage is encoded (shares of byte kinds, word length,
repetition, through a tanh layer); gated attention weights, learned from the documents' labels alone, say how much each
passage counts; the weighted representation is scored by a logistic output. (Ilse, Tomczak, Welling: Attention-based
Deep Multiple Instance Learning, 2018.)

Training reads at most ``most_labels`` labelled rows, chosen by a hash of ids and texts, and every passage of each;
scoring reads every passage of every document. Passage statistics are made by tasks; what reaches the driver is a row of
statistics per passage of the rows that train.

Defined cases: null and empty texts are one empty passage and get its score; without both kinds of labels every score is
the share of label 1 (or 0.5 without any); a doc_id with two labels counts with each; repeated rows train once; an empty table gives an empty result; other columns are passed through unless named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import labelled

#: Byte kinds by their characters; all others: bytes over 127, other ASCII.
KINDS = ["\t\x0b\x0c\r ", "\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!", "?", "#", "*", "$", "%", "&", "|", "<>", "\"'()[]{}-_/\\@+=~^`"]
_KIND = np.full(256, len(KINDS) + 1, np.uint8)
_KIND[128:] = len(KINDS)
for _k, _some in enumerate(KINDS):
    _KIND[list(_some.encode())] = _k
N_KINDS = len(KINDS) + 2
#: Kind shares, mean word length, share of words equal to the one before, share of different 4-byte ends, whether empty.
N_FEATURES = N_KINDS + 4


def passages(text: str, passage: int) -> np.ndarray:
    """A row of statistics per passage of so many words."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _KIND[x]
    inside = kind > 1
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(x) else np.empty(0, np.int64)
    if not len(starts):
        out = np.zeros((1, N_FEATURES))
        out[0, -1] = 1
        return out
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    cuts = starts[::passage]
    n = len(cuts)
    length = np.diff(np.r_[cuts, len(x)])
    owner = np.repeat(np.arange(n), length)
    counts = np.bincount(owner * N_KINDS + kind[cuts[0] :], minlength=n * N_KINDS).reshape(n, N_KINDS)
    # A word's rough identity: its length and its last four bytes.
    padded = np.r_[np.zeros(4, np.uint8), x].astype(np.uint64)
    code = padded[ends] | padded[ends + 1] << np.uint64(8) | padded[ends + 2] << np.uint64(16) | padded[ends + 3] << np.uint64(24) | (ends - starts).astype(np.uint64) << np.uint64(32)
    which = np.arange(len(starts)) // passage
    per = np.bincount(which, minlength=n)
    again = np.bincount(which, np.r_[False, code[1:] == code[:-1]], n)
    order = np.lexsort((code, which))
    fresh = np.r_[True, (code[order][1:] != code[order][:-1]) | (which[order][1:] != which[order][:-1])]
    distinct = np.bincount(which[order], fresh, n)
    out = np.empty((n, N_FEATURES))
    out[:, :N_KINDS] = np.sqrt(counts / length[:, None])
    out[:, N_KINDS] = np.log1p(np.bincount(which, ends - starts, n) / per)
    out[:, N_KINDS + 1] = again / per
    out[:, N_KINDS + 2] = distinct / per
    out[:, N_KINDS + 3] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder E, gates V and U, attention w, output c, on standardised statistics."""

    NAMES = ("E", "e", "V", "U", "w", "c", "b")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 16, gate: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = mean, scale, None
        n = len(mean)
        self.p = {
            "E": rng.normal(0, n**-0.5, (n, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags that begin at starts, with what the gradient needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        size = np.diff(np.r_[starts, len(x)])
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), size))
        a = a / np.repeat(np.add.reduceat(a, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts)
        return _sigmoid(z @ p["c"] + p["b"]), (x, h, t, g, a, z, size)

    def gradient(self, y: np.ndarray, starts: np.ndarray, score: np.ndarray, held: tuple) -> dict[str, np.ndarray]:
        p, (x, h, t, g, a, z, size) = self.p, held
        d = (score - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
        dt, dg = ds[:, None] * p["w"] * g, ds[:, None] * p["w"] * t
        dv, du = dt * (1 - t * t), dg * g * (1 - g)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (ds[:, None] * t * g).sum(0), "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.02, decay: float = 1e-4) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x_) for k, x_ in self.p.items()}
        for step in range(1, rounds + 1):
            score, held = self.forward(x, starts)
            for k, d in self.gradient(y, starts, score, held).items():
                d = d + decay * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)[0]


def train(docs: DataFrame, labels: DataFrame, passage: int = 80, most_labels: int = 4000) -> AttentionModel:
    """From labels (doc_id, quality) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(value.as_py() or "", passage).astype(np.float32).ravel() for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.float32()))], ["quality", "bag"])

    rows = labelled(docs, labels, "quality", most_labels).select("quality", "text").mapInArrow(run, "quality int, bag array<float>").toPandas()
    y = rows["quality"].to_numpy(float)
    bags = [np.asarray(b, float).reshape(-1, N_FEATURES) for b in rows["bag"]]
    x = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES))
    model = AttentionModel(x.mean(0), np.maximum(x.std(0), 0.02))
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    order = np.lexsort([[b.sum() for b in bags], y])  # rows arrive in any order
    bags, y = [bags[k] for k in order], y[order]
    model.fit(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]), y)
    return model


def score(docs: DataFrame, model: AttentionModel, passage: int = 80) -> DataFrame:
    """docs with score, from 0 to 1."""
    names = [c for c in docs.columns if c != "score"]
    at, schema = names.index("text"), docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for k in range(0, batch.num_rows, 256):
                found.append(model.score([passages(t.as_py() or "", passage) for t in batch.column(at).slice(k, 256)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.empty(0))], [*names, "score"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["score double"])
    return docs.select(*names).mapInArrow(run, fields)

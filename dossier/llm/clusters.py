"""Centroid clustering by Exponion search (operator 11).

Lloyd's rounds over integer vectors. Every vector keeps its cluster, an upper bound of the distance to its centroid and
a lower bound of the distance to any other; bounds move by what the centroids moved. A vector whose upper bound is
below its lower bound, or below half the way to the nearest other centroid, stays without a look at any centroid. Else
the upper bound is made exact, and only if that fails too the vector scans the centroids inside a ball around its own:
by the triangle inequality the nearest and the second nearest lie within twice the upper bound plus the way to the
nearest other centroid. Each centroid has the list of all others sorted by distance, so that a ball is a prefix of it;
the radius is inclusive, so that a tie is seen and goes to the smaller number. Distances are exact integers; bounds are
doubles with a margin for rounding, so that the result is that of the full scan.

A round is one pass over the vectors with their state, written once, and one aggregation of sums with a row per cluster.
Only centroids travel to the driver and back. The round before is deleted when the next one is written.

Defined cases: a vector that is null, has another length, or has a null, NaN or infinite component is left out. Repeated
rows count as often as they stand there. With fewer vectors than clusters every vector is a centroid; equal vectors give
equal centroids, of which the smaller number gets all. An empty table gives an empty result. A null id is hashed as the
empty text. Vectors of one id are ordered by their components where they start. Columns other than id and vector are
left out, whatever their names. Components of 2**27 or more after scaling raise an error: squared distances of 64 such
components would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import forget, stored

#: Share by which bounds are widened, well above the rounding of doubles and well below any use.
MARGIN = 1e-12
#: Components are below this after scaling.
MOST = 1 << 27


@dataclass
class Clusters:
    """rows: id, cluster int, distance long (squared); centroids: one row of integers per cluster."""

    rows: DataFrame
    centroids: np.ndarray


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector is left out."""
    good = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) < float(MOST / scale))
    return F.when(good & small, scaled.cast("array<int>")).when(good, F.raise_error(F.lit(f"components are below {MOST} after scaling")).cast("array<int>"))


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid (or row by row), in 64-bit integers."""
    apart = points - centroid
    return np.einsum("ij,ij->i", apart, apart)


class Exponion:
    """The centroids of a round with, for each, all centroids sorted by their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64)).reshape(len(centroids), -1)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        #: Way to the nearest other centroid; without another one it is endless.
        self.nearest = self.apart[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)

    def scan(self, points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the centroids numbered by which: the nearest (the smaller number of equal ones), its squared distance, the second distance."""
        which = np.sort(which)
        away = np.stack([squared(points, self.centroids[c]) for c in which], axis=1)
        at = away.argmin(axis=1)
        second = np.partition(away, 1, axis=1)[:, 1] if len(which) > 1 else np.full(len(points), np.inf)
        return which[at], away[np.arange(len(points)), at], np.sqrt(second.astype(np.float64)) * (1 - MARGIN)

    def search(self, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings cluster, upper and lower (in place) to these centroids; returns how many distances that took."""
        looked = 0
        bound = np.maximum(lower, self.nearest[cluster] / 2 * (1 - MARGIN))
        open_ = np.flatnonzero(upper >= bound)
        if len(open_):
            looked += len(open_)
            upper[open_] = np.sqrt(squared(points[open_], self.centroids[cluster[open_]]).astype(np.float64)) * (1 + MARGIN)
            open_ = open_[upper[open_] >= bound[open_]]
        own = cluster[open_]
        for c in np.unique(own):
            mine = open_[own == c]
            radius = (2 * upper[mine] + self.nearest[c]) * (1 + MARGIN)
            reach = np.searchsorted(self.apart[c], radius, side="right")
            for n in np.unique(reach):
                some = mine[reach == n]
                cluster[some], away, lower[some] = self.scan(points[some], self.order[c, :n])
                upper[some] = np.sqrt(away.astype(np.float64)) * (1 + MARGIN)
                looked += len(some) * int(n)
        return looked


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigned(rows: DataFrame, id_type: str, now: Exponion, before: np.ndarray | None, last: bool) -> DataFrame:
    """The rows with their state after an assignment to these centroids; before: the centroids of the state so far."""
    moved = None if before is None else np.sqrt(squared(now.centroids, before).astype(np.float64)) * (1 + MARGIN)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = now.centroids.shape
        if moved is not None:
            # What any other centroid moved at most: the largest move, or for the cluster that made it the next one.
            most = np.full(k, moved.max())
            most[moved.argmax()] = np.partition(moved, -2)[-2] if k > 1 else 0.0
        for batch in batches:
            points = _matrix(batch.column("v"), dims)
            if moved is None:
                cluster, away, lower = now.scan(points, np.arange(k))
                upper = np.sqrt(away.astype(np.float64)) * (1 + MARGIN)
            else:
                cluster, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                upper = (upper + moved[cluster]) * (1 + MARGIN)
                lower = lower - most[cluster] - (np.where(np.isfinite(lower), lower, 0) + most[cluster]) * MARGIN
                now.search(points, cluster, upper, lower)
            columns = [batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
            if last:
                columns = [batch.column("id"), columns[2], pa.array(squared(points, now.centroids[cluster]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"] if last else ["id", "v", "cluster", "upper", "lower"])

    return rows.mapInArrow(step, f"id {id_type}, " + ("cluster int, distance long" if last else "v array<int>, cluster int, upper double, lower double"))


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every cluster's vectors; an empty cluster's centroid stays."""
    dims = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for row in sums.collect():  # a row per cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", key: str = "vec_id", vector: str = "embedding") -> Clusters:
    """k clusters after so many rounds of assigning and averaging, and one last assignment.

    Centroids start as the vectors with the smallest hexadecimal SHA-256 of salt and id, in that order. k is held in
    each task and by the driver: it is a parameter, not a number that grows with the rows.
    """
    rows = vectors.select(F.col(key).alias("id"), integers(F.col(vector), dims, scale).alias("v")).where("v IS NOT NULL")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    id_type = rows.schema["id"].dataType.simpleString()
    if not first:
        empty = vectors.sparkSession.createDataFrame([], f"id {id_type}, cluster int, distance long")
        return Clusters(empty.withColumnRenamed("id", key), np.empty((0, dims), np.int64))
    now, before, state = Exponion(np.array([r["v"] for r in first], np.int64)), None, rows
    for _ in range(rounds):
        written = stored(_assigned(state, id_type, now, before, last=False))
        if before is not None:
            forget(state)
        state, before = written, now.centroids
        now = Exponion(_means(state, before))
    found = stored(_assigned(state, id_type, now, before, last=True))
    if before is not None:
        forget(state)
    return Clusters(found.withColumnRenamed("id", key), now.centroids)

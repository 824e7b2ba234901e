"""Clusters of integer vectors around centroids, with the n-simplex projection as a filter before exact comparisons.

A few pivots span a simplex. The squared distances of a vector to them are worked out once and kept beside it; they fix
the vector's apex over that simplex: coordinates within the pivots' span, and an altitude over it. Of two apexes the
Euclidean distance is a lower bound of the vectors' distance, and with one altitude's sign turned an upper bound. A
centroid whose lower bound is over the least upper bound can't be the nearest one; the others are compared in whole
numbers. Bounds are floating-point numbers and so get some slack: they only ever leave out what is farther for sure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of a greater magnitude are refused: of two such vectors a squared distance might not fit a long.
MOST = 2**27


@dataclass(frozen=True)
class Clustering:
    """k: centroids; rounds: of moving them; pivots: at most so many span the simplex; dims: components that a vector
    must have; scale: what components are multiplied by before they are floored; seed: of the draw of first centroids."""

    k: int = 40
    rounds: int = 5
    pivots: int = 12
    dims: int = 64
    scale: int = 256
    seed: str = "2"


class Simplex:
    """The simplex of pivots: apexes of vectors from their squared distances to the pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        edges = pivots[1:] - pivots[0]
        self.gram = edges @ edges.T
        self.back = np.linalg.inv(np.linalg.cholesky(self.gram.astype(float))) if len(edges) else np.zeros((0, 0))

    @classmethod
    def among(cls, vectors: np.ndarray, most: int) -> Simplex:
        """Pivots from vectors: each the one that stands highest over those before, as long as it stands high enough for
        sums of doubles not to drown in it."""
        chosen = [0]
        rest = (vectors - vectors[0]).astype(float)
        first = None
        while len(chosen) < most:
            heights = (rest * rest).sum(axis=1)
            at = int(heights.argmax())
            first = first or heights[at]
            if not heights[at] > 1e-3 * first:
                break
            chosen.append(at)
            unit = rest[at] / np.sqrt(heights[at])
            rest = rest - np.outer(rest @ unit, unit)
        return cls(vectors[chosen])

    def squares(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the pivots."""
        return np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates within the pivots' span, and altitudes over it. The products of a vector with the simplex's edges
        are whole numbers, by the law of cosines."""
        inner = (squares[:, :1] + np.diag(self.gram) - squares[:, 1:]) // 2
        flat = inner @ self.back.T
        return flat, np.sqrt(np.maximum(squares[:, 0] - (flat * flat).sum(axis=1), 0.0))

    def bounds(self, squares: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower and upper bounds of the distances of vectors, given by their squares, to centroids."""
        own = self.squares(centroids)
        (x, a), (y, b) = self.apexes(squares), self.apexes(own)
        flat = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0.0)
        slack = 1e-8 * (squares[:, :1] + own[:, 0]) + 1e-6
        return flat + (a[:, None] - b) ** 2 - slack, flat + (a[:, None] + b) ** 2 + slack


def nearest(vectors: np.ndarray, squares: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each vector's nearest centroid (the smallest of equals), the squared distance, and how many exact
    comparisons that took."""
    low, high = simplex.bounds(squares, centroids)
    rows = np.arange(len(vectors))
    # One exact distance first: it is at most the least upper bound.
    guess = low.argmin(axis=1)
    best = ((vectors - centroids[guess]) ** 2).sum(axis=1)
    left = low <= np.minimum(high.min(axis=1), best)[:, None]
    left[rows, guess] = False
    exact = np.full(left.shape, np.iinfo(np.int64).max)
    exact[rows, guess] = best
    for c in np.flatnonzero(left.any(axis=0)):
        at = np.flatnonzero(left[:, c])
        exact[at, c] = ((vectors[at] - centroids[c]) ** 2).sum(axis=1)
    found = exact.argmin(axis=1)
    return found, exact[rows, found], len(vectors) + int(left.sum())


def whole_vectors(vectors: DataFrame, opts: Clustering) -> DataFrame:
    """(vec_id, x array<long>): vectors of dims components, none null or not finite, scaled and floored."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    value = lambda x: x.cast("double") * opts.scale
    whole = F.transform(e, lambda x: F.when(F.abs(value(x)) <= MOST, F.floor(value(x))).otherwise(F.raise_error(F.lit(f"components must be within {MOST} after scaling")).cast("long")))
    return vectors.where(F.coalesce((F.size(e) == opts.dims) & fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


@dataclass
class Fitted:
    """rows: (vec_id, x, squares), written; centroids: k rows of integers at most; simplex: what rows' squares refer to."""

    rows: DataFrame
    centroids: np.ndarray
    simplex: Simplex | None

    def assigned(self) -> DataFrame:
        """(vec_id, cluster int, distance long) of every row."""
        if self.simplex is None:
            return self.rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        centroids, simplex, d = self.centroids, self.simplex, self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found, far, _ = nearest(_matrix(b.column(1), d), _matrix(b.column(2), len(simplex.pivots)), centroids, simplex)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

        return common.arrow_map(self.rows.select("vec_id", "x", "squares"), run, "vec_id long, cluster int, distance long")

    def sums(self) -> DataFrame:
        """A row a task and centroid: the sums of the components of its vectors, and their number at the end. Vectors
        are added up where they lie, so that a cluster of any size is a row a task."""
        centroids, simplex, (k, d) = self.centroids, self.simplex, self.centroids.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, d + 1), dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), d)
                    found, _, _ = nearest(x, _matrix(b.column(1), len(simplex.pivots)), centroids, simplex)
                    np.add.at(total, found, np.hstack([x, np.ones((len(x), 1), dtype=np.int64)]))
            own = np.flatnonzero(total[:, d])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(list(total[own]), pa.list_(pa.int64()))], names=["cluster", "total"])

        return common.arrow_map(self.rows.select("x", "squares"), run, "cluster int, total array<long>")


def fit(vectors: DataFrame, opts: Clustering = Clustering()) -> Fitted:
    """Centroids after opts.rounds. The driver holds the centroids and their sums: k times dims numbers."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, opts)
    draw = F.sha2(F.concat(F.lit(f"{opts.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = whole.select(draw.alias("h"), "x").orderBy("h", "x").limit(opts.k).collect()
    if not first:
        return Fitted(whole, np.zeros((0, opts.dims), dtype=np.int64), None)
    centroids = np.array([x for _, x in first], dtype=np.int64)
    simplex = Simplex.among(centroids, opts.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                squares = simplex.squares(_matrix(b.column(1), opts.dims))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(squares), pa.list_(pa.int64()))], names=["vec_id", "x", "squares"])

    rows = common.written(common.arrow_map(whole, run, "vec_id long, x array<long>, squares array<long>"), "vectors")
    fitted = Fitted(rows, centroids, simplex)
    for _ in range(opts.rounds):
        spread = fitted.sums().select("cluster", F.posexplode("total").alias("i", "v"))
        total = np.zeros((len(centroids), opts.dims + 1), dtype=object)
        for c, i, v in spread.groupBy("cluster", "i").agg(F.sum("v")).collect():
            total[c, i] = v
        moved = fitted.centroids.copy()
        for c in range(len(moved)):
            if n := total[c, opts.dims]:
                moved[c] = [v // n for v in total[c, : opts.dims]]
        fitted = Fitted(rows, moved, simplex)
    return fitted


def cluster(vectors: DataFrame, opts: Clustering = Clustering()) -> DataFrame:
    """Per kept row of vectors: vec_id, cluster int, distance long (squared), cluster_inertia, inertia long (distances
    added up over the cluster and over all), centroid_sha256 string.

    Needs vec_id and embedding; other columns are not read. Kept are vectors with opts.dims components, none of them
    null or not finite; components beyond MOST after scaling end the run with an error that says so. First centroids are
    the k vectors with the smallest sha256 of `seed:vec_id` (a null vec_id counts as empty; equal hashes go by the
    vector); with fewer vectors there are fewer centroids. Rows that repeat a vec_id are rows of their own. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    fitted = fit(vectors, opts)
    found = common.written(fitted.assigned(), "assigned")
    common.dropped(fitted.rows)
    own = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in fitted.centroids.tolist()]
    about = [(c, n, sum(own.values()), digest[c]) for c, n in own.items()]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

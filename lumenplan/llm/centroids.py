"""Exact centroid clustering of integer vectors.

Squared distances come from |x|² - 2x·c + |c|², one matrix product of float64 a block.  Components of
vectors and centroids are bounded so that every sum stays below 2^53, where float64 counts exactly;
vectors or centroids beyond that bound are computed with Python's integers.  So every distance, tie
and mean is that of exact arithmetic, whatever the partitions.

The vectors are packed into blocks once; each round is one ``treeAggregate`` over them, of counts and
sums per centroid.  The driver sees those sums alone, whose size depends on the number of centroids.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Vectors of one packed block, and distances held at a time.
BLOCK, CELLS = 4096, 1 << 22
LARGEST_LONG = (1 << 63) - 1


def exact_bound(dims: int) -> int:
    """Largest component for which |x|² + 2|x||c| + |c|² stays below 2^53."""
    return isqrt(((1 << 53) - 1) // (4 * max(1, dims)))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) as an integer of any size."""
    return int(x) * scale if abs(x) >= 1 << 53 else floor(x * scale)


@dataclass
class Centroids:
    """Integer centroids, numbered from 0, and what the vectors assigned to them add up to."""

    points: list[list[int]]
    scale: int
    dims: int
    inertia: list[int] = field(default_factory=list)

    def __post_init__(self):
        bound = exact_bound(self.dims)
        self.small = [k for k, c in enumerate(self.points) if max(map(abs, c), default=0) <= bound]
        self.large = [k for k in range(len(self.points)) if k not in set(self.small)]
        self.matrix = np.array([self.points[k] for k in self.small], float).reshape(len(self.small), self.dims)
        self.squares = (self.matrix**2).sum(axis=1)

    def digests(self) -> list[str]:
        """Lowercase hex sha256 of each centroid's components, as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.points]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; of equal ones the smaller number.

        ``x`` is float64 within the bound, or integers as objects.
        """
        step = max(1, CELLS // max(1, len(self.points)))
        parts = [self._nearest(x[k : k + step]) for k in range(0, len(x), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.dtype != object:
            d = (x**2).sum(axis=1)[:, None] - 2 * (x @ self.matrix.T) + self.squares
            if self.large:
                every = np.empty((len(x), len(self.points)), object)
                every[:, self.small] = d.astype(np.int64).astype(object)
                self._fill(every, x.astype(np.int64).astype(object), self.large)
                d = every
        else:
            d = np.empty((len(x), len(self.points)), object)
            self._fill(d, x, range(len(self.points)))
        which = d.argmin(axis=1)
        least = d[np.arange(len(x)), which]
        return which, least if least.dtype == object else least.astype(np.int64)

    def _fill(self, d: np.ndarray, x: np.ndarray, numbers) -> None:
        for k in numbers:
            d[:, k] = ((x - np.array(self.points[k], object)) ** 2).sum(axis=1)


def _matrices(batch: pa.RecordBatch, dims: int, scale: int):
    """Parts of an Arrow batch: row numbers and integer vectors, float64 within the bound and objects beyond it."""
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dims)
    good = np.isfinite(x).all(axis=1)
    within = good & (np.abs(x).max(axis=1, initial=0) <= (exact_bound(dims) - 1) / scale)
    for start in range(0, batch.num_rows, BLOCK):
        rows = start + np.flatnonzero(within[start : start + BLOCK])
        if len(rows):
            yield rows, np.floor(scale * x[rows])
        rows = start + np.flatnonzero((good & ~within)[start : start + BLOCK])
        if len(rows):
            yield rows, np.array([[whole(v, scale) for v in row] for row in x[rows].tolist()], object).reshape(len(rows), dims)


def _of_size(vectors: DataFrame, dims: int, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows with ``dims`` components; components are looked at in the tasks."""
    return vectors.where(F.size(vector) == dims).select(F.col(key).alias("key"), F.col(vector).alias("vector"))


def _packed(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks of vectors: 32-bit integers within the bound, decimal texts beyond it."""

    def run(batches):
        for batch in batches:
            for _, x in _matrices(batch, dims, scale):
                exact = x.dtype != object
                data = x.astype(np.int32).tobytes() if exact else " ".join(str(v) for v in x.ravel()).encode()
                yield pa.RecordBatch.from_arrays([pa.array([exact]), pa.array([len(x)], pa.int32()), pa.array([data], pa.binary())], ["exact", "n", "data"])

    return rows.select("vector").mapInArrow(run, "exact boolean, n int, data binary")


def _unpacked(row, dims: int) -> np.ndarray:
    if row.exact:
        return np.frombuffer(row.data, np.int32).reshape(row.n, dims).astype(float)
    return np.array([int(v) for v in bytes(row.data).split()], object).reshape(row.n, dims)


def _totals(blocks: DataFrame, model: Centroids):
    """Per centroid: number of vectors, their sums and the sum of their distances; integers of any size."""
    held = blocks.sparkSession.sparkContext.broadcast(model)
    dims = model.dims

    def add(total, row):
        model, x = held.value, _unpacked(row, dims)
        which, distance = model.nearest(x)
        k = len(model.points)
        if total is None:
            total = np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object)
        if x.dtype != object:  # fewer than BLOCK vectors within the bound: the sums are exact in float64
            sums = ((which == np.arange(k)[:, None]).astype(float) @ x).astype(np.int64).astype(object)
        else:
            sums = np.zeros((k, dims), object)
            np.add.at(sums, which, x)
        inertia = np.zeros(k, object)
        np.add.at(inertia, which, distance.astype(object))
        return total[0] + np.bincount(which, minlength=k).astype(object), total[1] + sums, total[2] + inertia

    def merge(a, b):
        return a if b is None else b if a is None else tuple(x + y for x, y in zip(a, b))

    total = blocks.rdd.treeAggregate(None, add, merge)
    held.unpersist()
    return total


def first_points(rows: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The vectors whose keys have the smallest sha256 of ``1:<key>``, in that order; a null key has none."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    place = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    found = rows.where(finite & F.col("key").isNotNull()).select(place.alias("place"), "vector").orderBy("place", "vector").limit(k).collect()
    return [[whole(float(v), scale) for v in r.vector] for r in found]


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> Centroids:
    """Centroids of floor(scale * vector) after ``rounds`` rounds, with the inertia of the last assignment.

    A round assigns every vector to its nearest centroid and takes the floor of the mean of each
    centroid's vectors, componentwise; one without vectors stays.  Vectors of another length, or with
    null or non-finite components, are left out.  With fewer than ``k`` vectors there are as many
    centroids; vectors of one key are ordered by their components.
    """
    rows = _of_size(vectors, dims, key, vector)
    model = Centroids(first_points(rows, k, scale), scale, dims)
    if not model.points:
        return model
    blocks = scratch.save(_packed(rows, dims, scale), "vectors")
    for _ in range(rounds):
        counts, sums, _inertia = _totals(blocks, model)
        points = [[int(s // n) for s in row] if n else old for n, row, old in zip(counts, sums, model.points)]
        model = Centroids(points, scale, dims)
    model.inertia = [int(v) for v in _totals(blocks, model)[2]]
    scratch.drop(blocks)
    return model


def assign(vectors: DataFrame, model: Centroids, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: ``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Repeated rows give repeated rows, a null key stays.  A distance or inertia beyond a long is null
    (the choice of the cluster is exact all the same).  Without centroids there are no rows.
    """
    rows = _of_size(vectors, model.dims, key, vector)
    held = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key"].dataType
    fields = [T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())]

    def longs(values):
        return pa.array([v if v <= LARGEST_LONG else None for v in values], pa.int64())

    def run(batches):
        model = held.value
        if not model.points:
            return
        inertia, total, digests = longs(model.inertia), longs([sum(model.inertia)]), pa.array(model.digests())
        for batch in batches:
            for at, x in _matrices(batch, model.dims, model.scale):
                which, distance = model.nearest(x)
                clusters = pa.array(which.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(at)), clusters, longs(distance.tolist()), inertia.take(clusters), total.take(pa.array(np.zeros(len(at), np.int32))), digests.take(clusters)],
                    [f.name for f in fields],
                )

    return rows.mapInArrow(run, T.StructType(fields))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``fit`` and ``assign`` over the same vectors."""
    return assign(vectors, fit(vectors, k, rounds, dims, scale, key, vector), key, vector)

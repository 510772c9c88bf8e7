"""Whitening of vectors by the principal components of their integer values.

An entry c becomes x = floor(scale * c) + shift.  With the number n of rows and the sums S per dimension,
n*x - S is an exact integer; its quotient by n is the centred row.  MLlib's ``RowMatrix`` adds up the
products of the centred rows in the executors; the driver holds the matrix of the dimensions alone, whose
eigenvectors go to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components at most, and dimensions whose squared number the driver can hold.
COMPONENTS, MOST_DIMENSIONS = 8, 8192
LARGEST_LONG = (1 << 63) - 1
#: Scaled entries of this size or more are not taken for longs.
MOST = 2.0**62


@dataclass
class Whitening:
    """What the fit rows give: number, sums per dimension, eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float | None = None

    def usable(self) -> np.ndarray:
        """True for components whose variance is more than what rounding leaves of none."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps if self.trace > 0 else np.zeros(len(self.values), bool)


def _finite(vectors: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(key, dims, x) of the rows whose vector has no null or non-finite entry, nor one that is no long; x are longs."""
    good = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < MOST))
    # the condition is part of the value, as the optimizer may compute it before the rows are left out
    x = F.when(good, F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))) + F.lit(shift)))
    return vectors.where(good).select(F.col(key).alias("key"), F.size(vector).alias("dims"), x.alias("x"))


def _gramian(rows: DataFrame, centred: str, n: int, dims: int) -> np.ndarray:
    """Sums of the products of the centred rows, divided by their number."""
    ml = rows.select(array_to_vector(F.col(centred)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(ml, "v"), n, dims)
    return matrix.computeGramianMatrix().toArray() / n


def _centred(model: Whitening, largest: int) -> Column:
    """(n*x - S) / n with an exact numerator: longs where nothing exceeds 2^53, decimals of 38 digits elsewhere."""
    kind = "long" if 2 * model.n * largest < 1 << 53 else "decimal(38,0)"
    narrow = "long" if kind == "long" else "decimal(19,0)"
    sums = F.array(*[F.lit(str(s)).cast(kind) for s in model.sums])
    n = F.lit(str(model.n)).cast("long" if kind == "long" else "decimal(18,0)")
    return F.zip_with("x", sums, lambda x, s: (x.cast(narrow) * n - s).cast("double") / F.lit(float(model.n)))


def _whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation, whitened), an array of the components; those without variance are null."""
    fields = [rows.schema["key"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        model = held.value
        usable = model.usable()
        turn = model.vectors[:, usable] / np.sqrt(model.values[usable])
        sums = np.array(model.sums, object)
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            most = max(abs(int(x.min())), abs(int(x.max())), 1)
            d = x * model.n - sums.astype(np.int64) if 2 * model.n * most < 1 << 62 else x.astype(object) * model.n - sums
            spread = max(abs(int(d.min())), abs(int(d.max())), 1)
            if d.dtype != object and spread * spread * len(sums) > LARGEST_LONG:
                squares = (d.astype(object) ** 2).sum(axis=1)
            else:
                squares = (d**2).sum(axis=1)
            found = np.full((len(x), len(usable)), np.nan)
            found[:, usable] = (d / model.n).astype(float) @ turn
            yield pd.DataFrame({
                "key": frame["key"],
                "deviation": pd.array([int(s) if s <= LARGEST_LONG else None for s in squares], "Int64"),
                "whitened": [[None if np.isnan(v) else v for v in row] for row in found.tolist()],
            })

    return rows.mapInPandas(run, T.StructType(fields))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = 1024, shift: int = 100_000) -> Whitening:
    """Components of largest variance of the usable vectors, numbered by falling eigenvalue.

    Usable are the vectors without null or non-finite entries (or entries beyond 2^62 / ``scale``, which are
    no longs) whose length is that of most of them, of equally frequent lengths the longest.  ``identity_error`` is measured on the whitened rows: the largest
    entry of their covariance (divisor n, centred) less the identity, over components that have variance.
    """
    return _fit(*_usable(vectors, key, vector, scale, shift), components)


def _fit(rows: DataFrame, dims: int, components: int) -> Whitening:
    if not dims:
        return Whitening(0, [])
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions are too many for one covariance matrix")
    totals = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs(F.col("col").cast("decimal(19,0)"))).alias("most"))
    totals = sorted(totals.collect())  # one row per dimension
    model = Whitening(totals[0].n, [int(t.s) for t in totals])
    covariance = _gramian(rows.select(_centred(model, max(int(t.most) for t in totals)).alias("centred")), "centred", model.n, dims)
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    model.values, model.vectors, model.trace = values[order], columns[:, order], float(np.trace(covariance))
    model.identity_error = _identity_error(_whitened(rows, model), model)
    return model


def _usable(vectors: DataFrame, key: str, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """The rows of ``_finite`` that have the most frequent length, and that length (0 without rows)."""
    rows = _finite(vectors, key, vector, scale, shift)
    most = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most.dims if most else 0
    return rows.where(F.col("dims") == dims).drop("dims"), dims


def _identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    usable = np.flatnonzero(model.usable())
    if not len(usable):
        return None
    values = whitened.select(F.array(*[F.col("whitened")[int(k)] for k in usable]).alias("w"))
    means = values.select(*[F.avg(F.col("w")[k]).alias(f"m{k}") for k in range(len(usable))]).first()
    centred = values.select(F.zip_with("w", F.array(*[F.lit(m) for m in means]), lambda w, m: w - m).alias("centred"))
    return float(np.abs(_gramian(centred, "centred", model.n, len(usable)) - np.eye(len(usable))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Repeated rows give repeated rows and a null key stays.  Vectors that are null, empty, of another length
    than most, or that hold null or non-finite entries give no rows; an empty table gives none.  With fewer
    dimensions there are fewer components.  ``whitened`` is null for a component without variance,
    ``explained`` if no component has any, ``deviation`` beyond a long.
    """
    rows, dims = _usable(vectors, key, vector, scale, shift)
    model = _fit(rows, dims, components)
    explained = F.array(*[F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values])
    each = _whitened(rows, model).select("key", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )

"""Ordering with tolerances, first rows, and the most per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """The first ``k`` rows per key, numbered from 1.

    Spark keeps the first ``k`` of every key in each task before it shuffles, so a key with most of the
    rows sends a few to one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def by_date(df: DataFrame, date: str = "instant", key: str = "id") -> DataFrame:
    return df.orderBy(date, key)


def by_distance(df: DataFrame, distance: str, tolerance: float, date: str, key: str, limit: int | None = None) -> DataFrame:
    """In order of distance in steps of ``tolerance``, then date, then key."""
    rows = df.orderBy(F.floor(F.col(distance) / tolerance + 0.5), date, key)
    return rows if limit is None else rows.limit(limit)


def earliest(df: DataFrame, date: str, key: str, limit: int) -> DataFrame:
    """The first results in time."""
    return df.orderBy(date, key).limit(limit)


def earliest_by_windows(df: DataFrame, date: str, key: str, limit: int, width_seconds: int, find: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The first ``limit`` results in time of ``find`` over ``df``, window by window, until there are enough.

    Each window is twice as long as the one before, so there are few; ``find`` never sees rows of later
    windows, and no window sorts more than its own results.  Rows without a date are left out.
    """
    ends = df.agg(F.min(F.unix_micros(date)).alias("a"), F.max(F.unix_micros(date)).alias("b")).first()
    if ends["a"] is None:
        return find(df).orderBy(date, key).limit(0)
    parts, low, width = [], ends["a"], width_seconds * 1_000_000
    while limit > 0 and low <= ends["b"]:
        inside = df.where((F.col(date) >= F.timestamp_micros(F.lit(low))) & (F.col(date) < F.timestamp_micros(F.lit(low + width))))
        parts.append(cut(find(inside).orderBy(date, key).limit(limit)))
        limit -= parts[-1].count()
        low, width = low + width, width * 2
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.orderBy(date, key)


def newest_within(df: DataFrame, keys: list[str], time: str, days: int, now: Column, cap: int) -> DataFrame:
    """Per key the ``cap`` newest rows that are at most ``days`` old; of equally new ones those of the smaller ``id``, if there is one."""
    order = [F.desc(time), *([F.col("id")] if "id" in df.columns else [])]
    return top_per_key(df.where(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS")), keys, order, cap, "_place").drop("_place")


def best_within(df: DataFrame, keys: list[str], error: str, distance: str, tie: float = 1e-6) -> DataFrame:
    """The row with the least error per key; errors equal to within ``tie`` give the nearer one, then the smaller bearing if there is one."""
    last = [F.col("bearing")] if "bearing" in df.columns else []
    return first_per_key(df, keys, [F.floor(F.abs(F.col(error)) / tie + 0.5), F.col(distance), *last])

"""Analytics over ordered rows: crossings, islands, bands, running values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import first_per_key


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    for c in columns:
        df = df.withColumn(f"previous_{c}", F.lag(c).over(w))
    return df


def sign_changes(df: DataFrame, keys: list[str], order: str, value: str, most: float = 180.0) -> DataFrame:
    """Rows where ``value`` has changed its sign since the row before, less than ``most`` apart.

    A zero belongs to the interval that ends with it.
    """
    rows = previous(df, keys, order, [value, order])
    a, b = F.col(f"previous_{value}"), F.col(value)
    return rows.where((((a < 0) & (b >= 0)) | ((a > 0) & (b <= 0))) & (F.abs(b - a) < most))


def islands(df: DataFrame, keys: list[str], order: str, inside: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows that fulfil ``inside``: first, last, number of rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = marked.withColumn("_start", F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0))
    numbered = starts.withColumn("island", F.sum("_start").over(w)).where("_in")
    return numbered.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)


def with_island(df: DataFrame, keys: list[str], order: str, inside: Column) -> DataFrame:
    """The rows inside, numbered by their run."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = marked.withColumn("_start", F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0))
    return starts.withColumn("island", F.sum("_start").over(w)).where("_in").drop("_in", "_start")


def rise_and_set(df: DataFrame, keys: list[str], order: str, altitude: str, horizon: float = 0.0) -> DataFrame:
    """Per key the first row at or above the horizon after one below, and the first below after one at or above."""
    rows = previous(df, keys, order, [altitude])
    a, b = F.col(f"previous_{altitude}"), F.col(altitude)
    return rows.groupBy(*keys).agg(
        F.min(F.when((a < horizon) & (b >= horizon), F.col(order))).alias("rise"), F.min(F.when((a >= horizon) & (b < horizon), F.col(order))).alias("set")
    )


def longest_window(df: DataFrame, keys: list[str], order: str, inside: Column) -> DataFrame:
    """The longest run per key, from its first row to the first failing one (the last row if none fails); of equal ones the earliest."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_next", F.coalesce(F.lead(order).over(w), F.col(order)))
    runs = with_island(rows, keys, order, inside).groupBy(*keys, "island").agg(F.min(order).alias("begin"), F.max("_next").alias("end"))
    length = F.unix_micros("end") - F.unix_micros("begin")
    return first_per_key(runs.withColumn("micros", length), keys, [F.desc("micros"), F.col("begin")]).drop("island")


def first_bracket(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per key the first pair of neighbours going outward whose finite values have different signs or a zero."""
    rows = previous(df, keys, order, [value, order])
    a, b = F.col(f"previous_{value}"), F.col(value)
    found = rows.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (a * b <= 0))
    return first_per_key(found, keys, [F.col(order)])


def minimal_band(df: DataFrame, keys: list[str], azimuth: str, padding: float = 3.0) -> DataFrame:
    """The smallest arc per key that holds all azimuths, padded: the complement of the largest gap, the first of equal ones.

    Gaps that differ by less than a millionth of a degree are equal, as the differences of decimal azimuths are not exact.
    """
    rows = df.withColumn("_a", F.pmod(F.col(azimuth), F.lit(360.0)))
    w = Window.partitionBy(*keys).orderBy("_a", F.monotonically_increasing_id())
    every = Window.partitionBy(*keys)
    low = F.min("_a").over(every)
    following = F.coalesce(F.lead("_a").over(w), low + 360)
    gaps = rows.withColumn("_next", following).withColumn("_gap", F.round(following - F.col("_a"), 6))
    best = first_per_key(gaps, keys, [F.desc("_gap"), F.col("_a")])
    return best.select(*keys, (F.pmod(F.col("_next"), F.lit(360.0)) - padding).alias("band_start"), (F.col("_a") + padding).alias("band_end"))


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str = "progress") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(value).over(w))


def rate_average(df: DataFrame, keys: list[str], time: str, percent: str, weight: float = 0.25, least_seconds: float = 0.75) -> DataFrame:
    """Per key the smoothed milliseconds a per cent and the seconds left, from updates folded in order of time.

    An update counts if the percentage has grown and ``least_seconds`` have passed since the last that
    counted; the first one only sets the start.  Updates without a percentage or an instant are left out.
    The rows are dealt by key and sorted, and an Arrow iterator carries one state on from batch to batch, so
    a key's history may have any length.
    """
    p = F.least(F.greatest(F.floor(F.col(percent) + 0.5), F.lit(0)), F.lit(100)).cast("double")
    rows = df.where(F.col(percent).isNotNull() & F.col(time).isNotNull()).select(*keys, F.unix_micros(time).alias("_t"), p.alias("_p"))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_t", "_p")
    least = least_seconds * 1e6

    def fold(state: tuple, t: np.ndarray, p: np.ndarray) -> tuple:
        start, counted, now, rate = state
        grown = np.maximum.accumulate(np.maximum(p, now))
        at = 0
        if start is None:
            start, at = int(t[0]), 1
        while True:
            # the next update that counts: percentages grow, so there are a hundred of a key at most
            at = max(at, int(np.searchsorted(grown, counted, "right")), int(np.searchsorted(t, start + least, "left")))
            if at >= len(t) or grown[at] >= 100:
                return start, counted, float(grown[-1]), rate
            measured = (int(t[at]) - start) / 1000.0 / (grown[at] - counted)
            rate = measured if rate is None else rate * (1 - weight) + measured * weight
            start, counted, at = int(t[at]), float(grown[at]), at + 1

    def run(batches):
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(keys)
            first = held is None or bool(_changes(pa.Table.from_batches([held, own.slice(0, 1)]).combine_chunks().to_batches()[0])[0])
            if held is not None and first:
                yield _folded(held, [state])
            if first:
                state = (None, 0.0, 0.0, None)
            t, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_p"))
            ends = np.append(np.flatnonzero(_changes(own)) + 1, batch.num_rows)
            done, begin = [], 0
            for end in ends:
                if begin:
                    done.append(state)
                    state = (None, 0.0, 0.0, None)
                state, begin = fold(state, t[begin:end], p[begin:end]), end
            if done:
                yield _folded(own.take(pa.array(ends[:-1] - 1)), done)
            held = own.slice(batch.num_rows - 1, 1)
        if held is not None:
            yield _folded(held, [state])

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("percent", T.DoubleType()), T.StructField("ms_per_percent", T.DoubleType())])
    done = ordered.mapInArrow(run, schema)
    left = F.least(F.lit(86400.0), F.greatest(F.lit(1.0), F.floor(F.col("ms_per_percent") * (100 - F.col("percent")) / 1000 + 0.5)))
    return done.withColumn("seconds_left", F.when((F.col("percent") > 0) & (F.col("percent") < 100), left))


def _changes(keys: pa.RecordBatch) -> np.ndarray:
    """True at each row but the last whose keys differ from those of the row after it; nulls are equal."""
    n = keys.num_rows
    out = np.zeros(max(n - 1, 0), bool)
    for c in keys.columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        differ = pc.coalesce(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def _folded(keys: pa.RecordBatch, states: list[tuple]) -> pa.RecordBatch:
    values = [pa.array([s[k] for s in states], pa.float64()) for k in (2, 3)]
    return pa.RecordBatch.from_arrays([*keys.columns, *values], [*keys.schema.names, "percent", "ms_per_percent"])


def closest_in_island(df: DataFrame, keys: list[str], order: str, inside: Column, distance: str) -> DataFrame:
    """Per run its first and last row and the one with the least distance, the earliest of equal ones."""
    rows = with_island(df, keys, order, inside)
    return rows.groupBy(*keys, "island").agg(
        F.min(order).alias("enter"), F.max(order).alias("leave"), F.count("*").alias("n"),
        F.min(F.struct(F.col(distance).alias("d"), F.col(order).alias("t"))).alias("_c"),
    ).select(*keys, "island", "enter", "leave", "n", F.col("_c.t").alias("closest"), F.col("_c.d").alias("least_distance"))

"""Dates on which a body passes over a subject seen from a tripod."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import optics, sky
from ..functions.angles import let
from ..operators.roots import bisect_edges
from ..operators.sampling import CROSSING_STEP
from ..operators.windows import closest_in_island
from ..sources.ephemeris import days_of
from . import passes

BISECTIONS, TERNARY = 20, 32


def bisect(low: Column, high: Column, value: Callable[[Column], Column], steps: int = BISECTIONS) -> Column:
    """The end (microseconds) of the last half interval in which ``value`` changes its sign, to one second."""

    def halve(s: Column, m: Column) -> Column:
        def keep(v: Column) -> Column:
            same = F.signum(v) == F.signum(s["fa"])
            go = s["b"] - s["a"] > F.lit(1_000_000)
            return F.struct(
                F.when(go & same, m).otherwise(s["a"]).alias("a"), F.when(go & ~same, m).otherwise(s["b"]).alias("b"), F.when(go & same, v).otherwise(s["fa"]).alias("fa")
            )

        return let(value(m), keep)

    step = lambda s, _: let(F.floor((s["a"] + s["b"]) / 2).cast("long"), lambda m: halve(s, m))
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), value(low).alias("fa"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["b"])


def direction_crossings(searches: DataFrame, zone: str, weekdays: list[int], first: Column, last: Column, mode: str = "standard") -> DataFrame:
    """Instants at which the Sun stands exactly over the subject's bearing.

    ``searches`` has id, start, end, lat, lon, bearing, subject_elevation.  Sampled every ten minutes,
    refined to a second; kept where the Sun is above 0.25 degrees and above the subject.  All samples of a
    window are computed in its row, so nothing is shuffled.
    """
    rows = passes.eligible_windows(passes.prepared(searches, CROSSING_STEP), zone, weekdays, first, last)

    def find(pdf, t):
        place = [pdf[c].to_numpy(float) for c in ("lat", "lon", "bearing")]

        def error(micros, at=None):
            lat, lon, bearing = (p[:, None] if at is None else p[at] for p in place)
            return passes.signed(sky.sun_series(days_of(micros), lat, lon)[0], bearing)

        r, k = passes.sign_changes(error(t))
        _, instant = bisect_edges(t[r, k], t[r, k + 1], lambda m: np.sign(error(m, r)), BISECTIONS)
        return r, {"instant": pd.to_datetime(instant, unit="us", utc=True)}

    exact = passes.scan(rows, searches.columns, "instant timestamp", find)
    placed = sky.add_sun(exact)
    out = placed.select("id", "instant", "azimuth", sky.apparent_altitude(F.col("altitude"), mode).alias("altitude"), "subject_elevation")
    return out.where((F.col("altitude") > 0.25) & (F.col("altitude") >= F.col("subject_elevation")))


def in_frame(searches: DataFrame, positions: DataFrame, h_fov: str, v_fov: str) -> DataFrame:
    """Intervals in which a body is in the frame, with the instant closest to the middle.

    ``positions`` has id, instant, azimuth, altitude and the disc's diameter (null for a point);
    ``searches`` has id, bearing, subject_elevation and the fields of view.
    """
    rows = positions.join(searches.select("id", "bearing", "subject_elevation", h_fov, v_fov), "id")
    cam = optics.camera(F.col("bearing"), F.col("subject_elevation"))
    seen = optics.direction(F.col("azimuth"), F.col("altitude"))
    rows = rows.withColumn("_p", optics.project(seen, cam, F.col(h_fov), F.col(v_fov))).withColumn("away", optics.angular_distance(seen, cam["forward"]))
    disc = optics.disc_in_frame(F.col("_p"), F.col("altitude"), F.col("diameter"), F.col(h_fov), F.col(v_fov))
    inside = (F.col("altitude") > 0.25) & (F.col("altitude") >= F.col("subject_elevation")) & F.when(F.col("diameter").isNull(), F.col("_p.inside")).otherwise(disc)
    return closest_in_island(rows, ["id"], "instant", inside, "away")


def refine_roots(df: DataFrame, low: str, high: str, value: Callable[[pd.DataFrame, np.ndarray], np.ndarray], steps: int = 24, out: str = "instant") -> DataFrame:
    """Bisection of many rows at once by an Arrow function, to one second.

    ``low`` and ``high`` are microseconds; ``value`` takes rows and microseconds.  For values that are
    long as columns, or have no column form (the Moon).
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.TimestampType())])

    def run(batches):
        for pdf in batches:
            a, b = pdf[low].to_numpy(np.int64), pdf[high].to_numpy(np.int64)
            _, b = bisect_edges(a, b, lambda t: np.sign(value(pdf, t)), steps)  # noqa: B023
            yield pdf.assign(**{out: pd.to_datetime(b, unit="us", utc=True)})

    return df.mapInPandas(run, schema)


def ternary(low: Column, high: Column, value: Callable[[Column], Column], steps: int = TERNARY) -> Column:
    """The instant (microseconds) of the least value; of equal thirds the upper end moves."""

    def step(s: Column, _: Column) -> Column:
        def thirds(t: Column) -> Column:
            x, y = s["a"] + t, s["b"] - t
            choose = lambda left: F.struct(F.when(left, s["a"]).otherwise(x).alias("a"), F.when(left, y).otherwise(s["b"]).alias("b"))
            return let(value(x) <= value(y), choose)

        return let(F.floor((s["b"] - s["a"]) / 3).cast("long"), thirds)

    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.floor((s["a"] + s["b"]) / 2).cast("long"))

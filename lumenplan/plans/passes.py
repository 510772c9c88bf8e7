"""When bodies pass over a subject, stand in the frame, rise and set: searches over ephemeris segments.

A search is spread over the windows of its period whose local weekday and time of day are asked for, cut at
UTC days.  Each window meets the segments of its day, and an Arrow function evaluates all its samples, finds
the steps in which something changes and refines them.  So a window is one row, nothing is shuffled but the
few results, and a result that runs on over the cut of two windows is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import optics
from ..functions.angles import col
from ..functions.zoned import in_time_range, local_date, minute_of_day, on_weekdays, to_instant, weekday
from ..operators.roots import bisect_edges, least_between
from ..operators.sampling import CROSSING_STEP, MINUTE, frame_step
from ..sources.ephemeris import BODIES, RADIUS, SLOT, Track, segments, slot_of

LEAST_ALTITUDE, SCAN = 0.25, 2 * MINUTE
BISECTIONS = {"crossing": 20, "frame": 24, "horizon": 18}
#: Samples that an Arrow function holds at a time.
SAMPLES = 1 << 20


def eligible_windows(searches: DataFrame, zone: str, weekdays: list[int], first: Column, last: Column) -> DataFrame:
    """The searches (start, end excluded) by window: ``low`` and ``high`` in microseconds and the UTC day ``slot``.

    ``first`` and ``last`` are minutes of the day, both included; a first after the last runs over midnight.
    Windows that touch are one stretch of time.
    """
    first, last = col(first), col(last) + 1
    parts = F.when(first < last, F.array(F.struct(first.alias("a"), last.alias("b")))).otherwise(
        F.array(F.struct(F.lit(0).alias("a"), last.alias("b")), F.struct(first.alias("a"), F.lit(1440).alias("b")))
    )
    days = searches.withColumn("_day", F.explode(F.sequence(local_date("start", zone), local_date("end", zone))))
    days = days.where(on_weekdays(F.dayofweek("_day") - 1, weekdays)).withColumn("_part", F.explode(parts))
    at = lambda minute: F.unix_micros(to_instant(F.timestamp_micros(F.unix_micros(F.col("_day").cast("timestamp")) + minute.cast("long") * MINUTE), zone))
    low, high = F.greatest(at(F.col("_part.a")), F.unix_micros("start")), F.least(at(F.col("_part.b")), F.unix_micros("end"))
    whole = days.withColumn("_a", low).withColumn("_b", high).where(F.col("_a") < F.col("_b"))
    cut = whole.withColumn("slot", F.explode(F.sequence(slot_of(F.col("_a")), slot_of(F.col("_b") - 1))))
    return cut.select(*searches.columns, "slot", F.greatest(F.col("_a"), F.col("slot") * SLOT).alias("low"), F.least(F.col("_b"), (F.col("slot") + 1) * SLOT).alias("high"))


def with_segments(rows: DataFrame, bodies: Iterable[str]) -> DataFrame:
    """Rows with a ``slot`` by body, with the body's segment of that day."""
    return rows.join(F.broadcast(segments(rows, bodies)), "slot")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows and the instants to look at: both ends of the window, and the steps of the search between them."""
    for pdf in batches:
        if not len(pdf):
            continue
        low, high, start, step = (pdf[c].to_numpy(np.int64) for c in ("low", "high", "from", "step"))
        k = (low - start) // step + 1
        count = np.maximum(0, -((start + k * step - high) // step))
        size = max(1, SAMPLES // (int(count.max()) + 2))
        for at in range(0, len(pdf), size):
            part = slice(at, at + size)
            inner = start[part, None] + (k[part, None] + np.arange(count[part].max())) * step[part, None]
            yield pdf.iloc[part].reset_index(drop=True), np.concatenate([low[part, None], np.minimum(inner, high[part, None]), high[part, None]], axis=1)


def prepared(searches: DataFrame, step: Column | int) -> DataFrame:
    """Searches with the observer's height, and the start and the step of their samples in microseconds."""
    rows = searches if "height" in searches.columns else searches.withColumn("height", F.lit(0.0))
    return rows.withColumn("from", F.unix_micros("start")).withColumn("step", col(step).cast("long"))


def scan(rows: DataFrame, keep: list[str], schema: str, find: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]) -> DataFrame:
    """``find`` gives row numbers and columns for each chunk of windows; ``keep`` are the windows' columns that stay."""

    def run(batches):
        for pdf, t in _chunks(batches):
            rows, found = find(pdf, t)
            yield pdf.loc[rows, keep].reset_index(drop=True).assign(**found)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInPandas(run, f"{kept}, {schema}")


def signed(value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``value`` - ``target`` in [-180, 180)."""
    return np.mod(value - target + 540, 360) - 180


def sign_changes(error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and step in which an angle changes its sign; a zero belongs to the step that ends with it."""
    a, b = error[:, :-1], error[:, 1:]
    return np.nonzero((((a < 0) & (b >= 0)) | ((a > 0) & (b <= 0))) & (np.abs(b - a) < 180))


def _disc(body: Column, km: Column) -> Column:
    """Diameter of a body's disc in degrees, 0 for a star."""
    return F.coalesce(*[F.when(body == b, optics.angular_diameter(F.lit(r), km)) for b, r in RADIUS.items()], F.lit(0.0))


def seen_in_frame(rows: DataFrame) -> DataFrame:
    """Rows (body, azimuth, altitude, km, bearing, subject_elevation, h_fov, v_fov) in the frame, with ``distance`` from its middle."""
    cam = optics.camera(F.col("bearing"), F.col("subject_elevation"))
    seen = optics.direction(F.col("azimuth"), F.col("altitude"))
    placed = rows.withColumn("_p", optics.project(seen, cam, F.col("h_fov"), F.col("v_fov"))).withColumn("distance", optics.angular_distance(seen, cam["forward"]))
    inside = optics.disc_in_frame(F.col("_p"), F.col("altitude"), _disc(F.col("body"), F.col("km")), F.col("h_fov"), F.col("v_fov"))
    return placed.where((F.col("altitude") > LEAST_ALTITUDE) & inside).drop("_p")


def crossings(searches: DataFrame, bodies: Iterable[str], zone: str, weekdays: list[int], first: Column, last: Column, mode: str = "standard", below_subject: bool = False, in_frame: bool = True) -> DataFrame:
    """Instants at which a body stands exactly over the subject's bearing, to a second.

    ``searches`` has id, start, end, lat, lon, bearing, subject_elevation and, for ``in_frame``, the fields of
    view h_fov and v_fov.  A body must be above 0.25 degrees, not below the subject, and in the frame.
    """
    rows = with_segments(eligible_windows(prepared(searches, CROSSING_STEP), zone, weekdays, first, last), bodies)

    def find(pdf, t):
        track, bearing = Track(pdf, mode), pdf["bearing"].to_numpy(float)
        r, k = sign_changes(signed(track.at(t)[0], bearing[:, None]))
        near, target = track.take(r), bearing[r]
        _, at = bisect_edges(t[r, k], t[r, k + 1], lambda m: np.sign(signed(near.at(m)[0], target)), BISECTIONS["crossing"])
        azimuth, altitude, km = near.at(at)
        return r, {"instant": pd.to_datetime(at, unit="us", utc=True), "azimuth": azimuth, "altitude": altitude, "km": km}

    found = scan(rows, [*searches.columns, "body"], "instant timestamp, azimuth double, altitude double, km double", find)
    found = found.where(F.col("altitude") > LEAST_ALTITUDE)
    if not below_subject:
        found = found.where(F.col("altitude") >= F.col("subject_elevation"))
    return seen_in_frame(found) if in_frame else found


def frame_intervals(searches: DataFrame, bodies: Iterable[str], zone: str, weekdays: list[int], first: Column, last: Column, mode: str = "standard", below_subject: bool = False) -> DataFrame:
    """Intervals in which a body is in the frame: enter, leave, the closest instant, and its place then.

    ``searches`` has id, start, end, lat, lon, bearing, subject_elevation, h_fov, v_fov.  Samples are so dense
    that a body meets four in the shorter side; edges are refined to a second outside the frame, the instant
    closest to the middle by ternary search, and that instant must be in the frame and eligible itself.
    """
    bodies = list(bodies)
    windows = eligible_windows(prepared(searches, frame_step("h_fov", "v_fov")), zone, weekdays, first, last)

    def look(pdf, track):
        frame = [pdf[c].to_numpy(float) for c in ("bearing", "subject_elevation", "h_fov", "v_fov")]

        def at(t, rows=slice(None)):
            azimuth, altitude, km = (track if isinstance(rows, slice) else track.take(rows)).at(t)
            wide = (lambda v: v[rows][:, None]) if t.ndim == 2 else (lambda v: v[rows])
            diameter = 2 * np.degrees(np.arcsin(wide(track.radius) / np.maximum(wide(track.radius), km)))
            seen, distance = optics.frame_series(azimuth, altitude, diameter, *(wide(v) for v in frame))
            lowest = np.full(len(pdf), -90.0) if below_subject else frame[1]
            return seen & (altitude > LEAST_ALTITUDE) & (altitude >= wide(lowest)), distance

        return at

    def runs(pdf, t):
        at = look(pdf, Track(pdf, mode))
        inside, distance = at(t)
        edge = np.diff(np.pad(inside.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, i = np.nonzero(edge == 1)
        j = np.nonzero(edge == -1)[1] - 1  # the ends come in the same order
        enter, leave = t[r, i], t[r, j]
        opens, closes = np.flatnonzero(i > 0), np.flatnonzero(j < t.shape[1] - 1)
        enter[opens], _ = bisect_edges(t[r[opens], i[opens] - 1], t[r[opens], i[opens]], lambda m: at(m, r[opens])[0], BISECTIONS["frame"])
        _, leave[closes] = bisect_edges(t[r[closes], j[closes]], t[r[closes], j[closes] + 1], lambda m: at(m, r[closes])[0], BISECTIONS["frame"])
        best = np.array([a + int(np.argmin(distance[n, a : b + 1])) for n, a, b in zip(r, i, j)], int)
        return r, {"enter": enter, "leave": leave, "best": t[r, best] if len(r) else enter, "least": distance[r, best] if len(r) else np.zeros(0)}

    keys = ["id", "body"]
    pieces = scan(with_segments(windows, bodies), [*searches.columns, "body", "step", "height"] if "height" not in searches.columns else [*searches.columns, "body", "step"], "enter long, leave long, best long, least double", runs)
    own = [c for c in pieces.columns if c not in ("enter", "leave", "best", "least", *keys)]
    w = Window.partitionBy(*keys).orderBy("enter")  # the intervals of one search and body
    joined = pieces.withColumn("_new", F.when(F.lag("leave").over(w) == F.col("enter"), 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w))
    whole = joined.groupBy(*keys, "_n").agg(F.min("enter").alias("enter"), F.max("leave").alias("leave"), F.min(F.struct("least", "best")).alias("_c"), *[F.first(c).alias(c) for c in own])
    near = whole.select(*keys, *own, "enter", "leave", F.col("_c.best").alias("best"), slot_of(F.col("_c.best")).alias("slot"))
    near = near.withColumn("low", F.greatest("enter", F.col("best") - F.col("step"))).withColumn("high", F.least("leave", F.col("best") + F.col("step")))
    placed = near.join(F.broadcast(segments(windows, bodies)), ["slot", "body"])

    def closest(batches):
        for pdf in batches:
            track = Track(pdf, mode)
            at = look(pdf, track)
            t = least_between(pdf["low"].to_numpy(np.int64), pdf["high"].to_numpy(np.int64), lambda m: at(m)[1])
            azimuth, altitude, km = track.at(t)
            yield pdf.drop(columns=["cx", "cy", "cz", "slot", "low", "high", "best", "step"]).assign(closest=pd.to_datetime(t, unit="us", utc=True), azimuth=azimuth, altitude=altitude, km=km)

    fields = [f for f in placed.schema.fields if f.name not in ("cx", "cy", "cz", "slot", "low", "high", "best", "step")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    found = placed.mapInPandas(closest, f"{schema}, closest timestamp, azimuth double, altitude double, km double")
    eligible = on_weekdays(weekday(F.col("closest"), zone), weekdays) & in_time_range(minute_of_day(F.col("closest"), zone), col(first), col(last))
    found = found.where(eligible & (F.col("closest") >= F.col("start")) & (F.col("closest") < F.col("end")))
    return seen_in_frame(found).withColumn("enter", F.timestamp_micros("enter")).withColumn("leave", F.timestamp_micros("leave"))


def rises_and_sets(days: DataFrame, bodies: Iterable[str] = BODIES, mode: str = "standard", refined: bool = True) -> DataFrame:
    """First rise and first set of every body in each period (id, start, end, lat, lon); null if none.

    To less than a second, or, not ``refined``, the first sample of the scan of two minutes after it.
    """
    bodies = list(bodies)
    whole = prepared(days, SCAN).withColumn("_a", F.unix_micros("start")).withColumn("_b", F.unix_micros("end")).where("_a < _b")
    cut = whole.withColumn("slot", F.explode(F.sequence(slot_of(F.col("_a")), slot_of(F.col("_b") - 1))))
    cut = cut.withColumn("low", F.greatest(F.col("_a"), F.col("slot") * SLOT)).withColumn("high", F.least(F.col("_b"), (F.col("slot") + 1) * SLOT))

    def find(pdf, t):
        track = Track(pdf, mode)
        above = track.at(t)[1] >= 0
        r, k = np.nonzero(above[:, :-1] != above[:, 1:])
        near = track.take(r)
        low, high = t[r, k], t[r, k + 1]
        for _ in range(BISECTIONS["horizon"] if refined else 0):  # to a fraction of a second, as the step is short
            middle = (low + high) // 2
            after = (near.at(middle)[1] >= 0) == above[r, k + 1]
            low, high = np.where(after, low, middle), np.where(after, middle, high)
        return r, {"rises": above[r, k + 1], "at": high}

    found = scan(with_segments(cut, bodies), ["id", "start", "body"], "rises boolean, at long", find)
    first = found.groupBy("id", "start", "body").agg(F.min(F.when(F.col("rises"), F.col("at"))).alias("rise"), F.min(F.when(~F.col("rises"), F.col("at"))).alias("set"))
    every = days.select("id", "start").withColumn("body", F.explode(F.array(*[F.lit(b) for b in bodies])))
    return every.join(first, ["id", "start", "body"], "left").select("id", "start", "body", F.timestamp_micros("rise").alias("rise"), F.timestamp_micros("set").alias("set"))


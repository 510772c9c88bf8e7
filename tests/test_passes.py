"""Passes of bodies by ephemeris segments, and what is folded in order of time."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenplan.functions import optics, sky
from lumenplan.operators import roots, windows
from lumenplan.plans import passes
from lumenplan.sources import ephemeris

SEARCH = "id int, start string, end string, lat double, lon double, bearing double, subject_elevation double"


def searches(spark, *rows, focal=9.0):
    fov = optics.fields_of_view(F.lit(focal), F.lit(1.5))
    df = spark.createDataFrame(rows, SEARCH).withColumn("h_fov", fov["h"]).withColumn("v_fov", fov["v"])
    return df.withColumns({c: F.to_timestamp(c) for c in ("start", "end")})


@pytest.mark.parametrize("body", ephemeris.BODIES)
def test_segments_follow_the_series(spark, body):
    rng = np.random.default_rng(2)
    slots = np.unique(rng.integers(ephemeris.FIRST_SLOT, ephemeris.LAST_SLOT, 60))
    rows = ephemeris.segments(spark.createDataFrame([(int(s),) for s in [*slots, slots[0], 90_000]], "slot long"), [body]).toPandas()
    assert sorted(rows.slot) == sorted(slots)  # one each, none beyond the calendar
    n = len(rows)
    pdf = rows.assign(lat=rng.uniform(-65, 65, n), lon=rng.uniform(-180, 180, n), height=0.0)
    t = pdf.slot.to_numpy() * ephemeris.SLOT + rng.integers(-ephemeris.MARGIN, ephemeris.SLOT + ephemeris.MARGIN, n)
    place = ephemeris.Track(pdf).at(t)[:2]
    days = ephemeris.days_of(t)
    if body == "moon":
        d = sky.moon.func(pd.Series(days), pdf.lat, pdf.lon, pdf.height)
        exact = d.azimuth, d.altitude
    elif body == "sun":
        exact = sky.sun_series(days, pdf.lat.to_numpy(), pdf.lon.to_numpy())
    else:
        q = spark.createDataFrame(list(zip(range(n), t.tolist(), pdf.lat.tolist(), pdf.lon.tolist())), "i int, t long, lat double, lon double")
        star = sky.POLARIS if body == "polaris" else sky.GALACTIC_CENTRE
        d = q.withColumn("at", F.timestamp_micros("t")).select("i", sky.star_horizon("at", "lat", "lon", star).alias("h")).orderBy("i").select("h.*").toPandas()
        exact = d.azimuth, d.altitude
    assert np.abs((np.asarray(place[0] - exact[0]) + 180) % 360 - 180).max() < 1e-7  # near the zenith the azimuth is worth less
    assert np.abs(np.asarray(place[1] - exact[1])).max() < 1e-9


def test_one_sun_crossing_in_the_frame(spark):
    s = searches(spark, (1, "2026-03-19 15:00:00", "2026-03-20 15:00:00", 35.681236, 139.767125, 100.0, 0.0))
    rows = passes.crossings(s, ["sun"], "Asia/Tokyo", [], F.lit(0), F.lit(1439), below_subject=True).collect()
    assert len(rows) == 1 and rows[0].azimuth == pytest.approx(100, abs=0.01)
    assert passes.crossings(s, ["sun"], "Asia/Tokyo", [0], F.lit(0), F.lit(1439)).count() == 0
    hour = (rows[0].instant.hour * 60 + rows[0].instant.minute + 540) % 1440  # Japan is nine hours ahead
    assert passes.crossings(s, ["sun"], "Asia/Tokyo", [5], F.lit(hour), F.lit(hour)).count() == 1
    assert passes.crossings(s, ["sun"], "Asia/Tokyo", [5], F.lit(hour + 1), F.lit(hour - 1)).count() == 0
    narrow = searches(spark, (1, "2026-03-19 15:00:00", "2026-03-20 15:00:00", 35.681236, 139.767125, 100.0, 0.0), focal=300.0)
    assert passes.crossings(narrow, ["sun"], "Asia/Tokyo", [], F.lit(0), F.lit(1439)).count() == 0  # it passes over the frame


def test_crossings_of_all_bodies_stand_over_the_bearing(spark):
    s = searches(spark, (1, "2026-05-01 00:00:00", "2026-05-04 00:00:00", -33.9, 18.4, 60.0, 0.0), (2, "2026-05-01 00:00:00", "2026-05-04 00:00:00", 60.0, 25.0, 0.3, 0.0))
    rows = passes.crossings(s, ephemeris.BODIES, "Africa/Johannesburg", [], F.lit(0), F.lit(1439), in_frame=False).collect()
    assert all(abs((r.azimuth - r.bearing + 180) % 360 - 180) < 0.01 and r.altitude > 0.25 for r in rows)
    assert {(r.id, r.body) for r in rows} >= {(1, "sun"), (1, "moon"), (1, "milkyWay"), (2, "polaris")}
    assert sum(r.body == "polaris" for r in rows) in (6, 7)  # twice a day


def test_an_interval_runs_on_over_cuts(spark):
    # the pole star never leaves a wide frame that looks north: one interval of three days, in spite of days and windows
    s = searches(spark, (1, "2026-05-01 00:00:00", "2026-05-04 00:00:00", 45.0, 10.0, 0.0, 40.0))
    row = passes.frame_intervals(s, ["polaris"], "Europe/Berlin", [], F.lit(0), F.lit(1439)).collect()
    assert [(r.enter, r.leave) for r in row] == [(dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 4))]
    nights = passes.frame_intervals(s, ["polaris"], "Europe/Berlin", [], F.lit(22 * 60), F.lit(4 * 60 - 1)).orderBy("enter").collect()
    # summer time is two hours ahead; windows that meet at midnight are one night
    assert [(r.enter.hour, r.leave.hour) for r in nights] == [(0, 2), (20, 2), (20, 2), (20, 0)]
    friday = passes.frame_intervals(s, ["polaris"], "Europe/Berlin", [5], F.lit(0), F.lit(1439)).collect()
    assert [(r.enter, r.leave) for r in friday] == [(dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 1, 22))]
    assert passes.frame_intervals(s.limit(0), ["polaris"], "Europe/Berlin", [], F.lit(0), F.lit(1439)).count() == 0


def test_frame_edges_and_closest_instant(spark):
    s = searches(spark, (1, "2026-03-19 15:00:00", "2026-03-20 15:00:00", 35.7, 139.8, 180.0, 50.0), focal=100.0)
    (row,) = passes.frame_intervals(s, ["moon", "sun"], "Asia/Tokyo", [], F.lit(0), F.lit(1439), below_subject=True).where("body = 'sun'").collect()
    edges = pd.DataFrame({"t": pd.date_range(row.enter, row.leave, freq="10s")})
    days = ephemeris.days_of(edges.t.astype("datetime64[us]").astype(np.int64).to_numpy())
    azimuth, altitude = sky.sun_series(days, np.full(len(days), 35.7), np.full(len(days), 139.8))
    seen, distance = optics.frame_series(azimuth, altitude, np.full(len(days), 0.535), 180.0, 50.0, row.h_fov, row.v_fov)
    assert seen[1:-1].all() and not seen[0]
    assert abs((edges.t[int(distance.argmin())] - row.closest).total_seconds()) <= 15
    assert row.distance == pytest.approx(distance.min(), abs=1e-4)


def test_rises_and_sets(spark):
    days = searches(spark, (1, "2026-06-20 00:00:00", "2026-06-21 00:00:00", 70.0, 25.0, 0.0, 0.0), (2, "2026-03-19 15:00:00", "2026-03-20 15:00:00", 35.681236, 139.767125, 0.0, 0.0))
    rows = {(r.id, r.body): r for r in passes.rises_and_sets(days).collect()}
    assert len(rows) == 8
    assert rows[1, "sun"].rise is None and rows[1, "sun"]["set"] is None  # midnight sun
    assert rows[2, "polaris"].rise is None
    sun = rows[2, "sun"]
    assert sun.rise < sun["set"] and abs((sun["set"] - sun.rise).total_seconds() / 3600 - 12) < 0.2
    moon = rows[2, "moon"]
    assert moon.rise is not None and abs((moon.rise - sun.rise).total_seconds()) < 3 * 3600  # a day after new moon


def test_roots_over_arrays():
    low, high = roots.bisect_edges(np.array([0, 0]), np.array([10_000_000_000] * 2), lambda t: t >= np.array([3_000_000_000, 7_123_456_789]), 40)
    assert (high - low <= 1_000_000).all() and (low < [3_000_000_000, 7_123_456_789]).all() and (high >= [3_000_000_000, 7_123_456_789]).all()
    least = roots.least_between(np.array([0]), np.array([10_000_000_000]), lambda t: np.abs(t - 4_000_000_000), 60)
    assert abs(int(least[0]) - 4_000_000_000) <= 1_000_000


def plain_rate(updates, weight=0.25, least=750.0):
    start, counted, now, rate = None, 0.0, 0.0, None
    for t, p in sorted(updates):
        now = max(now, p)
        if start is None:
            start = t
            continue
        gone = (t - start) / 1000
        if now < 100 and now > counted and gone >= least:
            measured = gone / (now - counted)
            rate = measured if rate is None else rate * (1 - weight) + measured * weight
            start, counted = t, now
    return now, rate


def test_rate_is_folded_in_order(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k) if k else None, None if k == 3 else f"n{k}", int(t), float(p)) for k, t, p in zip(rng.integers(0, 9, 3000), rng.integers(0, 400_000_000, 3000), rng.integers(0, 104, 3000) - 2)]
    rows += [(20, "one", 5, 50.0), (21, "none", 5, None)]
    df = spark.createDataFrame(rows, "a int, b string, t long, p double").withColumn("at", F.timestamp_micros("t")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # states go on over batches
    try:
        got = {(r.a, r.b): (r.percent, r.ms_per_percent) for r in windows.rate_average(df, ["a", "b"], "at", "p").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_key = {}
    for a, b, t, p in rows:
        if p is not None:
            by_key.setdefault((a, b), []).append((t, min(100.0, max(0.0, np.floor(p + 0.5)))))
    assert got == {k: plain_rate(v) for k, v in by_key.items()}
    assert windows.rate_average(df.limit(0), ["a", "b"], "at", "p").count() == 0


def test_rate_of_one_long_key(spark):
    # ten million updates of one key: the state is four numbers, nothing is collected
    rows = spark.range(10_000_000).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 1000).alias("at"), (F.col("id") / 100_000).alias("p"))
    (r,) = windows.rate_average(rows, ["k"], "at", "p").collect()
    assert r.percent == 100 and r.ms_per_percent == pytest.approx(100_000, rel=1e-3) and r.seconds_left is None

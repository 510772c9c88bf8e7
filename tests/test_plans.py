"""Sources, searches and streams over small made-up inputs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_functions import png

from lumenplan.functions import features, optics
from lumenplan.functions.geodesic import geodesic_inverse
from lumenplan.operators import joins, sampling, windows
from lumenplan.plans import occlusion, spot, timeline, transit
from lumenplan.sources import dem, places, store, weather
from lumenplan.streaming import jobs


def ts(df, *cols):
    return df.withColumns({c: F.to_timestamp(c) for c in cols})


def test_one_sun_crossing(spark):
    # the subject is a kilometre away at 100 degrees; one crossing on the day, in the frame
    s = ts(spark.createDataFrame([(1, "2026-03-19 15:00:00", "2026-03-20 15:00:00", 35.681236, 139.767125, 100.0, 0.0)], "id int, start string, end string, lat double, lon double, bearing double, subject_elevation double"), "start", "end")
    rows = transit.direction_crossings(s, "Asia/Tokyo", [], F.lit(0), F.lit(1439)).collect()
    assert len(rows) == 1
    assert rows[0].azimuth == pytest.approx(100, abs=0.01)
    assert transit.direction_crossings(s, "Asia/Tokyo", [0], F.lit(0), F.lit(1439)).count() == 0


def test_in_frame(spark):
    fov = optics.fields_of_view(F.lit(35.0), F.lit(1.5))
    s = spark.createDataFrame([(1, 100.0, 0.0)], "id int, bearing double, subject_elevation double").withColumn("h", fov["h"]).withColumn("v", fov["v"])
    p = spark.range(0, 40).select(F.lit(1).alias("id"), F.timestamp_seconds(F.col("id") * 60).alias("instant"), (F.col("id") * 2 + 60.0).alias("azimuth"), F.lit(5.0).alias("altitude"), F.lit(0.5).alias("diameter"))
    row = transit.in_frame(s, p, "h", "v").first()
    assert row.closest.timestamp() == 20 * 60 and row.n == 27


def test_ternary(spark):
    low = transit.ternary(F.lit(0), F.lit(10_000_000), lambda t: F.abs(t - 3_000_000))
    assert abs(spark.range(1).select(low.alias("v")).first().v - 3_000_000) < 1000


def flat_sampler(points):
    return points.withColumn("height", F.lit(0.0)).withColumn("source", F.lit("flat"))


def test_spot_distance(spark):
    # on flat ground a tower of 100 m stands 5 degrees high at 100 / tan 5
    t = spark.createDataFrame([("a", 35.0, 135.0, 100.0, 0.0, 90.0, 5.0)], "key string, subject_lat double, subject_lon double, subject_height double, lens double, back double, altitude double")
    row = spot.distance_roots(t, flat_sampler, 100.0, 5000.0, "pro").first()
    assert row.distance == pytest.approx(100 / np.tan(np.radians(5)), rel=2e-3)
    assert abs(row.error) < 0.01


def test_spot_search(spark):
    samples = ts(spark.createDataFrame([(1, "2026-03-20 22:00:00", 100.0, 8.0, 35.0, 135.0, 100.0, 1.5, "sun")],
        "sample int, instant string, azimuth double, altitude double, subject_lat double, subject_lon double, subject_height double, lens double, body string"), "instant")
    placer = lambda rows: rows.withColumn("azimuth", F.lit(100.0)).withColumn("altitude", F.lit(8.0))
    sites = lambda p: p.select("key", F.lit(True).alias("walkable"), *[F.lit(False).alias(n) for n in ("on_way", "on_motor_road", "restricted")])
    found = spot.search(samples, placer, flat_sampler, sites, 35.0, 1.5, 100.0, 5000.0, F.lit(54.4), F.lit(37.8), (True, True, False, False)).collect()
    assert len(found) == 1 and found[0].composition == 1
    assert found[0].distance == pytest.approx((100 - 1.5) / np.tan(np.radians(8)), rel=2e-2)


def test_horizon_and_verdict(spark):
    rays = spark.createDataFrame([("a", 35.0, 135.0, 1.6, 0.0)], "key string, lat double, lon double, eye double, azimuth double")
    ridge = lambda p: p.withColumn("height", F.when(F.abs(F.col("lat") - 35.05) < 0.002, 800.0).otherwise(0.0)).withColumn("source", F.lit("x"))
    top = occlusion.terrain_horizon(rays, ridge, farthest=20000.0)
    row = top.first()
    assert 8 < row.elevation < 9 and 5200 < row.distance < 5600
    none = spark.createDataFrame([], "key string, surface_elevation double")
    bodies = spark.createDataFrame([("a", 5.0), ("a", 9.5), ("a", -1.0)], "key string, altitude double")
    got = {r.altitude: r.reason for r in occlusion.verdict(bodies, top, none).collect()}
    assert got == {5.0: "terrain", 9.5: "clear", -1.0: "below-horizon"}


def test_tiles(spark, tmp_path):
    flat = np.zeros((256, 256, 3), np.uint8)
    flat[..., 1] = 39  # 99.84 m
    lat, lon = 35.0, 135.0
    from lumenplan.functions.earth import tile

    t = spark.range(1).select(tile(F.lit(lat), F.lit(lon), F.lit(14)).alias("t")).first().t
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            d = tmp_path / "dem_png" / "14" / str(t.x + dx)
            d.mkdir(parents=True, exist_ok=True)
            (d / f"{t.y + dy}.png").write_bytes(png(flat, [2]))
    tiles = dem.read_png_tiles(spark, str(tmp_path))
    assert tiles.count() == 9
    pts = spark.createDataFrame([("in", lat, lon, "1m"), ("out", 0.0, 0.0, "1m"), ("empty", 40.0, 140.0, "1m")], "key string, lat double, lon double, detail string")
    got = {r.key: (r.height, r.source) for r in dem.sample(pts, tiles, "key").collect()}
    assert got["in"] == (pytest.approx(99.84), "DEM10B")
    assert got["out"] == (None, None) and got["empty"] == (None, None)
    dem.write_tiles(tiles, str(tmp_path / "decoded"))
    assert dem.read_tiles(spark, str(tmp_path / "decoded")).count() == 9


def test_weather(spark, tmp_path):
    body = {"hourly": {"time": ["2026-03-20T00:00", "2026-03-20T01:00", "2026-03-20T05:00"], "temperature_2m": [1.0, 2.0, None], "relative_humidity_2m": [50.0, 50.0, 50.0], "surface_pressure": [1000.0, 1000.0, 1000.0]}}
    (tmp_path / "w.json").write_text(json.dumps(body))
    w = weather.read_hourly(spark, str(tmp_path / "w.json"))
    assert w.count() == 2
    asks = ts(spark.createDataFrame([(1, "2026-03-20 00:30:00"), (2, "2026-03-20 02:30:00"), (3, "2026-03-20 02:31:00")], "id int, at string"), "at")
    got = {r.id: r.temperature for r in weather.at_instants(asks, w, "at", "forecast").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None}  # the tie takes the earlier one; 90 minutes are included
    now = pd.Timestamp("2026-03-20").to_pydatetime()
    day = pd.Timedelta(days=1).to_pytimedelta()
    assert weather.choose_source("auto", now, now + 3 * day, now) == "forecast"
    assert weather.choose_source("auto", now, now + 9 * day, now) == "climatology"
    assert weather.choose_source("standard", now, now, now) == "standard"


def test_sites(spark, tmp_path):
    body = {"elements": [
        {"type": "way", "id": 1, "tags": {"highway": "residential"}, "geometry": [{"lat": 35.0, "lon": 134.999}, {"lat": 35.0, "lon": 135.001}]},
        {"type": "way", "id": 2, "tags": {"access": "private"}, "geometry": [{"lat": 35.0009, "lon": 134.999}, {"lat": 35.0011, "lon": 134.999}, {"lat": 35.0011, "lon": 135.001}, {"lat": 35.0009, "lon": 135.001}, {"lat": 35.0009, "lon": 134.999}]},
        {"type": "node", "id": 3, "lat": 35.002, "lon": 135.0, "tags": {"man_made": "mast", "height": "30"}},
    ]}
    (tmp_path / "m.json").write_text(json.dumps(body))
    elements = places.read_elements(spark, str(tmp_path / "m.json"))
    pts = spark.createDataFrame([("road", 35.00001, 135.0), ("private", 35.001, 135.0), ("far", 36.0, 136.0)], "key string, lat double, lon double")
    got = {r.key: (r.walkable, r.on_motor_road, r.restricted) for r in places.site_contexts(pts, elements).collect()}
    assert got == {"road": (True, True, False), "private": (False, False, True), "far": (False, False, False)}
    own = spark.createDataFrame([("X", "mast-of-list", 35.002, 135.0, 44.0, "node", 3)], places.STRUCTURE_SCHEMA)
    s = [r for r in places.structures(pts, elements, own).collect() if r.key == "road"]
    assert [(r.kind, r.height) for r in s] == [("mast-of-list", 44.0)]
    marks = places.landmarks(pts, elements)
    assert {r.key for r in marks.collect()} == {"road", "private"}
    assert places.combined(marks, places.structures(pts, elements, own)).count() >= 2
    rays = pts.withColumn("azimuth", F.lit(0.0))
    trees = elements.withColumn("tags", F.create_map(F.lit("natural"), F.lit("tree")))
    hit = [r for r in places.corridor(rays, trees, "key", "azimuth").collect() if r.key == "road" and r.id == 3]
    assert hit[0].obstacle == 8 and 215 < hit[0].along < 230


def test_zones(spark):
    square = [(34.0, 134.0), (34.0, 136.0), (36.0, 136.0), (36.0, 134.0), (34.0, 134.0)]
    polygons = spark.createDataFrame([("Asia/Tokyo", square)], "zone string, ring array<struct<lat:double,lon:double>>")
    pts = spark.createDataFrame([("a", 35.0, 135.0), ("b", 0.0, -150.0)], "key string, lat double, lon double")
    got = {r.key: r.zones for r in places.time_zones(pts, polygons).collect()}
    assert got == {"a": ["Asia/Tokyo"], "b": ["Etc/GMT+10"]}


def test_geocode(spark):
    g = spark.createDataFrame([("Tokyo Tower East", 1.0, 2.0, 0), ("Tokyo Tower", 35.6, 139.7, 1)], "title string, lat double, lon double, idx int")
    q = spark.createDataFrame([("Ｔｏｋｙｏ tower",), ("35.5, 135.5",), ("nothing",)], "query string")
    got = {r.query: (r.title, r.lat) for r in places.geocode(q, g).collect()}
    assert got["Ｔｏｋｙｏ tower"] == ("Tokyo Tower", 35.6)
    assert got["35.5, 135.5"][1] == 35.5 and got["nothing"] == (None, None)


def test_geocode_finds_titles_inside_the_query(spark):
    g = spark.createDataFrame([("tower", 1.0, 2.0, 0), ("tall tower", 3.0, 4.0, 1), ("x", 5.0, 6.0, 2), ("", 7.0, 8.0, 3)], "title string, lat double, lon double, idx int")
    q = spark.createDataFrame([("abc tower",), ("tall",), ("axe",), ("qqq",), ("",), (None,)], "query string")
    got = {r.query: (r.title, r.score) for r in places.geocode(q, g).collect()}
    assert got == {"abc tower": ("tower", 3), "tall": ("tall tower", 1), "axe": ("x", 3), "qqq": (None, None), "": (None, None), None: (None, None)}
    assert {r.query: r.score for r in places.geocode(q, g.where("title != ''"), any_title=True).collect()}["qqq"] == 4


def test_nearest_in_time_keeps_repeated_rows(spark):
    left = ts(spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:00:00"), (2, "2026-01-01 00:09:00"), (3, None)], "id int, t string"), "t").repartition(3)
    right = ts(spark.createDataFrame([("a", "2026-01-01 00:01:00"), ("b", "2026-01-01 00:08:00")], "name string, at string"), "at").repartition(2)
    got = joins.nearest_in_time(left, right, "t", "at", 300)
    assert got.columns == ["id", "t", "name", "at"]
    assert sorted((r.id, r.name or "") for r in got.collect()) == [(1, "a"), (1, "a"), (2, "b"), (3, "")]
    assert "monotonically" not in got._jdf.queryExecution().toString()


def test_new_moons_over_the_turn_of_a_year(spark):
    days = spark.sql("SELECT explode(sequence(TIMESTAMP'2023-11-01', TIMESTAMP'2024-03-01', INTERVAL 1 DAY)) AS instant")
    found = sorted(r.new_moon.strftime("%Y-%m-%d") for r in timeline.new_moons(days).collect())
    assert found == ["2023-11-13", "2023-12-12", "2024-01-11", "2024-02-09"]


def test_sequences(spark):
    rows = spark.createDataFrame([(1, t, e) for t, e in enumerate([-1.0, 0.0, 1.0, -1.0])], "id int, t int, e double")
    assert windows.sign_changes(rows, ["id"], "t", "e").count() == 2  # the zero counts once
    band = windows.minimal_band(spark.createDataFrame([(1, 350.0), (1, 10.0), (1, 20.0)], "id int, a double"), ["id"], "a").first()
    assert (band.band_start, band.band_end) == (347, 23)
    d = ts(spark.createDataFrame([("2026-01-31 00:00:00", "2026-04-01 00:00:00")], "a string, b string"), "a", "b")
    got = [r.instant.strftime("%m-%d") for r in sampling.local_instants(d, "a", "b", "1-month", "UTC").orderBy("instant").collect()]
    assert got == ["01-31", "02-28", "03-28"]
    ring = sampling.ring(spark.createDataFrame([(35.0, 135.0)], "lat double, lon double"), "lat", "lon")
    assert ring.count() == 49
    assert sampling.disc_edge(spark.createDataFrame([(0.0, 10.0)], "az double, alt double"), "az", "alt", F.lit(0.25), 8).count() == 9
    assert sampling.prefetch_points(spark.createDataFrame([(35.0, 135.0)], "lat double, lon double"), "lat", "lon", 100.0, 1000.0).count() == 289


def test_nearest_keeps_unmatched(spark):
    left = ts(spark.createDataFrame([("2026-01-01 00:00:00",), (None,)], "t string"), "t")
    right = ts(spark.createDataFrame([("2026-01-01 00:20:00", 1)], "at string, v int"), "at")
    got = joins.nearest_in_time(left, right, "t", "at", 1200).collect()
    assert sorted(str(r.v) for r in got) == ["1", "None"]


def test_store(spark):
    held = ts(spark.createDataFrame([("a", 35.0, 135.0, "2026-01-01 00:00:00")], "name string, lat double, lon double, updated_at string"), "updated_at")
    new = ts(spark.createDataFrame([("b", 35.0000001, 135.0, "2026-01-02 00:00:00")], "name string, lat double, lon double, updated_at string"), "updated_at")
    assert [r.name for r in store.save_subjects(held, new).collect()] == ["b"]


JOB = "version int, client_id string, job_id string, status string, progress_percent int, input string, error string, created_at timestamp, updated_at timestamp"


def test_accept(spark):
    t = pd.Timestamp("2026-01-01").to_pydatetime()
    held = spark.createDataFrame([(1, "c", "1", "queued", 0, "A", None, t, t)], JOB)
    asked = spark.createDataFrame([(1, "c", "1", None, 0, "A", None, t, t), (1, "c", "1", None, 0, "B", None, t, t), (1, "c", "2", None, 0, "C", None, t, t)], JOB)
    got = sorted((r.job_id, r.input, r.answer) for r in jobs.accept(asked, held).collect())
    assert got == [("1", "A", "repeated"), ("1", "B", "conflict"), ("2", "C", "accepted")]


def test_consume(spark, tmp_path):
    q = tmp_path / "queue"
    q.mkdir()
    message = {"version": 1, "client_id": "c", "job_id": "1", "status": "queued", "input": "{}", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-01T00:00:00Z"}
    for k in range(4):
        (q / f"{k}.json").write_text(json.dumps(message) + "\n" + json.dumps(message | {"job_id": "bad"}))
    run = lambda df: df.withColumn("status", F.when(F.col("job_id") == "bad", "failed").otherwise("awaiting-3d")).withColumn("error", F.lit(None).cast("string"))
    query = jobs.consume(jobs.read_queue(spark, str(q)), run, str(tmp_path / "results"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "results")).collect()
    assert sum(r.job_id == "1" for r in rows) == 1  # done once, not again
    assert sorted((r.attempt, r.final) for r in rows if r.job_id == "bad") == [(1, False), (2, False), (3, True)]


def test_progress_stream(spark, tmp_path):
    d = tmp_path / "updates"
    d.mkdir()
    rows = [(0, 5), (100, 42), (800, 18), (1600, 80), (2400, 100)]
    (d / "0.json").write_text("\n".join(json.dumps({"job_id": "a", "at": f"2026-01-01T00:00:{ms / 1000:06.3f}Z", "percent": p}) for ms, p in rows))
    stream = spark.readStream.schema("job_id string, at timestamp, percent int").json(str(d))
    q = jobs.throttle_progress(stream).writeStream.format("memory").queryName("progress_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.percent for r in spark.sql("SELECT percent FROM progress_out ORDER BY at").collect()] == [5, 42, 80, 97]


def test_stalls_and_checkpoints(spark):
    t = lambda s: pd.Timestamp(f"2026-01-01 00:00:{s:02d}").to_pydatetime()
    rows = [(1, "c", "1", "queued", 0, "A", None, t(0), t(0)), (1, "c", "1", "queued", 0, "A", None, t(0), t(1)), (1, "c", "1", "running", 9, "A", None, t(0), t(2)), (1, "c", "1", "failed", 9, "A", "x", t(0), t(3))]
    df = spark.createDataFrame(rows, JOB)
    assert jobs.checkpoints(df).count() == 2
    late = F.to_timestamp(F.lit("2026-01-01 00:00:50"))
    assert [r.stall for r in jobs.stalled(df.limit(1), late).collect()] == ["queued"]


def test_foreground_between_tripod_and_subject(spark):
    # 100 m long: 0.25 m off the ends and 20 m off the line at most; the bearing passes north
    rows = [
        ("middle", 100.0, 359.0, 50.0, 1.0, True), ("at the tripod", 100.0, 359.0, 0.2, 359.0, False), ("at the subject", 100.0, 359.0, 99.8, 359.0, False), ("behind", 100.0, 0.0, 10.0, 180.0, False),
        ("19 m aside", 100.0, 0.0, 53.49, 20.8, True), ("21 m aside", 100.0, 0.0, 54.23, 22.8, False), ("one place", 0.01, 0.0, 0.005, 0.0, False), ("unknown", 100.0, 0.0, None, 0.0, False),
        ("5 m aside of 10 m", 10.0, 90.0, 7.0, 134.0, True), ("31 m aside of 900 m", 900.0, 90.0, 400.0, 94.5, False),
    ]
    df = spark.createDataFrame(rows, "name string, l double, b double, d double, a double, inside boolean")
    for r in df.withColumn("got", features.between_ends("l", "b", "d", "a")).collect():
        assert r["got"] == r["inside"], r["name"]


def test_follow_bodies_keeps_the_distance(spark):
    bodies = spark.createDataFrame([("sun", 35.0, 139.0, 100.0, 20.0), ("moon", 35.0, 139.0, 200.0, 0.25), ("star", 35.0, 139.0, 5.0, 30.0)], "id string, lat double, lon double, azimuth double, altitude double")
    previous = spark.createDataFrame([("sun", 1500.0), ("moon", 900.0)], "id string, distance double")
    moved = sampling.follow_bodies(bodies, previous, ["id"], "lat", "lon")
    back = moved.withColumn("g", geodesic_inverse("lat", "lon", "candidate_lat", "candidate_lon")).select("id", "g.*").collect()
    assert [r["id"] for r in back] == ["sun"]  # the moon is low, the star had no place
    assert back[0]["distance"] == pytest.approx(1500, abs=1e-5) and back[0]["azimuth"] == pytest.approx(280, abs=1e-6)

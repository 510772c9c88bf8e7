"""Redelivery and stall timers of streams, searches by windows, staged refinement, pruned scans."""

import json
import time

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenplan.functions.geodesic import geodesic_inverse
from lumenplan.operators import ranking, sampling
from lumenplan.plans import spot
from lumenplan.sources import dem, places
from lumenplan.streaming import jobs

MESSAGE = {"version": 1, "client_id": "c", "job_id": "1", "status": "queued", "input": "{}", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-01T00:00:00Z"}


def wait(query, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None
        time.sleep(0.5)
    query.stop()


def results(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception:
        return []


def test_a_failed_job_is_tried_again_without_a_message(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "DELAY_SECONDS", 1)
    q = tmp_path / "queue"
    q.mkdir()
    (q / "0.json").write_text("\n".join(json.dumps(MESSAGE | {"job_id": j}) for j in ("good", "late", "bad")))
    failed = (F.col("job_id") == "bad") | ((F.col("job_id") == "late") & (F.col("attempt") < 3))
    run = lambda df: df.withColumn("status", F.when(failed, "failed").otherwise("awaiting-3d")).withColumn("error", F.lit(None).cast("string"))
    out = str(tmp_path / "results")
    query = jobs.consume(jobs.with_heartbeat(jobs.read_queue(spark, str(q))), run, out, str(tmp_path / "checkpoint"), {"processingTime": "1 second"})
    wait(query, lambda: sum(r.final for r in results(spark, out)) == 3)
    time.sleep(1)
    rows = results(spark, out)
    assert sorted((r.job_id, r.attempt, r.status, r.final) for r in rows) == [
        ("bad", 1, "failed", False), ("bad", 2, "failed", False), ("bad", 3, "failed", True), ("good", 1, "awaiting-3d", True),
        ("late", 1, "failed", False), ("late", 2, "failed", False), ("late", 3, "awaiting-3d", True),
    ]
    late = sorted((r for r in rows if r.job_id == "late"), key=lambda r: r.attempt)
    assert (late[2].tried_at - late[1].tried_at).total_seconds() >= 2  # the delay grows with the attempts


def test_due_waits_its_delay(spark):
    at = pd.Timestamp("2026-01-01 00:00:00").to_pydatetime()
    rows = [("c", "a", "failed", None, 1, False, json.dumps(MESSAGE | {"job_id": "a"}), at, 0), ("c", "b", "failed", None, 3, True, json.dumps(MESSAGE), at, 0),
            ("c", "d", "failed", None, 1, False, None, at, 0), ("c", "e", "failed", None, 1, False, json.dumps(MESSAGE), at, 0), ("c", "e", "awaiting-3d", None, 2, True, json.dumps(MESSAGE), at, 1)]
    table = spark.createDataFrame(rows, jobs.RESULT_SCHEMA)
    found = lambda s: [r.job_id for r in jobs.due(table, F.lit(f"2026-01-01 00:00:{s:02d}").cast("timestamp")).collect()]
    assert found(4) == [] and found(5) == ["a"]


def test_silence_alone_reports_a_stall(spark, tmp_path):
    d = tmp_path / "updates"
    d.mkdir()
    rows = [("run", "running"), ("done", "running"), ("done", "completed"), ("wait", "queued"), ("new", None)]
    (d / "0.json").write_text("\n".join(json.dumps({"job_id": j, "status": s}) for j, s in rows))
    stream = spark.readStream.schema("job_id string, status string").json(str(d))
    watched = jobs.watch(stream, {"missing": 1, "queued": 2, "stalled": 3})
    query = watched.writeStream.format("memory").queryName("stalls_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    got = lambda: sorted(map(tuple, spark.sql("SELECT * FROM stalls_out").collect()))
    wait(query, lambda: len(got()) >= 3)
    assert got() == [("new", "missing"), ("run", "stalled"), ("wait", "queued")]


def test_later_windows_are_not_read(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf[pdf.id % 3 == 0]

    rows = spark.range(10_000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("at"))
    find = lambda df: df.mapInPandas(look, df.schema)
    got = ranking.earliest_by_windows(rows, "at", "id", 50, 600, find).collect()
    assert [r.id for r in got] == list(range(0, 150, 3))
    assert seen.value < 700  # windows of 10, 20, 40, 80 and 160 rows
    assert [r.id for r in ranking.earliest_by_windows(rows.where("id < 7"), "at", "id", 50, 60, find).collect()] == [0, 3, 6]
    assert ranking.earliest_by_windows(rows.limit(0), "at", "id", 50, 60).count() == 0


def test_the_newest_of_a_key_are_taken_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = ranking.top_per_key(rows, ["k"], [F.desc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted((r.place, r.id) for r in top.collect()) == [(1, 998), (1, 999), (2, 996), (2, 997), (3, 994), (3, 995)]


def test_answers_reach_every_point_of_a_region(spark):
    points = spark.range(500).select("id", F.lit(35.0).alias("lat"), F.when(F.col("id") < 450, 139.0).otherwise(140.0 + F.col("id")).alias("lon"))
    asked = dem.region_representatives(points, "lat", "lon", "id")
    answers = asked.where("lon < 600").select("region_lat", "region_lon", F.col("lon").alias("answer"))
    got = dem.fan_out(points, answers, "lat", "lon", "id").collect()
    assert len(got) == 500 and all(r.answer == (r.lon if r.lon < 600 else None) for r in got)


def test_base_lines_run_along_the_geodesic(spark):
    df = spark.createDataFrame([("a", 35.0, 139.0, 100.0, 5.0), ("b", 10.0, 179.0, 270.0, 5.0), ("low", 35.0, 139.0, 100.0, 0.0)], "id string, lat double, lon double, azimuth double, altitude double")
    rows = sampling.base_lines(df, "lat", "lon", "azimuth", "altitude").orderBy("id", "idx", "part").collect()
    a, b = ([r for r in rows if r.id == k] for k in "ab")
    assert len(a) == 25 and len(b) == 26 and not [r for r in rows if r.id == "low"]
    assert all(abs(r.lon1 - r.lon2) < 1 for r in rows)
    assert all((p.lat2, p.lon2) == (q.lat1, q.lon1) for p, q in zip(a, a[1:]))
    cut = [r for r in b if abs(r.lon2) == 180 or abs(r.lon1) == 180]
    assert [(r.part, r.lon1 == -180, r.lon2 == 180) for r in cut] == [(0, False, True), (1, True, False)] and cut[0].lat2 == cut[1].lat1
    end = spark.createDataFrame([(35.0, 139.0, a[-1].lat2, a[-1].lon2)], "a double, b double, c double, d double").select(geodesic_inverse("a", "b", "c", "d").alias("g")).first().g
    assert end.distance == pytest.approx(250_000, abs=1e-5) and end.azimuth == pytest.approx(280, abs=1e-7)


def test_refinement_in_stages(spark):
    origins = spark.createDataFrame([("x", 35.0, 139.0), ("y", 36.0, 139.0), ("z", 37.0, 139.0)], "key string, lat double, lon double")
    bearing, radius = (F.element_at(F.split("key", ":"), k).cast("double") for k in (3, 2))
    sampler = lambda asks: asks.withColumn("height", F.when(~F.col("key").startswith("z") & ~((radius == 5) & (bearing == 0)), radius))
    contexts = lambda rows: rows.select("key", (F.element_at(F.split("key", ":"), 2) != "20").alias("walkable"), *[F.lit(False).alias(n) for n in ("on_way", "on_motor_road", "restricted")])
    evaluate = lambda rows: rows.withColumn("error", F.when(F.col("key") == "x", F.col("height")).otherwise(20 - F.col("height")))
    checks = lambda rows: rows.withColumn("clear", F.col("radius") > 0)
    best, aside = spot.refine(origins, sampler, evaluate, contexts, checks)
    assert {r.key: (r.radius, r.bearing) for r in best.collect()} == {"x": (5.0, 30.0), "y": (15.0, 0.0)}  # 20 m is no place to stand
    reasons = aside.groupBy("key").count().collect()
    assert {r.key: r["count"] for r in reasons} == {"x": 1, "y": 1, "z": 37}


def test_bounds_prune_row_groups(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("node", k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-80, 80, 20_000), rng.uniform(-179, 179, 20_000)))]
    elements = spark.createDataFrame(rows, "type string, id long, south double, west double").select("*", (F.col("south") + 0.01).alias("north"), (F.col("west") + 0.01).alias("east"))
    path = str(tmp_path / "elements")
    places.save_elements(elements, path, files=16, rows_a_group=200)
    area = (30.0, 130.0, 38.0, 142.0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = places.elements_in_bounds(spark, path, *area)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{op}({c}," in plan for op, c in (("GreaterThanOrEqual", "north"), ("LessThanOrEqual", "south"), ("GreaterThanOrEqual", "east"), ("LessThanOrEqual", "west")))
    inside = [r[1] for r in rows if r[2] + 0.01 >= 30 and r[2] <= 38 and r[3] + 0.01 >= 130 and r[3] <= 142]
    assert sorted(r.id for r in found.collect()) == sorted(inside) and len(inside) > 20
    groups = read = 0
    for f in (tmp_path / "elements").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            read += stats["north"].max >= 30 and stats["south"].min <= 38 and stats["east"].max >= 130 and stats["west"].min <= 142
    assert groups >= 16 and read <= max(2, groups // 5)

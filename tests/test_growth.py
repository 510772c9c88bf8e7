"""What queries must not do as their tables grow: group exploded rows, repeat work, or leave it to a few tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenplan.functions import geodesic
from lumenplan.operators import lineage
from lumenplan.plans import occlusion
from lumenplan.queries import QUERIES
from lumenplan.sources import places

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["milky_way_band", "horizon_profile"])
def test_rows_are_not_grouped(spark, name):
    assert "Aggregate" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["share_code_roundtrip", "geodesic_lines", "equator_lines", "base_lines", "way_bounds", "milky_way_band", "horizon_profile"])
def test_work_is_dealt_over_tasks(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.rdd.getNumPartitions() == lineage.tasks(df)


def test_share_codes_are_parsed_once(spark):
    assert plan(QUERIES["share_code_roundtrip"](spark, SF)).count("from_json(") == 1


def test_highest_of_a_row_equals_that_of_rows(spark):
    nan = float("nan")
    profiles = {1: [1.0, 5.0, 5.0, None], 2: [nan, 3.0, nan], 3: [None, nan], 4: [-7.0, -7.0]}
    rows = [(k, i, 10.0 * i, e) for k, own in profiles.items() for i, e in enumerate(own)]
    df = spark.createDataFrame(rows, "id int, idx int, distance double, elevation double")
    one = df.groupBy("id").agg(F.collect_list(F.struct("elevation", "idx", "distance")).alias("p")).select("id", occlusion.highest_in(F.col("p")).alias("t"))
    assert {(r.id, r.elevation, r.idx, r.distance) for r in one.select("id", "t.*").collect()} == {(1, 5.0, 1, 10.0), (2, 3.0, 1, 10.0), (3, -90.0, None, None), (4, -7.0, 0, 0.0)}


def test_geodesics_leave_rows_that_are_found(monkeypatch):
    seen = []
    for name in ("_arrive", "_length"):
        monkeypatch.setattr(geodesic, name, lambda *a, f=getattr(geodesic, name), n=name: seen.append((n, len(a[0]))) or f(*a))
    n = 1000
    rng = np.random.default_rng(3)
    lon = rng.uniform(-80, 80, n)
    geodesic.inverse(np.zeros(n), lon, np.zeros(n), lon + 40)
    assert sum(k for f, k in seen if f == "_arrive") <= 3 * n  # the equator is known
    seen.clear()
    distance, azimuth = geodesic.inverse(rng.uniform(-60, 60, n), lon, rng.uniform(-60, 60, n), lon + rng.uniform(-170, 170, n))
    assert sum(k for f, k in seen if f == "_arrive") < 60 * n
    seen.clear()
    geodesic.direct(np.full(n, 30.0), lon, azimuth, distance)
    assert sum(k for f, k in seen if f == "_length") <= 5 * n


def test_equal_places_and_outlines_are_met_once(spark, monkeypatch):
    seen = []
    within = places.near_segments
    monkeypatch.setattr(places, "near_segments", lambda p, e, *a: seen.append((p.count(), e.count())) or within(p, e, *a))
    points = spark.range(40).selectExpr("id AS key", "35D + id % 2 AS lat", "135D AS lon")
    ways = spark.range(60).selectExpr("'way' AS type", "id", "array(struct(35D + id % 3 AS lat, 134.99D AS lon), struct(35D + id % 3 AS lat, 135.01D AS lon)) AS geometry")
    found = places.near_points(points, ways, 100.0).collect()
    assert seen == [(2, 3)]
    assert {(r.key, r.id) for r in found} == {(k, w) for k in range(40) for w in range(60) if k % 2 == w % 3} and len(found) == 800

"""Queries over small tables made for one case each, against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenplan.queries import ORACLE_SQL, QUERIES

from test_queries import normal

EVENTS = {"event_id": "int64", "ts": "datetime64[us]", "user_id": "int64", "event_type": "str", "value": "float64"}


@pytest.fixture
def agree(spark, tmp_path):
    """Check that a query gives its SQL's rows over tables given as lists of dicts; returns the rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, rows in tables.items():
            pd.DataFrame(rows).to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us", index=False)
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
        got, expected = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
        a, b = normal(got), normal(expected)
        assert len(a) == len(b) and a.equals(b)
        return got

    return run


def event(k, seconds=0.0, user=1, kind="view", value=0.0):
    return {"event_id": k, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=seconds), "user_id": user, "event_type": kind, "value": value}


def test_equal_gaps_give_the_first_band(agree):
    # gaps of 119.98, 119.98 and 120.04 degrees, and for the other user twice the same one but for the last bits
    values = {1: [0.1, 17.24, 34.38], 2: [0.07, 25.81, 26.0, 51.55]}
    rows = [event(i, user=u, value=v) for u, own in values.items() for i, v in enumerate(own)]
    rows += [event(100 + 7 * u + i, user=u + 10, value=(u * 0.01 + i * 90 / 7)) for u in range(40) for i in range(4)]
    rows += [event(1000 + 7 * u + i, user=u + 100, value=round(u * 0.01 + i * 9.01, 2)) for u in range(300) for i in range(5)]
    agree("circular_band", events=rows)


def test_the_closest_of_a_run_by_the_rank_of_the_sql(agree):
    # 10 millionths of a degree lower, but 20 000 numbers later
    rows = [event(0, value=100.51), event(20_000, value=100.5), event(20_001, value=300.0), event(20_002, value=1.0), event(20_003, value=200.0), event(20_004, value=199.0)]
    got = agree("inframe_islands", events=rows)
    assert sorted(got["closest"]) == [0, 20_004]


def test_nearest_in_time_makes_no_pairs(agree, spark, tmp_path):
    # slots' ends, ties, equal times and a gap longer than the tolerance
    seconds = [0, 1, 1, 2700, 5399, 5400, 5401, 8100, 10800, 10800, 16200, 40000, 45400, 45401, 50801]
    rows = [event(i, s, kind="a" if i % 3 == 0 else "b") for i, s in enumerate(seconds)]
    rows += [event(100 + i, s, kind="a") for i, s in enumerate([0, 10800, 5400.5, 45399])] + [event(200 + i, 90 * i, kind="b") for i in range(300)]
    agree("weather_asof_nearest", events=rows)


def test_many_events_of_one_slot_are_not_paired(spark):
    from lumenplan.operators import joins

    at = lambda c: F.timestamp_micros(F.col("id") * c + 5_400_000_000)
    left, right = spark.range(60_000).select("id", at(7).alias("t")), spark.range(60_000).select(F.col("id").alias("r"), at(7).alias("at"))
    got = joins.nearest_in_time(left, right, "t", "at", 5400)
    assert got.where("id = r").count() == 60_000  # as pairs 3.6 billion


@pytest.fixture
def plane():
    """Customers and suppliers as dense on the queries' plane as in a gigabyte, by keys near a few of them."""
    spot = lambda k: (k * 7919 % 100003, k * 104729 % 100019)
    near = [k for k in range(400_000) if all(abs(a - 50_000) < 9_000 for a in spot(k))]
    return {"customer": [{"c_custkey": k} for k in near[::97]], "supplier": [{"s_suppkey": k} for k in near[::9]] + [{"s_suppkey": k} for k in range(60)]}


@pytest.mark.parametrize("name", ["ray_corridor", "nearby_topk", "site_flags", "landmark_anti_union"])
def test_radius_queries_among_many_places(agree, plane, name):
    agree(name, **plane)


def test_pairs_are_dealt_over_tasks_of_their_own(spark):
    from lumenplan.operators import joins, lineage

    points = spark.range(400).selectExpr("id", "id % 20 * 500.0 AS x", "id div 20 * 500.0 AS y").coalesce(1)
    pairs = joins.within_radius(points, points.selectExpr("id AS other", "x AS px", "y AS py").coalesce(1), 1000.0)
    assert pairs.rdd.getNumPartitions() == lineage.tasks(points)  # Spark deals so few bytes to one
    assert pairs.count() == sum((a % 20 - b % 20) ** 2 + (a // 20 - b // 20) ** 2 <= 4 for a in range(400) for b in range(400))


def test_nearest_places_make_few_pairs(spark, monkeypatch):
    from lumenplan.operators import joins

    made = []
    within = joins.within_radius
    monkeypatch.setattr(joins, "within_radius", lambda *a, **k: made.append(within(*a, **k)) or made[-1])
    points = spark.range(300).selectExpr("id", "id * 13 % 100 * 100D AS x", "id * 29 % 100 * 100D AS y")
    places = spark.range(20_000).selectExpr("id AS p", "id * 7919 % 9973 * 1D AS px", "id * 4441 % 9967 * 1D AS py")
    far = spark.createDataFrame([(-1, 19000.0, 5000.0), (-2, 50000.0, 5000.0)], "id long, x double, y double")
    top = joins.nearest_places(points.union(far), places, "id", "p", 10000.0, 3)
    got = [(r.id, r.place, r.metres, r.p) for r in top.orderBy("id", "place").collect()]
    assert sum(m.where("id >= 0").count() for m in made) < 300 * 200  # of six million at most
    p = [(r.p, r.px, r.py) for r in places.collect()]
    expected = []
    for q in points.union(far).orderBy("id").collect():
        own = sorted((int(((a - q.x) ** 2 + (b - q.y) ** 2) ** 0.5 + 0.5), k) for k, a, b in p if (a - q.x) ** 2 + (b - q.y) ** 2 <= 1e8)
        expected += [(q.id, i + 1, m, k) for i, (m, k) in enumerate(own[:3])]
    assert got == expected
    met = {r.id for r in joins.any_within(points.union(far), places, "id", 10000.0).collect()}
    assert met == {*range(300), -1}


def test_refraction_in_air_of_any_state(agree):
    # above 70 and below -100 degrees, from 600 to 1500 hPa, negative humidity, a missing value or user
    values = [799.99, 800.0, 800.01, 861.37, -900.0, -900.01, -1200.5, 0.0, 560.21, None]
    rows = [event(k * 1009 + 3, user=u, value=v) for k, (v, u) in enumerate((v, u) for v in values for u in (0, 79, -79, None))]
    rows += [event(-7 - k, user=k, value=20.0 + 10 * k) for k in range(100)]
    agree("refraction_bennett", events=rows)

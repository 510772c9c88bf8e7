"""Polygons by quadtree cells and lines by the cells they pass, against plain geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenplan.operators import cells, joins
from lumenplan.sources import places

RING = "zone string, ring array<struct<lat:double,lon:double>>"


def star(lat, lon, radius, points, spikes=7, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 2 * np.pi, points, endpoint=False)
    r = radius * (1 + 0.4 * np.sin(spikes * turn) + 0.05 * rng.random(points))
    ring = [(float(lat + a), float(lon + b)) for a, b in zip(r * np.sin(turn), r * np.cos(turn))]
    return [*ring, ring[0]]


def contains(ring, y, x):
    odd = False
    for (ay, ax), (by, bx) in zip(ring, ring[1:]):
        odd ^= ((ay > y) != (by > y)) and (bx - ax) * (y - ay) / (by - ay) + ax > x
    return odd


RINGS = {
    "large": star(5, 10, 60, 900), "coast": star(35, 135, 4, 4000, 40, 1), "small": star(35.2, 135.1, 0.0004, 30, 3, 2), "south": star(-40, -170, 9, 200, 5, 3),
    "box": [(30.0, 130.0), (30.0, 140.0), (40.0, 140.0), (40.0, 130.0), (30.0, 130.0)],
    "bow": [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)], "line": [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)],
}


def test_polygons_equal_the_ray_test(spark):
    rng = np.random.default_rng(5)
    places_ = [(-90 + 180 * a, -180 + 360 * b) for a, b in rng.random((400, 2))] + [(float(p), float(q)) for p, q in rng.normal([35.2, 135.1], [3, 3], (400, 2))]
    places_ += [(float(p), float(q)) for p, q in rng.normal([35.2, 135.1], 0.0004, (200, 2))] + [(float(a), float(b)) for a in range(28, 43) for b in range(128, 143)] + RINGS["coast"][:50] + RINGS["bow"]
    places_ = [(float(a), float(b)) for a, b in places_]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(places_)] + [(-1, None, 3.0)], "key long, lat double, lon double")
    polygons = spark.createDataFrame([(z, r) for z, r in RINGS.items()] + [("none", None), ("empty", [])], RING)
    got = {(r.key, r.zone) for r in joins.in_polygon(points, polygons, "lat", "lon").collect()}
    assert got == {(k, z) for k, (y, x) in enumerate(places_) for z, r in RINGS.items() if len(r) >= 4 and contains(r, y, x)}


def test_cells_follow_the_border():
    def made(ring):
        a = np.array(ring)
        return cells.ring_cells(a[:, 0], a[:, 1])

    for name in ("large", "coast"):
        found = made(RINGS[name])
        assert max(len(c[-1]) for c in found if c[3]) <= cells.EDGES
        assert len(found) < 2 * len(RINGS[name])
    assert len(made(RINGS["small"])) <= 9
    # more edges on the same outline: cells grow with the border, not with the area
    turn = np.linspace(0, 2 * np.pi, 8001)
    few, many = (made(list(zip(50 * np.sin(turn[::k]), 50 * np.cos(turn[::k])))) for k in (8, 1))
    assert len(few) < 200 and len(many) < 3000


def haversine_free(py, px, geometry):
    """Plane distance in local metres, as the operator measures."""
    k = 111320.0
    pts = [((x - px) * k * np.cos(np.radians(py)), (y - py) * k) for y, x in geometry]
    best = min(np.hypot(*p) for p in pts)
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        s = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if s == 0 else min(1, max(0, -(ax * (bx - ax) + ay * (by - ay)) / s))
        best = min(best, np.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
    return best


@pytest.mark.parametrize("lat", [35.0, -71.5])
def test_near_points_equal_all_pairs(spark, lat):
    rng = np.random.default_rng(8)
    shapes = []
    for k in range(60):
        n = int(rng.integers(1, 6))
        path = np.cumsum(np.vstack([[[lat, 135.0]] + rng.normal(0, 0.01, (1, 2)), rng.normal(0, 0.008, (n, 2))]), axis=0)
        shapes.append([tuple(map(float, p)) for p in path[: n + (k % 2)]])
    shapes += [star(lat, 135.0, 0.02, 40), star(lat, 135.01, 0.0005, 12), [(lat - 0.05, 134.9), (lat + 0.05, 135.1)]]
    elements = places.with_bounds(spark.createDataFrame(
        [("way", k, None, None, None, s, {"name": str(k)}) for k, s in enumerate(shapes)],
        "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, geometry array<struct<lat:double,lon:double>>, tags map<string,string>"))
    asked = [(k, lat + float(a), 135.0 + float(b)) for k, (a, b) in enumerate(rng.normal(0, 0.012, (80, 2)))]
    rows = places.near_points(spark.createDataFrame(asked, "key long, lat double, lon double"), elements, 300.0).collect()
    got = {(r.key, r.id): (r.distance, r.inside) for r in rows}
    assert len(got) == len(rows) and {r.tags["name"] for r in rows} == {str(r.id) for r in rows}
    expected = {}
    for k, y, x in asked:
        for i, s in enumerate(shapes):
            inside = len(s) >= 4 and s[0] == s[-1] and contains(s, y, x)
            d = haversine_free(y, x, s)
            if d <= 299 or inside:
                expected[k, i] = (d, inside)
    assert set(expected) <= set(got) and all(got[p][0] <= 301 or got[p][1] for p in got)
    assert all(got[p][1] == expected[p][1] and got[p][0] == pytest.approx(expected[p][0], rel=5e-3) for p in expected)


def test_a_long_coast_costs_its_length(spark):
    # a thousand kilometres across the grid in ten thousand steps, at cells of 240 m
    n = 10_000
    coast = [(30.0 + 9.0 * k / n, 130.0 + 7.0 * k / n + 0.001 * (k % 2)) for k in range(n)]
    rows = [(a[0], a[1], b[0], b[1]) for a, b in zip(coast, coast[1:])]
    spread = cells.line_cells(spark.createDataFrame(rows, "alat double, alon double, blat double, blon double"), 120.0 / places.METRES_A_DEGREE * 2)
    assert spread.select("_cx", "_cy").distinct().count() < 20_000  # the bounds hold more than ten million
    upright = cells.line_cells(spark.createDataFrame([(0.5, 3.5, 9.5, 3.5), (2.5, 0.5, 2.5, 4.5), (1.5, 1.5, 1.5, 1.5)], "alat double, alon double, blat double, blon double"), 1.0)
    assert sorted((r._cx, r._cy) for r in upright.collect()) == sorted([(3, k) for k in range(10)] + [(k, 2) for k in range(5)] + [(1, 1)])

"""Golden values and edge cases of the functions."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenplan.functions import earth, features, optics, policy, rasters, sky, text, zoned
from lumenplan.functions.geodesic import direct, geodesic_inverse, inverse


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def lit(*vs):
    return [F.lit(float(v)) for v in vs]


GEODESICS = [
    (35.183, 136.857, 35.184, 136.859, 213.2924484060868, 58.65715047893593),
    (35.1815, 136.9066, 35.6812, 139.7671, 265591.87388393166, 77.12488365196589),
    (35, 179.9, 35, -179.9, 18257.63087971887, 89.94264231710821),
    (0, 0, 0.5, 179.5, 19936288.578965314, 25.67187286829187),
]


def test_geodesics():
    g = np.array(GEODESICS)
    d, a = inverse(*g[:, :4].T)
    assert np.abs(d - g[:, 4]).max() < 1e-6
    assert np.abs(a - g[:, 5]).max() < 1e-8
    lat, lon = direct(g[:, 0], g[:, 1], g[:, 5], g[:, 4])
    assert np.abs(lat - g[:, 2]).max() < 1e-11
    assert np.abs((lon - g[:, 3] + 180) % 360 - 180).max() < 1e-11
    d, a = inverse([0.0, 10.0], [0.0, 20.0], [0.0, 10.0], [180.0, 20.0])
    assert abs(d[0] - 20003931.458625447) < 1e-4
    assert (d[1], a[1]) == (0, 0)


def test_geodesic_column(spark):
    row = value(spark, geodesic_inverse(*lit(*GEODESICS[0][:4])))
    assert row.distance == pytest.approx(GEODESICS[0][4], abs=1e-6)


@pytest.mark.parametrize("aspect,size", [(1.5, (36, 24)), (1.0, (24, 24)), (2.0, (36, 18))])
def test_sensor(spark, aspect, size):
    assert tuple(value(spark, optics.sensor(F.lit(aspect)))) == size


def test_field_of_view(spark):
    f = value(spark, optics.fields_of_view(*lit(35, 1.5)))
    assert f.h == pytest.approx(54.43222311461495, abs=1e-9)
    assert f.v == pytest.approx(37.84928883210247, abs=1e-9)


def test_frame_rule(spark):
    cam = optics.camera(*lit(0, 0))
    inside = lambda az: value(spark, optics.project(optics.direction(*lit(az, 0)), cam, *lit(60, 40))).inside
    assert inside(0) and not inside(31)
    behind = value(spark, optics.project(optics.direction(*lit(180, 0)), cam, *lit(60, 40)))
    assert not behind.front and behind.x is None


def test_projection_and_back(spark):
    cam = optics.camera(*lit(200, 10))
    p = optics.project(optics.direction(*lit(210, 15)), cam, *lit(60, 40))
    back = value(spark, optics.horizontal(optics.unproject(p["x"], p["y"], cam, *lit(60, 40))))
    assert back.azimuth == pytest.approx(210, abs=1e-9)


def test_refraction(spark):
    assert value(spark, sky.weather_refraction(*lit(0, 10, 50, 1010))) == pytest.approx(0.48192392443137894, abs=1e-12)
    assert value(spark, sky.weather_refraction(*lit(0, 10, 150, 1010))) is None
    assert value(spark, sky.weather_refraction(*lit(-2, 10, 50, 1010))) == 0


def test_sun_and_moon(spark):
    # horizontal places that follow from published screen positions; the series are good to some hundredths of a degree
    at = F.to_timestamp(F.lit("2026-03-20 03:00:00"))
    sun = value(spark, sky.sun_horizon(at, *lit(35.681236, 139.767125)))
    assert sun.azimuth == pytest.approx(184.907, abs=0.03)
    assert sun.altitude == pytest.approx(54.0235, abs=0.02)
    moon = value(spark, sky.moon_horizon(at, *lit(35.681236, 139.767125), 10.0))
    assert moon.azimuth == pytest.approx(161.588, abs=0.1)
    assert moon.altitude == pytest.approx(60.759, abs=0.1)
    diameter = value(spark, optics.angular_diameter(F.lit(sky.SUN_RADIUS_KM), sky.sun_equatorial(sky.days_since_j2000(at))["km"]))
    assert diameter == pytest.approx(0.5351792761197687, abs=1e-3)
    assert value(spark, optics.angular_diameter(F.lit(sky.MOON_RADIUS_KM), F.lit(moon.km))) == pytest.approx(0.5464836128806364, abs=2e-3)
    pole = value(spark, sky.star_horizon(at, *lit(35.681236, 139.767125), sky.POLARIS))
    assert abs(pole.altitude - 35.68) < 1


@pytest.mark.parametrize("body,terrain,status", [(10.01, 10, "uncertain"), (10.02, 10, "visible"), (9.98, 10, "obstructed"), (10.015, 10, "uncertain")])
def test_occlusion(spark, body, terrain, status):
    assert value(spark, policy.occlusion(*lit(body, terrain))) == status


@pytest.mark.parametrize("state,reason,hidden", [("checking", "terrain", False), ("failed", "building-or-surface", False), ("dem-only", "terrain", True), ("dem-and-google-3d", "below-horizon", True)])
def test_hidden(spark, state, reason, hidden):
    assert value(spark, policy.confirmed_hidden(F.lit(state), F.lit(reason))) is hidden


def test_quota(spark):
    before = [value(spark, policy.quota_before(F.lit(n), F.lit(True), F.lit(True))) for n in (799, 800, 849, 850)]
    assert [(q.allowed, q.warn) for q in before] == [(True, False), (True, True), (True, True), (False, False)]
    assert value(spark, policy.quota_after(F.lit(850), F.lit(True), F.lit(True))).allowed
    assert value(spark, policy.quota_before(F.lit(1), F.lit(False), F.lit(True))).reason == "service_disabled"
    keys = [value(spark, zoned.stamp(F.to_timestamp(F.lit(t)), "America/Los_Angeles", "yyyy-MM")) for t in ("2026-09-01 06:59:59", "2026-09-01 07:00:00")]
    assert keys == ["2026-08", "2026-09"]


def test_curvature(spark):
    assert value(spark, earth.effective_radius()) == pytest.approx(7322998.62, abs=2)
    assert 680 < value(spark, earth.curvature_drop(F.lit(100000.0))) < 690
    assert 0.05 < value(spark, earth.terrestrial_refraction(F.lit(100000.0))) < 0.07
    assert value(spark, earth.elevation_for_height(*lit(5, 0))) == 90


@pytest.mark.parametrize(
    "wall,zone,instant",
    [("2026-03-08 02:30:00", "America/New_York", "2026-03-08 06:30:00"), ("2026-03-29 02:30:00", "Europe/Berlin", "2026-03-29 01:30:00"),
     ("2026-10-25 02:30:00", "Europe/Berlin", "2026-10-25 01:30:00"), ("2026-11-01 01:30:00", "America/New_York", "2026-11-01 05:30:00")],
)
def test_clock_changes(spark, wall, zone, instant):
    got = value(spark, F.date_format(zoned.to_instant(F.to_timestamp(F.lit(wall)), zone), "yyyy-MM-dd HH:mm:ss"))
    assert got == instant


def test_time_range(spark):
    inside = lambda m, a, b: value(spark, zoned.in_time_range(F.lit(m), F.lit(a), F.lit(b)))
    assert inside(0, 1320, 360) and inside(1320, 1320, 360) and not inside(700, 1320, 360)
    assert value(spark, zoned.text_minute(F.lit("25:00"))) == 0


def grid(rows):
    return [[F.lit(None if v is None else float(v)).cast("double") for v in row] for row in rows]


def test_bicubic(spark):
    plane = [[x + y for x in range(4)] for y in range(4)]
    assert value(spark, rasters.constrained_bicubic(grid(plane), *lit(0.5, 0.5))) == pytest.approx(3)
    assert value(spark, rasters.constrained_bicubic(grid([[10] * 4] * 4), *lit(0.3, 0.7))) == pytest.approx(10)
    cliff = [[0, 0, 100, 100]] * 4
    assert 0 <= value(spark, rasters.constrained_bicubic(grid(cliff), *lit(0.9, 0.5))) <= 100
    hole = [[0, 0, 0, 0], [0, 10, 20, 0], [0, 10, 20, 0], [0, 0, 0, None]]
    assert value(spark, rasters.neighbourhood_height(grid(hole), *lit(0.5, 0.5))) == pytest.approx(15)
    assert value(spark, rasters.bilinear(*[F.lit(v).cast("double") for v in (20.0, None, 5.0, 6.0)], *lit(0.2, 0.2))) == 20
    assert value(spark, rasters.bilinear(*[F.lit(None).cast("double")] * 4, *lit(0.2, 0.2))) is None


@pytest.mark.parametrize("pixel,tile,inside", [(-1, -1, 255), (0, 0, 0), (255, 0, 255), (256, 1, 0), (257, 1, 1)])
def test_neighbour(spark, pixel, tile, inside):
    assert tuple(value(spark, rasters.neighbour(F.lit(pixel)))) == (tile, inside)


def png(pixels, filters):
    h, w, c = pixels.shape
    raw, above = b"", np.zeros((w, c), int)
    for y in range(h):
        line, f = pixels[y].astype(int), filters[y % len(filters)]
        left = np.vstack([np.zeros((1, c), int), line[:-1]])
        corner = np.vstack([np.zeros((1, c), int), above[:-1]])
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][f]
        raw += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (10, 7, channels), dtype=np.uint8)
    assert (rasters.decode_png(png(pixels, [0, 1, 2, 3, 4])) == pixels).all()


def test_elevation_pixels(spark):
    got = [value(spark, rasters.elevation_cm(*[F.lit(v) for v in rgb])) for rgb in ((0, 1, 0), (128, 0, 0), (255, 255, 255))]
    assert got == [256, None, -1]
    assert rasters.pixels_to_cm(np.array([[[128, 0, 0], [0, 1, 0]]], np.uint8)).tolist() == [[rasters.NO_DATA_CM, 256]]


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_ray(spark):
    ahead = value(spark, features.ray_approach(points((-5, 100), (5, 100), (5, 110), (-5, 110), (-5, 100)), F.lit(0.0)))
    assert 95 < ahead.along < 108 and ahead.off < 1
    assert value(spark, features.ray_approach(points((-5, -100), (5, -100)), F.lit(0.0))) is None


def test_shapes(spark):
    square = points((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    assert value(spark, features.contains_origin(square))
    assert not value(spark, features.contains_origin(points((-1, -1), (1, -1), (1, 1), (-1, 1))))
    assert value(spark, features.distance_to(points((3, 4)))) == 5
    assert value(spark, features.distance_to(points((-10, 2), (10, 2)))) == 2


def test_heights(spark):
    tags = lambda **t: F.create_map(*[F.lit(v) for p in t.items() for v in p])
    height = lambda t: value(spark, features.obstacle_height(t))
    assert height(tags(building="yes", height="12.5 m")) == 12.5
    assert height(F.create_map(*[F.lit(v) for v in ("building", "yes", "building:levels", "4")])) == 12
    assert height(tags(building="yes", height="40 ft")) is None
    assert height(tags(natural="tree_row")) == 9
    kind = lambda **t: value(spark, features.landmark_type(tags(**t)))
    assert kind(man_made="mast") == "communications-mast"
    assert kind(building="shrine") == "shrine"
    assert kind(building="yes", historic="castle") == "historic-building"
    assert kind(building="yes") is None


@pytest.mark.parametrize("typed,mm", [("9", 9), ("40", 40), ("24.5", 24.5), ("1600", 1600), ("５０", 50), ("", None), ("8.999", None), ("1600.001", None), ("abc", None), ("Infinity", None)])
def test_focal_length(spark, typed, mm):
    assert value(spark, text.focal_length(F.lit(typed))) == mm


def test_links(spark):
    place = lambda u: value(spark, text.decoded_place(text.decode_link(F.lit(u))))
    for u in ("https://www.google.com/maps/@35.4339171,136.782051,17z", "https://maps.google.com/?q=35.4339171,136.782051",
              "https://www.google.com/maps/place/X/@1,2,17z/data=!3m1!3d35.4339171!4d136.782051", "https://www.google.com/maps/search/?api=1&amp;query=35.4339171%252C136.782051"):
        assert tuple(place(u)) == (35.4339171, 136.782051)
    assert place("https://www.google.com/maps") is None
    ids = value(spark, text.link_ids(F.lit("https://www.google.com/maps/place/A+B/data=!1s0x6018:0xff")))
    assert (ids.cid, ids.name) == ("255", "A B")
    assert value(spark, text.is_map_link(F.lit("https://evil.example/maps"))) is False


def test_place_queries(spark):
    got = value(spark, text.place_queries(F.lit("〒500-8000 岐阜市  金華山 城")))
    assert got == ["〒500-8000 岐阜市 金華山 城", "岐阜市 金華山 城", "城", "金華山 城"]


def test_share_code(spark):
    assert value(spark, text.share_decode(F.lit("e30"))) is None
    assert value(spark, text.share_decode(F.lit("%%%"))) is None


def test_validation(spark):
    assert not value(spark, policy.valid(F.lit(float("nan")), "latitude"))
    assert not value(spark, policy.valid(F.lit(180.0), "fov"))
    assert value(spark, policy.valid(F.lit(-90.0), "latitude"))
    good, bad = policy.quarantine(spark.createDataFrame([(1.0, 2.0), (99.0, 2.0)], "a double, b double"), {"a": "latitude", "b": "longitude"})
    assert good.count() == 1 and bad.first().failed == ["a"]
    with pytest.raises(Exception, match="above the most"):
        value(spark, policy.distance_range(*lit(5000, 100)))
    assert math.isclose(value(spark, policy.setting(F.lit("x").try_cast("double") if hasattr(F.lit("x"), "try_cast") else F.lit(None).cast("double"), 5.0, 0.0, 9.0)), 5.0)

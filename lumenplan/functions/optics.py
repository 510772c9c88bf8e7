"""Camera fields of view, pinhole projection and frame tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import acosd, asind, col, cosd, sind, tand, wrap360

FRAME_WIDTH, FRAME_HEIGHT = 36.0, 24.0


def sensor(aspect) -> Column:
    """Width and height in mm of the largest part of a 36 x 24 frame with an aspect ratio."""
    a = col(aspect)
    wide = a >= F.lit(FRAME_WIDTH / FRAME_HEIGHT)
    return F.struct(
        F.when(wide, F.lit(FRAME_WIDTH)).otherwise(F.lit(FRAME_HEIGHT) * a).alias("width"),
        F.when(wide, F.lit(FRAME_WIDTH) / a).otherwise(F.lit(FRAME_HEIGHT)).alias("height"),
    )


def field_of_view(size_mm, focal_mm) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(col(size_mm) / (F.lit(2.0) * col(focal_mm))))


def fields_of_view(focal_mm, aspect) -> Column:
    s = sensor(aspect)
    return F.struct(field_of_view(s["width"], focal_mm).alias("h"), field_of_view(s["height"], focal_mm).alias("v"))


def direction(azimuth, altitude) -> Column:
    """East, north, up parts of a direction."""
    return F.struct(
        (cosd(altitude) * sind(azimuth)).alias("x"), (cosd(altitude) * cosd(azimuth)).alias("y"), sind(altitude).alias("z")
    )


def horizontal(v: Column) -> Column:
    """Azimuth and altitude of a direction."""
    return F.struct(wrap360(F.degrees(F.atan2(v["x"], v["y"]))).alias("azimuth"), asind(v["z"]).alias("altitude"))


def camera(azimuth, altitude) -> Column:
    """Forward, right and up directions of a camera without roll."""
    zero = F.lit(0.0)
    return F.struct(
        direction(azimuth, altitude).alias("forward"),
        F.struct(cosd(azimuth).alias("x"), (-sind(azimuth)).alias("y"), zero.alias("z")).alias("right"),
        F.struct((-sind(azimuth) * sind(altitude)).alias("x"), (-cosd(azimuth) * sind(altitude)).alias("y"), cosd(altitude).alias("z")).alias("up"),
    )


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def project(v: Column, cam: Column, h_fov, v_fov) -> Column:
    """Per cent of the frame from the top left corner; what is behind has null places."""
    forward = dot(v, cam["forward"])
    front = forward > F.lit(1e-8)
    safe = F.when(front, forward)
    x = F.lit(50.0) + F.lit(50.0) * dot(v, cam["right"]) / safe / tand(col(h_fov) / 2)
    y = F.lit(50.0) - F.lit(50.0) * dot(v, cam["up"]) / safe / tand(col(v_fov) / 2)
    return F.struct(x.alias("x"), y.alias("y"), front.alias("front"), F.coalesce(x.between(0, 100) & y.between(0, 100), F.lit(False)).alias("inside"))


def unproject(x, y, cam: Column, h_fov, v_fov) -> Column:
    """The direction (not normalised) seen at a place of the frame."""
    px, py = (col(x) - 50) / 50 * tand(col(h_fov) / 2), (col(y) - 50) / 50 * tand(col(v_fov) / 2)
    f, r, u = cam["forward"], cam["right"], cam["up"]
    return F.struct(*[(f[k] + px * r[k] - py * u[k]).alias(k) for k in "xyz"])


def angular_distance(a: Column, b: Column) -> Column:
    """Degrees between two unit directions."""
    return acosd(dot(a, b))


def angular_diameter(radius_km, distance_km) -> Column:
    r = col(radius_km)
    return F.lit(2.0) * asind(r / F.greatest(r, col(distance_km)))


def disc_percent(diameter, fov) -> Column:
    """Per cent of a frame side that a disc takes."""
    return F.lit(100.0) * tand(col(diameter) / 2) / tand(col(fov) / 2)


def point_in_frame(projected: Column, altitude) -> Column:
    return projected["inside"] & (col(altitude) > -1)


def disc_in_frame(projected: Column, altitude, diameter, h_fov, v_fov, vertical_diameter=None) -> Column:
    """True if any part of the disc is in the frame and above -1 degree."""
    w = disc_percent(diameter, h_fov) / 2
    h = disc_percent(diameter if vertical_diameter is None else vertical_diameter, v_fov) / 2
    x, y = projected["x"], projected["y"]
    return F.coalesce(
        projected["front"] & (col(altitude) + col(diameter) / 2 > -1) & (x + w >= 0) & (x - w <= 100) & (y + h >= 0) & (y - h <= 100), F.lit(False)
    )


def frame_series(azimuth, altitude, diameter, bearing, elevation, h_fov, v_fov) -> tuple[np.ndarray, np.ndarray]:
    """In numpy: whether any of a disc (of no size for a star) is in the frame, and its distance from the middle in degrees."""
    az, alt, b, e = (np.radians(v) for v in (azimuth, altitude, bearing, elevation))
    x, y, z = np.cos(alt) * np.sin(az), np.cos(alt) * np.cos(az), np.sin(alt)
    forward = x * (np.cos(e) * np.sin(b)) + y * (np.cos(e) * np.cos(b)) + z * np.sin(e)
    right = x * np.cos(b) - y * np.sin(b)
    up = -x * (np.sin(b) * np.sin(e)) - y * (np.cos(b) * np.sin(e)) + z * np.cos(e)
    half_h, half_v, half_disc = np.tan(np.radians(h_fov) / 2), np.tan(np.radians(v_fov) / 2), np.tan(np.radians(diameter) / 2)
    safe = np.where(forward > 1e-8, forward, np.nan)
    seen = (np.abs(right / safe) <= half_h + half_disc) & (np.abs(up / safe) <= half_v + half_disc) & (altitude + diameter / 2 > -1)
    return seen, np.degrees(np.arccos(np.clip(forward, -1, 1)))


def preview_distance(x1, y1, x2, y2, subject_distance, h_fov, v_fov) -> Column:
    """Metres between two places of the frame, both taken on the plane at the subject."""
    w = F.lit(2.0) * col(subject_distance) * tand(col(h_fov) / 2)
    h = F.lit(2.0) * col(subject_distance) * tand(col(v_fov) / 2)
    dx, dy = (col(x2) - col(x1)) / 100 * w, (col(y2) - col(y1)) / 100 * h
    return F.sqrt(dx * dx + dy * dy)


def person_box(height_m, distance_m, h_fov, v_fov, aspect: float = 0.4) -> Column:
    """Width and height in per cent of the frame of a standing person."""
    h = F.lit(100.0) * col(height_m) / (F.lit(2.0) * col(distance_m) * tand(col(v_fov) / 2))
    w = F.lit(100.0 * aspect) * col(height_m) / (F.lit(2.0) * col(distance_m) * tand(col(h_fov) / 2))
    return F.struct(w.alias("width"), h.alias("height"))


def clip_segment(x1, y1, x2, y2, low: float = 0.0, high: float = 100.0) -> Column:
    """The part of a segment inside the square frame, by its entering and leaving parameter; null if none."""
    x1, y1 = col(x1), col(y1)
    dx, dy = col(x2) - x1, col(y2) - y1
    enter, leave, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x1 - low), (dx, F.lit(high) - x1), (-dy, y1 - low), (dy, F.lit(high) - y1)):
        t = F.try_divide(q, p)
        enter = F.when(p < 0, F.greatest(enter, t)).otherwise(enter)
        leave = F.when(p > 0, F.least(leave, t)).otherwise(leave)
        out = out | ((p == 0) & (q < 0))
    return F.when(~out & (enter <= leave), F.struct((x1 + enter * dx).alias("x1"), (y1 + enter * dy).alias("y1"), (x1 + leave * dx).alias("x2"), (y1 + leave * dy).alias("y2")))

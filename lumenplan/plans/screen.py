"""What a camera sees: screen points, daily tracks, the Milky Way band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import optics, sky
from ..functions.angles import clamp
from ..operators.lineage import spread
from ..operators.windows import islands

BODIES = ("sun", "moon", "milkyWay", "polaris")


def body_positions(rows: DataFrame, mode: str = "standard") -> DataFrame:
    """Four rows per row (instant, lat, lon): body, azimuth, altitude, diameter (null for stars), distance."""
    null = F.lit(None).cast("double")
    placed = rows.withColumn("_d", sky.days_since_j2000("instant")).withColumn("_m", sky.moon_horizon("instant", "lat", "lon")).withColumn("_s", sky.sun_equatorial("_d"))
    for name, star in (("_c", sky.GALACTIC_CENTRE), ("_p", sky.POLARIS)):
        placed = placed.withColumn(name, sky.star_equatorial("_d", *star))
    horizon = lambda q: sky.to_horizon(F.col(f"{q}.ra"), F.col(f"{q}.dec"), "_d", "lat", "lon")
    placed = placed.withColumns({"_hs": horizon("_s"), "_hc": horizon("_c"), "_hp": horizon("_p")})
    sun, centre, pole = F.col("_hs"), F.col("_hc"), F.col("_hp")
    one = lambda name, h, diameter, km: F.struct(F.lit(name).alias("body"), h["azimuth"].alias("azimuth"), sky.apparent_altitude(h["altitude"], mode).alias("altitude"), diameter.alias("diameter"), km.alias("km"))
    every = F.array(
        one("sun", sun, optics.angular_diameter(F.lit(sky.SUN_RADIUS_KM), F.col("_s.km")), F.col("_s.km")),
        one("moon", F.col("_m"), optics.angular_diameter(F.lit(sky.MOON_RADIUS_KM), F.col("_m.km")), F.col("_m.km")),
        one("milkyWay", centre, null, null), one("polaris", pole, null, null),
    )
    return placed.withColumn("_b", F.explode(every)).select(*rows.columns, "_b.*")


def screen_points(positions: DataFrame, azimuth: Column, altitude: Column, h_fov: Column, v_fov: Column) -> DataFrame:
    """Positions with place on the screen, size of the disc in per cent and whether any of it is in the frame."""
    p = optics.project(optics.direction(F.col("azimuth"), F.col("altitude")), optics.camera(azimuth, altitude), h_fov, v_fov)
    rows = positions.withColumn("_p", p)
    disc = optics.disc_in_frame(F.col("_p"), F.col("altitude"), F.col("diameter"), h_fov, v_fov)
    return rows.select(
        *positions.columns, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), optics.disc_percent(F.col("diameter"), h_fov).alias("width"),
        optics.disc_percent(F.col("diameter"), v_fov).alias("height"), F.when(F.col("diameter").isNull(), optics.point_in_frame(F.col("_p"), F.col("altitude"))).otherwise(disc).alias("in_frame"),
    )


def track_step(h_fov: Column, v_fov: Column) -> Column:
    """Minutes between the points of a daily track: whole degrees of the shorter side, from 1 to 10."""
    return clamp(F.floor(F.least(h_fov, v_fov)), F.lit(1), F.lit(10)).cast("int")


def daily_tracks(days: DataFrame, step_minutes: Column) -> DataFrame:
    """Positions of the four bodies through every day (start, lat, lon)."""
    micros = F.sequence(F.unix_micros("start"), F.unix_micros("start") + 86_400_000_000, step_minutes.cast("long") * 60_000_000)
    return body_positions(days.withColumn("instant", F.explode(F.transform(micros, lambda t: F.timestamp_micros(t)))))


def visible_segments(track: DataFrame, keys: list[str], least_altitude: float = -1.0) -> DataFrame:
    """Runs of two or more track points above an altitude."""
    return islands(track, keys, "instant", F.col("altitude") >= least_altitude, least=2)


def milky_way_path(rows: DataFrame, azimuth: Column, altitude: Column, h_fov: Column, v_fov: Column, step: int = 5) -> DataFrame:
    """The band every ``step`` degrees of galactic longitude for rows (key, instant, lat, lon), one a key: middle and edges on the screen.

    The three places of a longitude stand in one row, so nothing is grouped or held.
    """
    at = spread(rows).withColumn("longitude", F.explode(F.transform(F.sequence(F.lit(0), F.lit(360), F.lit(max(5, step))), lambda v: v.cast("double"))))
    at = at.withColumn("_n", sky.days_since_j2000("instant")).withColumn("_half", sky.band_half_width(F.col("longitude")))
    parts = {"centre": F.lit(0.0), "upper": F.col("_half"), "lower": -F.col("_half")}
    at = at.withColumns({f"_q_{p}": sky.galactic_equatorial("longitude", v) for p, v in parts.items()})
    at = at.withColumns({f"_h_{p}": sky.to_horizon(F.col(f"_q_{p}.ra"), F.col(f"_q_{p}.dec"), "_n", F.col("lat"), F.col("lon")) for p in parts})
    at = at.withColumns({f"_p_{p}": optics.project(optics.direction(F.col(f"_h_{p}.azimuth"), F.col(f"_h_{p}.altitude")), optics.camera(azimuth, altitude), h_fov, v_fov) for p in parts})
    near = lambda p: F.coalesce(F.col(f"_p_{p}.x").between(-15, 115) & F.col(f"_p_{p}.y").between(-15, 115), F.lit(False))
    seen = (near("centre") | near("upper") | near("lower")) & (F.col("_h_centre.altitude") > -8)
    return at.select(
        "key", "longitude", F.col("_h_centre.altitude").alias("altitude"), *[F.col(f"_p_{p}.{c}").alias(f"{p}_{c}") for p in parts for c in ("x", "y")],
        F.coalesce(seen, F.lit(False)).alias("visible"),
    )

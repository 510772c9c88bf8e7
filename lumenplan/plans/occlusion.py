"""Horizons along a line of sight and the verdict on what hides a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.earth import apparent_elevation, elevation_and_range, elevation_for_height
from ..functions.geodesic import geodesic_direct
from ..functions.policy import occlusion
from ..operators.joins import higher_of
from ..operators.lineage import cut
from ..operators.sampling import disc_edge, log_distances, refined_distances
from ..sources.dem import Sampler, detail_for

COARSE, REFINED, FARTHEST = 112, 48, 160_000.0
NOTHING = -90.0


def highest(profile: DataFrame, keys: list[str], elevation: str = "elevation", order: str = "idx", keep: tuple[str, ...] = ("distance",)) -> DataFrame:
    """Per key the highest elevation of a profile, the first of equal ones."""
    valid = F.col(elevation).isNotNull() & ~F.isnan(elevation)
    return profile.groupBy(*keys).agg(
        F.max_by(F.struct(elevation, order, *keep), F.when(valid, F.struct(F.col(elevation).alias("e"), (-F.col(order)).alias("o")))).alias("top")
    ).select(*keys, F.coalesce(f"top.{elevation}", F.lit(NOTHING)).alias(elevation), f"top.{order}", *[f"top.{k}" for k in keep])


def highest_in(points: Column) -> Column:
    """As ``highest`` for a profile that stands in one row: of an array of (elevation, idx, distance) the highest, the first of equal ones."""
    known = F.filter(points, lambda p: p["elevation"].isNotNull() & ~F.isnan(p["elevation"]))
    top = F.array_max(F.transform(known, lambda p: F.struct(p["elevation"].alias("elevation"), (-p["idx"]).alias("_o"), p["idx"].alias("idx"), p["distance"].alias("distance"))))
    none = F.struct(F.lit(NOTHING).alias("elevation"), F.lit(None).cast("int").alias("_o"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("distance"))
    return F.coalesce(top, none)


def profile(rays: DataFrame, distances: Column) -> DataFrame:
    """Points along rays (key, lat, lon, azimuth): idx, distance and place."""
    rows = rays.select("*", F.posexplode(distances).alias("idx", "distance"))
    return rows.withColumn("_p", geodesic_direct("lat", "lon", "azimuth", "distance")).withColumn("point_lat", F.col("_p.lat")).withColumn("point_lon", F.col("_p.lon")).drop("_p")


def _elevations(points: DataFrame, sampler: Sampler, mode: str) -> DataFrame:
    asks = points.select(F.concat_ws(":", "key", "idx").alias("key"), F.col("point_lat").alias("lat"), F.col("point_lon").alias("lon"), detail_for(F.col("distance")).alias("detail"))
    heights = sampler(asks).select(F.col("key").alias("_k"), F.col("height").alias("ground"))
    rows = points.withColumn("_k", F.concat_ws(":", "key", "idx")).join(heights, "_k").drop("_k")
    seen = elevation_and_range((F.col("lat"), F.col("lon"), F.col("eye")), (F.col("point_lat"), F.col("point_lon"), F.col("ground")))
    return rows.withColumn("_s", seen).withColumn("elevation", apparent_elevation(F.col("_s.elevation"), F.col("_s.range"), mode)).drop("_s")


def terrain_horizon(rays: DataFrame, sampler: Sampler, mode: str = "standard", farthest: float = FARTHEST, coarse: int = COARSE, refined: int = REFINED) -> DataFrame:
    """Highest terrain on rays (key, lat, lon, eye, azimuth): a coarse scan, then a fine one around its maximum.

    The fine result counts only if it is strictly higher.
    """
    distances = log_distances(F.lit(8.0), F.lit(farthest), coarse)
    first = cut(highest(_elevations(profile(rays, distances), sampler, mode), ["key"]))
    around = rays.join(first.select("key", F.col("idx").alias("at")).where("at is not null"), "key")
    second = highest(_elevations(profile(around, refined_distances(distances, F.col("at"), refined)).drop("at"), sampler, mode), ["key"])
    both = first.join(second.select("key", F.col("elevation").alias("fine"), F.col("distance").alias("fine_distance")), "key", "left")
    better = F.coalesce(F.col("fine") > F.col("elevation"), F.lit(False))
    return both.select("key", F.when(better, F.col("fine")).otherwise(F.col("elevation")).alias("elevation"), F.when(better, F.col("fine_distance")).otherwise(F.col("distance")).alias("distance"))


def surface_horizon(obstacles: DataFrame, key: str, eye_above_ground: Column) -> DataFrame:
    """Highest obstacle of a corridor per key; -90 where nothing stands in the way is left to the join."""
    rows = obstacles.withColumn("elevation", elevation_for_height(F.col("obstacle") - eye_above_ground, F.col("along")))
    return highest(rows, [key], "elevation", "id", ("along",)).withColumnRenamed("elevation", "surface_elevation")


def verdict(bodies: DataFrame, terrain: DataFrame, surface: DataFrame) -> DataFrame:
    """Bodies (key, altitude) with horizon, source, status and reason.

    A body at or below 0 is below the horizon; an obstruction counts as terrain or as building or surface
    by the higher horizon; a clearance within the uncertainty is not obstructed.
    """
    horizon = higher_of(terrain.select("key", F.col("elevation").alias("terrain_elevation"), "distance"), surface.select("key", "surface_elevation"), "key")
    rows = bodies.join(horizon, "key", "left")
    status = F.when(F.col("horizon").isNull(), "visible").otherwise(occlusion(F.col("altitude"), F.coalesce("horizon", F.lit(NOTHING)), F.col("distance")))
    rows = rows.withColumn("status", F.when(F.col("altitude") <= 0, "obstructed").otherwise(status))
    reason = F.when(F.col("altitude") <= 0, "below-horizon").when(F.col("status") == "obstructed", F.when(F.col("source") == "surface", "building-or-surface").otherwise("terrain")).otherwise("clear")
    return rows.withColumn("reason", reason)


def mesh_hits(samples: DataFrame, lens: Column) -> DataFrame:
    """Samples with ``obstructed``: a mesh hit beyond the tripod's own surroundings (3 m, or three quarters of the lens height) and before the end."""
    own = F.greatest(F.lit(3.0), lens * F.lit(0.75))
    return samples.withColumn("obstructed", F.coalesce((F.col("hit") > own) & (F.col("hit") < F.coalesce("end_distance", F.lit(float("inf")))), F.lit(False)))


def disc_obstruction(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per body the share of its disc samples that are hidden, the nearest obstruction, and whether all were checked."""
    return samples.groupBy(*keys).agg(
        (F.avg(F.col("obstructed").cast("double")) * 100).alias("obstructed_pct"), F.min(F.when(F.col("obstructed"), F.col("hit"))).alias("nearest"), F.bool_and("verified").alias("verified")
    )


def disc_samples(bodies: DataFrame, radius: Column, edges: int) -> DataFrame:
    return disc_edge(bodies, "azimuth", "altitude", radius, edges)


def mesh_base(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest mesh hit over a place, and whether the base agrees with the terrain to 5 m."""
    return hits.groupBy(*keys).agg(F.min("mesh_height").alias("base"), F.max("mesh_height").alias("roof"), F.first("ground").alias("ground")).withColumn("base_agrees", F.abs(F.col("base") - F.col("ground")) <= 5)

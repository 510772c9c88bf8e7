"""Elevation tiles and geoid heights."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import col
from ..functions.earth import tile
from ..functions.rasters import SOURCES, decode_png, in_coverage, neighbourhood_height, pixels_to_cm, source_allowed
from ..operators.joins import sample_tiles

#: A sampler takes points (key, lat, lon, detail) and gives them ``height`` and ``source``.
Sampler = Callable[[DataFrame], DataFrame]
#: Tasks that the points of one geoid region are dealt to.
SALTS = 16

TILE_SCHEMA = "source string, zoom int, x int, y int, width int, height int, cm array<int>"


def read_png_tiles(spark: SparkSession, root: str) -> DataFrame:
    """Decoded tiles of pictures ``<root>/<source>/<zoom>/<x>/<y>.png``; a missing file is a missing row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root)
    place = r"([^/]+)/([0-9]+)/([0-9]+)/([0-9]+)\.png$"
    part = lambda k: F.regexp_extract("path", place, k)
    named = files.select(part(1).alias("source"), part(2).cast("int").alias("zoom"), part(3).cast("int").alias("x"), part(4).cast("int").alias("y"), "content")

    def decode(batches):
        for pdf in batches:
            pixels = [pixels_to_cm(decode_png(bytes(c))) for c in pdf.content]
            out = pdf.drop(columns="content")
            yield out.assign(width=[p.shape[1] for p in pixels], height=[p.shape[0] for p in pixels], cm=[p.ravel() for p in pixels]) if len(pdf) else pd.DataFrame()

    return named.mapInPandas(decode, TILE_SCHEMA).withColumn("cm", F.transform("cm", lambda v: F.when(v != -2147483648, v)))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Decoded tiles as Parquet, in folders by source and zoom so that a request reads its own only."""
    tiles.repartition("source", "zoom", F.floor(F.col("x") / 64)).write.partitionBy("source", "zoom").mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sample(points: DataFrame, tiles: DataFrame, key: str, lat: str = "lat", lon: str = "lon", detail: str = "detail") -> DataFrame:
    """Points with ``height`` and ``source`` of the best allowed source that has data there; null outside coverage.

    One join per source with the tiles of that source, of the points that may use it.
    """
    rows = points.where(in_coverage(F.col(lat), F.col(lon))).select(key, lat, lon, detail)
    parts = []
    for rank, (source, label, zoom) in enumerate(SOURCES):
        asks = rows.where(source_allowed(F.lit(label), F.col(detail))).withColumn("_t", tile(lat, lon, F.lit(zoom)))
        asks = asks.select(key, F.col("_t.x").alias("tile_x"), F.col("_t.y").alias("tile_y"), "_t.px", "_t.py", "_t.fx", "_t.fy")
        found = sample_tiles(asks, tiles.where((F.col("source") == source) & (F.col("zoom") == zoom)), key)
        grid = [[F.col(f"q_{i}_{j}".replace("-", "m")) for i in (-1, 0, 1, 2)] for j in (-1, 0, 1, 2)]
        parts.append(found.select(key, F.lit(rank).alias("rank"), F.lit(label).alias("source"), neighbourhood_height(grid, "fx", "fy").alias("height")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.where("height is not null").groupBy(key).agg(F.min(F.struct("rank", "source", "height")).alias("b")).select(key, "b.source", "b.height")
    return points.join(best, key, "left")


def detail_for(distance) -> Column:
    """Finest detail worth reading at a distance from the observer."""
    d = col(distance)
    return F.when(d <= 2000, "1m").when(d <= 20000, "5m").otherwise("10m")


def geoid_lookup(points: DataFrame, geoid: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with ``geoid_height`` of their cell of 0.01 degrees; ``geoid`` has (lat, lon, geoid_height)."""
    cell = lambda c: F.floor(F.col(c) * 100 + 0.5)
    table = geoid.select(cell("lat").alias("_a"), cell("lon").alias("_o"), "geoid_height").groupBy("_a", "_o").agg(F.max("geoid_height").alias("geoid_height"))
    return points.withColumn("_a", cell(lat)).withColumn("_o", cell(lon)).join(table, ["_a", "_o"], "left").drop("_a", "_o")


def region_representatives(points: DataFrame, lat: str, lon: str, order: str) -> DataFrame:
    """One request per region of 0.01 degrees: its first point."""
    cell = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    rows = points.withColumn("region_lat", cell(lat)).withColumn("region_lon", cell(lon))
    return rows.groupBy("region_lat", "region_lon").agg(F.min(F.struct(order, lat, lon)).alias("r"), F.count("*").alias("n")).select("region_lat", "region_lon", "n", f"r.{lat}", f"r.{lon}")


def fan_out(points: DataFrame, answers: DataFrame, lat: str, lon: str, key: str, salts: int = SALTS) -> DataFrame:
    """Every point with the answer of its region's representative; null columns where the region has none.

    ``answers`` has region_lat, region_lon and what was answered.  Each region is held ``salts`` times, so
    the points of one crowded region are dealt to as many tasks.
    """
    cell = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    rows = points.withColumn("region_lat", cell(lat)).withColumn("region_lon", cell(lon)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    held = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(held, ["region_lat", "region_lon", "_salt"], "left").drop("region_lat", "region_lon", "_salt")


def with_fallback(points: DataFrame, world: DataFrame, key: str) -> DataFrame:
    """Ellipsoidal heights: sampled height plus geoid, else the world terrain's; ``resolved`` tells which."""
    rows = points.join(world.select(key, F.col("height").alias("world_height")), key, "left")
    local = F.col("height") + F.col("geoid_height")
    return rows.withColumn("ellipsoidal", F.coalesce(local, "world_height")).withColumn("resolved", F.when(local.isNotNull(), "dem").when(F.col("world_height").isNotNull(), "world"))


def required(points: DataFrame) -> DataFrame:
    """The points with ellipsoidal heights from dem and geoid; a missing one stops the query."""
    h = F.col("height") + F.col("geoid_height")
    return points.withColumn("ellipsoidal", F.when(h.isNotNull(), h).otherwise(F.raise_error(F.lit("no height of the highest precision here"))))

"""Hourly weather: reading, climatology, choice of source, lookup."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import finite
from ..operators.joins import nearest_in_time

FIELDS = ("temperature", "humidity", "pressure")
HOURLY_SCHEMA = "hourly struct<time:array<string>, temperature_2m:array<double>, relative_humidity_2m:array<double>, surface_pressure:array<double>>"
TOLERANCE_SECONDS = 90 * 60


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Rows (time, temperature, humidity, pressure) of JSON with parallel arrays, without rows that lack a value."""
    raw = spark.read.schema(HOURLY_SCHEMA).option("multiLine", True).json(path)
    return unpack_hourly(raw)


def unpack_hourly(raw: DataFrame) -> DataFrame:
    h = "hourly"
    zipped = F.arrays_zip(*[F.col(f"{h}.{c}").alias(c) for c in ("time", "temperature_2m", "relative_humidity_2m", "surface_pressure")])
    rows = raw.select(F.explode(zipped).alias("r")).select(
        F.try_to_timestamp("r.time").alias("time"), F.col("r.temperature_2m").alias("temperature"), F.col("r.relative_humidity_2m").alias("humidity"), F.col("r.surface_pressure").alias("pressure")
    )
    return usable(rows)


def usable(samples: DataFrame) -> DataFrame:
    keep = F.col("time").isNotNull()
    for c in FIELDS:
        keep = keep & finite(c)
    return samples.where(keep)


def climatology(samples: DataFrame) -> DataFrame:
    """Mean values by UTC month and hour."""
    return samples.groupBy(F.month("time").alias("month"), F.hour("time").alias("hour")).agg(*[F.avg(c).alias(c) for c in FIELDS])


def last_full_years(samples: DataFrame, now: Column, years: int = 5) -> DataFrame:
    """Samples of the full years before the one of ``now``."""
    return samples.where(F.year("time").between(F.year(now) - years, F.year(now) - 1))


def choose_source(mode: str, start: datetime, end: datetime, now: datetime) -> str:
    """none, standard, forecast (a search within the coming week) or climatology."""
    if mode in ("none", "standard"):
        return mode
    return "forecast" if start >= now - timedelta(seconds=60) and end <= now + timedelta(days=7) else "climatology"


def at_instants(df: DataFrame, samples: DataFrame, time: str, source: str) -> DataFrame:
    """Rows with the weather at their instant: the nearest forecast within 90 minutes, or the climatology; else nulls."""
    if source == "forecast":
        named = samples.select(F.col("time").alias("weather_time"), *FIELDS)
        return nearest_in_time(df, named, time, "weather_time", TOLERANCE_SECONDS)
    if source == "climatology":
        table = climatology(samples)
        keyed = df.withColumn("month", F.month(time)).withColumn("hour", F.hour(time))
        return keyed.join(F.broadcast(table), ["month", "hour"], "left").drop("month", "hour")  # 288 rows at most
    none = F.lit(None).cast("double")
    return df.select("*", *[none.alias(c) for c in FIELDS])

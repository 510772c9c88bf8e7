"""A day's rises and sets, shootable windows, Moon age, rulers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.zoned import local_date
from ..operators.ranking import first_per_key
from ..operators.windows import longest_window, rise_and_set
from .transit import bisect

SCAN_MINUTES, SHOOT_MINUTES, BISECTIONS = 2, 5, 18


def sun_rise_and_set(rows: DataFrame, zone: str) -> DataFrame:
    """First rise and set of the Sun per local day of rows (key, instant, lat, lon), refined to a second."""
    placed = sky.add_sun(rows).withColumn("day", local_date("instant", zone))
    found = rise_and_set(placed, ["key", "lat", "lon", "day"], "instant", "altitude")

    def exact(c: str) -> Column:
        t = F.unix_micros(c)
        value = lambda m: sky.sun_horizon_shared(m, F.col("lat"), F.col("lon"))["altitude"]
        return F.when(F.col(c).isNotNull(), F.timestamp_micros(bisect(F.coalesce(t, F.lit(0)) - SCAN_MINUTES * 60_000_000, F.coalesce(t, F.lit(0)), value, BISECTIONS)))

    return found.select("key", "day", exact("rise").alias("rise"), exact("set").alias("set"))


def shootable_window(rows: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """The longest run of fitting instants per key."""
    return longest_window(rows, keys, "instant", inside)


def moon_age(rows: DataFrame, new_moons: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Days since the latest new moon at or before each instant.

    New moons are 29 days apart at least, so the latest is in the instant's slot of 32 days or the one before.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(32 * 86_400_000_000))
    shelves = new_moons.select(F.col("new_moon"), slot("new_moon").alias("_slot"))
    asks = rows.withColumn("_slot", F.explode(F.array(slot(time), slot(time) - 1)))
    pairs = asks.join(shelves, "_slot").where(F.col("new_moon") <= F.col(time)).drop("_slot")
    best = first_per_key(pairs, [*keys, time], [F.desc("new_moon")])
    return best.withColumn("age_days", (F.unix_micros(time) - F.unix_micros("new_moon")) / F.lit(86_400_000_000.0))


def new_moons(instants: DataFrame, step_days: float = 1.0) -> DataFrame:
    """New moons within ``step_days`` after each of the instants: where the phase angle falls back, by linear interpolation.

    Both ends of a step are computed in its row, so the instants need no order.
    """
    step = int(step_days * 86_400_000_000)
    phase = lambda t: sky.moon_horizon(t, F.lit(0.0), F.lit(0.0))["phase"]
    later = F.timestamp_micros(F.unix_micros("instant") + F.lit(step))
    rows = instants.withColumn("_next", later).withColumn("_b", phase("instant")).withColumn("_a", phase("_next")).where(F.col("_b") > F.col("_a") + 180)
    share = (360 - F.col("_b")) / (F.col("_a") + 360 - F.col("_b"))
    return rows.select(F.timestamp_micros((F.unix_micros("instant") + share * F.lit(step)).cast("long")).alias("new_moon"))


def ruler(rows: DataFrame, start: str, hours: int = 24, step: int = 2) -> DataFrame:
    """Ticks every ``step`` hours from ``start`` with their place in per cent."""
    k = F.explode(F.sequence(F.lit(0), F.lit(hours), F.lit(step)))
    ticks = rows.withColumn("hour", k)
    return ticks.withColumn("tick", F.timestamp_micros(F.unix_micros(start) + F.col("hour").cast("long") * 3_600_000_000)).withColumn("percent", F.col("hour") * F.lit(100.0) / hours)

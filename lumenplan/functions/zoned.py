"""Local time in named zones, search periods, and calendar filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import col

PERIOD_DAYS = {"1-month": 30, "3-months": 90, "6-months": 180, "1-year": 365}
PERIOD_MONTHS = {"1-month": 1, "3-months": 3, "6-months": 6, "1-year": 12}


def to_local(instant, zone) -> Column:
    """The wall clock in a zone as a timestamp whose UTC fields are the local ones."""
    return F.from_utc_timestamp(col(instant), col(zone) if isinstance(zone, Column) else F.lit(zone))


def to_instant(local, zone) -> Column:
    """The instant of a wall-clock time.

    Four fixed-point steps with the zone's offset; they also settle times that a clock change skips or
    repeats: the result is the one of the fourth step.
    """
    z = zone if isinstance(zone, Column) else F.lit(zone)
    wall = F.unix_micros(col(local))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(4)), wall, lambda t, _: t + wall - F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), z)), lambda t: F.timestamp_micros(t)
    )


def local_date(instant, zone) -> Column:
    return F.to_date(to_local(instant, zone))


def weekday(instant, zone) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(to_local(instant, zone)) - 1


def minute_of_day(instant, zone) -> Column:
    t = to_local(instant, zone)
    return F.hour(t) * 60 + F.minute(t)


def text_minute(text) -> Column:
    """Minutes of "HH:MM"; 0 for anything else."""
    t = col(text)
    return F.when(t.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 2).cast("int")).otherwise(0)


def in_time_range(minute, start, end) -> Column:
    """True between two minutes of the day, both included; a start after the end runs over midnight."""
    m, a, b = col(minute), col(start), col(end)
    return F.when(a <= b, m.between(a, b)).otherwise((m >= a) | (m <= b))


def on_weekdays(day, days: list[int]) -> Column:
    return col(day).isin(days) if days else F.lit(True)


def transit_period(now, zone: str, period: str, first=None, last=None) -> Column:
    """Start and end (excluded) of a transit search: local midnights, presets in days."""
    start = F.to_date(F.lit(first)) if period == "custom" else local_date(now, zone)
    end = F.date_add(F.to_date(F.lit(last)), 1) if period == "custom" else F.date_add(start, PERIOD_DAYS[period])
    return F.struct(to_instant(start.cast("timestamp"), zone).alias("start"), to_instant(end.cast("timestamp"), zone).alias("end"))


def spot_period(now, zone: str, period: str, first=None, last=None) -> Column:
    """Start and end (included) of a spot search: presets in calendar months from now."""
    if period == "custom":
        start = to_instant(F.to_timestamp(F.lit(f"{first} 00:00:00")), zone)
        end = to_instant(F.to_timestamp(F.lit(f"{last} 23:59:00")), zone)
    else:
        local = to_local(now, zone)
        moved = F.add_months(F.to_date(local), PERIOD_MONTHS[period])
        end = to_instant(F.timestamp_micros(F.unix_micros(moved.cast("timestamp")) + F.pmod(F.unix_micros(local), F.lit(86400000000))), zone)
        start = col(now)
    return F.struct(start.alias("start"), end.alias("end"))


def stamp(instant, zone, pattern: str = "yyyy-MM-dd'T'HH:mm") -> Column:
    return F.date_format(to_local(instant, zone), pattern)

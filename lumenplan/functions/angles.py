"""Angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def sind(x) -> Column:
    return F.sin(F.radians(col(x)))


def cosd(x) -> Column:
    return F.cos(F.radians(col(x)))


def tand(x) -> Column:
    return F.tan(F.radians(col(x)))


def clamp(x, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(x)))


def asind(x) -> Column:
    """Arc sine of a value that rounding may have put beyond one."""
    return F.degrees(F.asin(clamp(x, F.lit(-1.0), F.lit(1.0))))


def acosd(x) -> Column:
    return F.degrees(F.acos(clamp(x, F.lit(-1.0), F.lit(1.0))))


def wrap360(x) -> Column:
    return F.pmod(col(x), F.lit(360.0))


def signed_difference(value, target) -> Column:
    """``value`` - ``target`` in [-180, 180)."""
    return F.pmod(col(value) - col(target) + F.lit(540.0), F.lit(360.0)) - F.lit(180.0)


def finite(x) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(x).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def doubles(*names: str) -> T.StructType:
    """A struct of doubles, for functions that return several numbers."""
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def let(value, use) -> Column:
    """``use(v)`` with ``value`` computed once; for expressions inside higher-order functions, where nothing is shared."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))

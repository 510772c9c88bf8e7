"""Decisions: occlusion classes and messages, exclusions, quotas, validation, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .angles import clamp, col, finite
from .earth import refraction_uncertainty

UNCERTAINTY = 0.015
WARN_AT, STOP_AT = 800, 850


def occlusion(body_altitude, terrain_altitude, distance=None, uncertainty: float = UNCERTAINTY) -> Column:
    """obstructed, uncertain or visible; a clearance at the edge of the band is uncertain."""
    band = F.lit(uncertainty)
    if distance is not None:
        band = F.when(finite(distance), F.greatest(band, refraction_uncertainty(distance))).otherwise(band)
    clearance = F.round(col(body_altitude) - col(terrain_altitude), 9)
    return F.when(clearance < -band, "obstructed").when(clearance <= band, "uncertain").otherwise("visible")


def confirmed_hidden(state, reason) -> Column:
    """True only for a finished check whose reason is an obstruction."""
    return F.coalesce(~col(state).isin("checking", "failed") & col(reason).isin("below-horizon", "terrain", "building-or-surface"), F.lit(False))


def presentation(state, reason, boundary, terrain, mesh, failure) -> Column:
    """checking, unavailable or blocked, or null where nothing is to be said."""
    s, r = col(state), col(reason)
    full = s == "dem-and-google-3d"
    return (
        F.when(s == "checking", "checking").when(s == "failed", "unavailable").when(col(boundary), "checking")
        .when((r == "below-horizon") & full, "blocked").when((r == "terrain") & col(terrain), "blocked")
        .when(full & (r == "building-or-surface") & col(mesh), "blocked")
        .when(s == "dem-only", F.when(col(failure).isNotNull(), "unavailable").otherwise("checking"))
    )


def status_3d(enabled, verified, obstructed_pct) -> Column:
    """disabled, unverified, possibly-obstructed or visible."""
    return (
        F.when(~col(enabled), "disabled").when(~F.coalesce(col(verified), F.lit(False)), "unverified")
        .when(col(obstructed_pct) > 0, "possibly-obstructed").otherwise("visible")
    )


def exclusion_by_band(distance, under_100, to_500, to_2000, over) -> Column:
    d = col(distance)
    return F.when(d < 100, col(under_100)).when(d < 500, col(to_500)).when(d < 2000, col(to_2000)).otherwise(col(over))


def exclusion_margin(distance) -> Column:
    """A hundredth of the distance, from 25 to 100 m."""
    return clamp(col(distance) * F.lit(0.01), F.lit(25.0), F.lit(100.0))


def distance_range(low, high) -> Column:
    """Tripod distances kept in 0 to 10 km; an error where the least is above the most."""
    a = F.when(finite(low), clamp(low, F.lit(0.0), F.lit(10000.0))).otherwise(F.lit(500.0))
    b = F.when(finite(high), clamp(high, F.lit(0.0), F.lit(10000.0))).otherwise(F.lit(3000.0))
    return F.when(a > b, F.raise_error(F.lit("the least tripod distance is above the most"))).otherwise(F.struct(a.alias("low"), b.alias("high")))


def quota_before(count, enabled, limited) -> Column:
    """Whether a session may be opened, with a warning and the reason."""
    stop = col(limited) & (col(count) >= STOP_AT)
    return F.struct(
        (col(enabled) & ~stop).alias("allowed"),
        (col(enabled) & ~stop & col(limited) & (col(count) >= WARN_AT)).alias("warn"),
        F.when(~col(enabled), "service_disabled").when(stop, "monthly_limit_reached").alias("reason"),
    )


def quota_after(count, enabled, limited) -> Column:
    """Whether a session that was opened as the count-th may be used."""
    over = col(limited) & (col(count) > STOP_AT)
    return F.struct(
        (col(enabled) & ~over).alias("allowed"),
        (col(enabled) & col(limited) & (col(count) >= WARN_AT)).alias("warn"),
        F.when(~col(enabled), "service_disabled").when(over, "monthly_limit_reached").alias("reason"),
    )


#: Bounds by kind of value.
BOUNDS = {
    "latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0), "height": (-11000.0, 100000.0), "bearing": (0.0, 360.0), "pitch": (-90.0, 90.0),
    "focal": (9.0, 1600.0), "ecef_radius": (6.2e6, 6.6e6),
}


def valid(value, kind: str) -> Column:
    """True for a finite value within the bounds; a field of view is strictly between 0 and 180."""
    v = col(value).cast("double")
    if kind == "fov":
        return finite(v) & (v > 0) & (v < 180)
    low, high = BOUNDS[kind]
    return finite(v) & v.between(low, high)


def asserted(value, kind: str) -> Column:
    """The value, or an error that stops the query."""
    return F.when(valid(value, kind), col(value)).otherwise(F.raise_error(F.concat(F.lit(f"bad {kind}: "), F.coalesce(col(value).cast("string"), F.lit("null")))))


def quarantine(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns all pass, and the others with the names of what failed."""
    failed = F.filter(F.array(*[F.when(~valid(c, k), F.lit(c)) for c, k in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def setting(value, default: float, low: float, high: float) -> Column:
    """A stored setting kept in its bounds; the default where it is not a number."""
    return F.when(finite(value), clamp(value, F.lit(low), F.lit(high))).otherwise(F.lit(default))


def settings(mode, values: dict[str, tuple]) -> dict[str, Column]:
    """All settings by name from (value, default, low, high); an unknown mode gives all defaults."""
    known = col(mode).isin("standard", "pro", "custom")
    return {n: F.when(known, setting(v, d, lo, hi)).otherwise(F.lit(d)) for n, (v, d, lo, hi) in values.items()}

"""Places of the bodies as a table of polynomial segments.

A segment holds the Chebyshev coefficients of a body's geocentric equatorial place of date (x, y, z; km for
Sun and Moon, a unit direction for stars) over one UTC day and MARGIN beyond both ends.  A segment gives the
place of the series it was made from to better than 1e-9 degrees, so searches evaluate polynomials instead
of the lunar series at every step.  The table has a row per body and day; the series hold from 1900 to 2100,
days outside have no segment, so the table is bounded by the calendar and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky

SLOT, MARGIN, DEGREE = 86_400_000_000, 20 * 60_000_000, 16
#: Days since 1970 of the first of January 1900 and of 2100.
FIRST_SLOT, LAST_SLOT = -25_567, 47_482
BODIES = ("sun", "moon", "milkyWay", "polaris")
#: Radius of the disc in km; stars have none.
RADIUS = {"sun": sky.SUN_RADIUS_KM, "moon": sky.MOON_RADIUS_KM}

_NODES = np.cos(np.pi * (np.arange(DEGREE + 1) + 0.5) / (DEGREE + 1))
_TO_COEFFICIENTS = np.cos(np.outer(np.pi * (np.arange(DEGREE + 1) + 0.5) / (DEGREE + 1), np.arange(DEGREE + 1))) * 2 / (DEGREE + 1)
_TO_COEFFICIENTS[:, 0] /= 2


def slot_of(micros: Column) -> Column:
    """The UTC day of an instant in microseconds."""
    return F.floor(micros / F.lit(SLOT)).cast("long")


def days_of(micros: np.ndarray) -> np.ndarray:
    """Days since J2000."""
    return (micros / 1e6 - 946728000.0) / 86400.0


def place(body: str, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Geocentric equatorial place of date by the body's series."""
    if body == "sun":
        return sky.sun_place_series(days)
    if body == "moon":
        s = sky.moon_series(days)
        ra, dec, r = np.radians(s["ra"]), np.radians(s["dec"]), s["km"]
    else:
        ra, dec = sky.star_series(days, *(sky.POLARIS if body == "polaris" else sky.GALACTIC_CENTRE))
        r = np.ones_like(days)
    return r * np.cos(dec) * np.cos(ra), r * np.cos(dec) * np.sin(ra), r * np.sin(dec)


def segments(slots: DataFrame, bodies: Iterable[str] = BODIES) -> DataFrame:
    """Rows (slot, body, cx, cy, cz) for every different ``slot`` of a table and every body."""
    wanted = slots.where(F.col("slot").between(FIRST_SLOT, LAST_SLOT)).select("slot").distinct()
    rows = wanted.withColumn("body", F.explode(F.array(*[F.lit(b) for b in bodies])))

    def run(batches):
        for pdf in batches:
            middle = pdf["slot"].to_numpy(np.int64) * SLOT + SLOT // 2
            days = days_of(middle[:, None] + _NODES * (SLOT / 2 + MARGIN))
            out = {c: np.empty((len(pdf), DEGREE + 1)) for c in ("cx", "cy", "cz")}
            for body in pdf["body"].unique():
                own = (pdf["body"] == body).to_numpy()
                for c, v in zip(out, place(body, days[own].ravel())):
                    out[c][own] = v.reshape(-1, DEGREE + 1) @ _TO_COEFFICIENTS
            yield pdf.assign(**{c: list(v) for c, v in out.items()})

    return rows.mapInPandas(run, "slot long, body string, cx array<double>, cy array<double>, cz array<double>")


def refraction_series(altitude: np.ndarray) -> np.ndarray:
    """Standard refraction in numpy, by the formula of the columns."""
    low = np.maximum(altitude, -1.0)
    bend = 1.02 / np.tan(np.radians(low + 10.3 / (low + 5.11))) / 60
    return np.where(altitude < -1, bend * np.maximum(altitude + 90, 0.0) / 89, bend)


class Track:
    """Where the bodies of a batch of rows (slot, body, cx, cy, cz, lat, lon, height) stand at instants of their day."""

    def __init__(self, pdf: pd.DataFrame | None, mode: str = "standard"):
        if pdf is None:
            return
        self.mode = mode
        self.parts = [np.stack(pdf[c].to_numpy()) for c in ("cx", "cy", "cz")]
        self.middle = pdf["slot"].to_numpy(np.int64) * SLOT + SLOT // 2
        self.phi, self.lon = np.radians(pdf["lat"].to_numpy(float)), pdf["lon"].to_numpy(float)
        self.near = (pdf["body"] == "moon").to_numpy()
        self.radius = pdf["body"].map(RADIUS).fillna(0.0).to_numpy(float)
        ratio, h = 1 - 1 / 298.257223563, pdf["height"].to_numpy(float) / 6378137.0
        u = np.arctan(ratio * np.tan(self.phi))
        # the observer's distance from the axis and from the equator, for bodies that are near
        self.out = np.where(self.near, np.cos(u) + h * np.cos(self.phi), 0.0) * 6378.137
        self.up = np.where(self.near, ratio * np.sin(u) + h * np.sin(self.phi), 0.0) * 6378.137

    def take(self, rows: np.ndarray) -> Track:
        """The same for a choice of rows."""
        other = Track(None)
        other.mode, other.parts = self.mode, [p[rows] for p in self.parts]
        for name in ("middle", "phi", "lon", "near", "radius", "out", "up"):
            setattr(other, name, getattr(self, name)[rows])
        return other

    def at(self, micros: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Azimuth, altitude (apparent in mode "pro") and distance, at one instant per row or a row of instants."""
        wide = (lambda v: v[:, None]) if micros.ndim == 2 else (lambda v: v)
        u = (micros - wide(self.middle)) / (SLOT / 2 + MARGIN)
        x, y, z = (_sum(p, u) for p in self.parts)
        angle = np.radians(np.mod(280.46061837 + 360.98564736629 * days_of(micros) + wide(self.lon), 360.0))
        east, north = np.sin(angle), np.cos(angle)
        x, y, z = x * north + y * east - wide(self.out), x * east - y * north, z - wide(self.up)
        r = np.sqrt(x * x + y * y + z * z)
        s, c = wide(np.sin(self.phi)), wide(np.cos(self.phi))
        altitude = np.degrees(np.arcsin(np.clip((z * s + x * c) / r, -1, 1)))
        azimuth = np.mod(np.degrees(np.arctan2(-y, z * c - x * s)), 360.0)
        return azimuth, altitude + refraction_series(altitude) if self.mode == "pro" else altitude, r


def _sum(coefficients: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Chebyshev sums by Clenshaw's rule, a polynomial per row."""
    column = (lambda k: coefficients[:, k][:, None]) if u.ndim == 2 else (lambda k: coefficients[:, k])
    a = b = np.zeros_like(u)
    for k in range(coefficients.shape[1] - 1, 0, -1):
        a, b = column(k) + 2 * u * a - b, a
    return column(0) + u * a - b

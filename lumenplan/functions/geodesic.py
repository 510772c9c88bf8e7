"""Geodesics on the WGS84 ellipsoid as Arrow functions.

Distance and longitude along a geodesic are the integrals over the auxiliary sphere of Karney (2013),
evaluated by Gauss-Legendre quadrature (their integrands are smooth and nearly constant).  The inverse
problem is the one-dimensional root for the azimuth at the first point, which also converges for
nearly opposite points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import col, doubles
from .earth import FLATTENING, SEMI_MAJOR

_B = SEMI_MAJOR * (1 - FLATTENING)
_EP2 = FLATTENING * (2 - FLATTENING) / (1 - FLATTENING) ** 2
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
COINCIDENT = 1e-6


def _quadrature(f, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    half = (high - low) / 2
    return half * (f((low + high)[:, None] / 2 + half[:, None] * _NODES) @ _WEIGHTS)


def _length(k2, low, high) -> np.ndarray:
    return _B * _quadrature(lambda s: np.sqrt(1 + k2[:, None] * np.sin(s) ** 2), low, high)


def _longitude_lag(k2, low, high) -> np.ndarray:
    f = FLATTENING
    return _quadrature(lambda s: (2 - f) / (1 + (1 - f) * np.sqrt(1 + k2[:, None] * np.sin(s) ** 2)), low, high)


def _arrive(alpha: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple:
    """Longitude difference, azimuth there and arcs of the geodesic that leaves reduced latitude b1 and rises to b2."""
    sin0 = np.sin(alpha) * np.cos(b1)
    cos0 = np.hypot(np.cos(alpha), np.sin(alpha) * np.sin(b1))
    sin2 = sin0 / np.cos(b2)
    cos2 = np.sqrt(np.maximum(0, (np.cos(alpha) * np.cos(b1)) ** 2 + (np.cos(b2) - np.cos(b1)) * (np.cos(b1) + np.cos(b2)))) / np.cos(b2)
    s1, s2 = np.arctan2(np.sin(b1), np.cos(alpha) * np.cos(b1)), np.arctan2(np.sin(b2), cos2 * np.cos(b2))
    w1, w2 = np.arctan2(sin0 * np.sin(s1), np.cos(s1)), np.arctan2(sin0 * np.sin(s2), np.cos(s2))
    s2 = np.where(s2 < s1, s2 + 2 * np.pi, s2)
    w = np.where(w2 - w1 < -1e-15, w2 - w1 + 2 * np.pi, w2 - w1)
    k2 = _EP2 * cos0**2
    return w - FLATTENING * sin0 * _longitude_lag(k2, s1, s2), np.arctan2(sin2, cos2), s1, s2, k2


def inverse(lat1, lon1, lat2, lon2) -> tuple[np.ndarray, np.ndarray]:
    """Distance in metres and azimuth 0-360 at the first point; (0, 0) for points closer than a micrometre."""
    lat1, lon1, lat2, lon2 = (np.asarray(v, float) for v in (lat1, lon1, lat2, lon2))
    turn = (lon2 - lon1 + 540) % 360 - 180
    west = turn < 0
    target = np.radians(np.abs(turn))
    # bring the farther point to the south and first, as the root is unique there
    swap = np.abs(lat1) < np.abs(lat2)
    p, q = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    flip = p > 0
    p, q = np.where(flip, -p, p), np.where(flip, -q, q)
    b1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(np.clip(p, -89.9999999999, 89.9999999999))))
    b2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(np.clip(q, -89.9999999999, 89.9999999999))))
    level = (b1 == 0) & (b2 == 0)
    b1 = np.where(level, -1e-12, b1)
    low, high = np.zeros_like(target), np.full_like(target, np.pi)
    f_low, f_high = _arrive(low, b1, b2)[0] - target, _arrive(high, b1, b2)[0] - target
    f_high = np.where(f_high <= 0, np.pi - target, f_high)
    alpha = (low + high) / 2
    last = np.zeros(len(target), int)
    # meridians and the equator are known below; of the others each is left as soon as it is found
    meridian = target == 0
    equator = level & (target <= (1 - FLATTENING) * np.pi)
    left = np.flatnonzero(~meridian & ~equator)
    for k in range(100):
        left = left[high[left] - low[left] > 2e-16]
        if not len(left):
            break
        lo, hi, fl, fh, side = low[left], high[left], f_low[left], f_high[left], last[left]
        cut = (lo * fh - hi * fl) / np.where(fh == fl, 1, fh - fl)
        at = np.where((k % 3 == 2) | (cut <= lo) | (cut >= hi) | ~np.isfinite(cut), (lo + hi) / 2, cut)
        f = _arrive(at, b1[left], b2[left])[0] - target[left]
        up = f > 0
        # where one end stays, halve its weight (Illinois)
        f_low[left] = np.where(up, np.where(side == 1, fl / 2, fl), f)
        f_high[left] = np.where(up, f, np.where(side == -1, fh / 2, fh))
        last[left] = np.where(up, 1, -1)
        done = f == 0
        alpha[left] = at
        high[left], low[left] = np.where(up | done, at, hi), np.where(up & ~done, lo, at)
    alpha = np.where(meridian, 0.0, alpha)
    _, alpha2, s1, s2, k2 = _arrive(alpha, b1, b2)
    distance = _length(k2, s1, s2)
    distance = np.where(equator, SEMI_MAJOR * target, distance)
    alpha, alpha2 = np.where(equator, np.pi / 2, alpha), np.where(equator, np.pi / 2, alpha2)
    # undo the exchange: seen from the other end the geodesic runs back, which mirrors north and south
    azimuth = np.where(swap, np.where(flip, alpha2, np.pi - alpha2), np.where(flip, np.pi - alpha, alpha))
    degrees = np.degrees(np.where(west, -azimuth, azimuth)) % 360
    same = distance < COINCIDENT
    return np.where(same, 0.0, distance), np.where(same, 0.0, degrees)


def direct(lat1, lon1, azimuth, distance) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees at an azimuth and distance."""
    lat1, lon1, azimuth, distance = (np.asarray(v, float) for v in (lat1, lon1, azimuth, distance))
    b1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(np.clip(lat1, -89.9999999999, 89.9999999999))))
    a = np.radians(azimuth)
    sin0 = np.sin(a) * np.cos(b1)
    cos0 = np.hypot(np.cos(a), np.sin(a) * np.sin(b1))
    k2 = _EP2 * cos0**2
    s1 = np.arctan2(np.sin(b1), np.cos(a) * np.cos(b1))
    w1 = np.arctan2(sin0 * np.sin(s1), np.cos(s1))
    s2 = s1 + distance / _B
    left = np.arange(len(s2))
    for _ in range(8):
        step = (_length(k2[left], s1[left], s2[left]) - distance[left]) / (_B * np.sqrt(1 + k2[left] * np.sin(s2[left]) ** 2))
        s2[left] -= step
        left = left[~(np.abs(step) < 1e-12)]  # the next step would be its square
        if not len(left):
            break
    b2 = np.arctan2(cos0 * np.sin(s2), np.hypot(cos0 * np.cos(s2), sin0))
    w2 = np.arctan2(sin0 * np.sin(s2), np.cos(s2))
    turns = np.where(sin0 >= 0, 1, -1) * ((s2 - s1) - (np.arctan2(np.sin(s2), np.cos(s2)) - np.arctan2(np.sin(s1), np.cos(s1))))
    lam = w2 - w1 + turns - FLATTENING * sin0 * _longitude_lag(k2, s1, s2)
    lat2 = np.degrees(np.arctan(np.tan(b2) / (1 - FLATTENING)))
    return lat2, (lon1 + np.degrees(lam) + 540) % 360 - 180


@F.pandas_udf(doubles("distance", "azimuth"))
def _inverse_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    d, a = inverse(lat1, lon1, lat2, lon2) if len(lat1) else (np.zeros(0), np.zeros(0))
    return pd.DataFrame({"distance": d, "azimuth": a})


@F.pandas_udf(doubles("lat", "lon"))
def _direct_udf(lat: pd.Series, lon: pd.Series, azimuth: pd.Series, distance: pd.Series) -> pd.DataFrame:
    a, b = direct(lat, lon, azimuth, distance) if len(lat) else (np.zeros(0), np.zeros(0))
    return pd.DataFrame({"lat": a, "lon": b})


def geodesic_inverse(lat1, lon1, lat2, lon2) -> Column:
    return _inverse_udf(*[col(c).cast("double") for c in (lat1, lon1, lat2, lon2)])


def geodesic_direct(lat, lon, azimuth, distance) -> Column:
    return _direct_udf(*[col(c).cast("double") for c in (lat, lon, azimuth, distance)])

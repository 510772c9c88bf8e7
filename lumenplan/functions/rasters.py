"""Elevation tiles: pixel decoding, PNG decoding, interpolation."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import clamp, col

SIZE = 256
NO_DATA_CM = -2147483648
#: Sources in order of preference: (id, label, zoom).
SOURCES = (("dem1a_png", "DEM1A", 17), ("dem5a_png", "DEM5A", 15), ("dem5b_png", "DEM5B", 15), ("dem5c_png", "DEM5C", 15), ("dem_png", "DEM10B", 14))


def elevation_cm(red, green, blue) -> Column:
    """Centimetres of an elevation pixel; null for no data."""
    v = col(red) * 65536 + col(green) * 256 + col(blue)
    return F.when(v == 1 << 23, F.lit(None)).when(v > 1 << 23, v - (1 << 24)).otherwise(v).cast("int")


def in_coverage(lat, lon) -> Column:
    return col(lat).between(20.0, 46.5) & col(lon).between(122.0, 154.0)


def source_allowed(label, detail) -> Column:
    """True if a source may answer a request of some finest detail ("1m", "5m", "10m")."""
    return F.when(col(detail) == "10m", col(label) == "DEM10B").when(col(detail) == "5m", col(label) != "DEM1A").otherwise(F.lit(True))


def neighbour(offset_base) -> Column:
    """Tile offset and pixel in it of a pixel number from -256 to 511."""
    v = col(offset_base)
    tile = F.floor(v / SIZE).cast("int")
    return F.struct(tile.alias("tile"), (v - tile * SIZE).cast("int").alias("pixel"))


def nearest_corner(q00, q10, q01, q11, fx, fy) -> Column:
    fx, fy = col(fx), col(fy)
    return F.when(fx < 0.5, F.when(fy < 0.5, col(q00)).otherwise(col(q01))).otherwise(F.when(fy < 0.5, col(q10)).otherwise(col(q11)))


def bilinear(q00, q10, q01, q11, fx, fy) -> Column:
    """Between four corners (top left, top right, bottom left, bottom right); the nearest one if any is missing."""
    a, b, c, d, x, y = (col(v) for v in (q00, q10, q01, q11, fx, fy))
    top, bottom = a + (b - a) * x, c + (d - c) * x
    missing = a.isNull() | b.isNull() | c.isNull() | d.isNull()
    return F.when(missing, nearest_corner(a, b, c, d, x, y)).otherwise(top + (bottom - top) * y)


def _spline(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    m1, m2 = (p2 - p0) / 2, (p3 - p1) / 2
    h = p1 - p2
    return p1 + t * (m1 + t * ((-h * 3 - m1 * 2 - m2) + t * (h * 2 + m1 + m2)))


def constrained_bicubic(grid: list[list[Column]], fx, fy) -> Column:
    """Catmull-Rom over 4 x 4 values, kept within the middle four."""
    x, y = clamp(fx, F.lit(0.0), F.lit(1.0)), clamp(fy, F.lit(0.0), F.lit(1.0))
    value = _spline(*[_spline(*row, x) for row in grid], y)
    middle = (grid[1][1], grid[1][2], grid[2][1], grid[2][2])
    return clamp(value, F.least(*middle), F.greatest(*middle))


def neighbourhood_height(grid: list[list[Column]], fx, fy) -> Column:
    """The higher of bilinear and constrained bicubic; bilinear alone if any of the 16 is missing."""
    flat = bilinear(grid[1][1], grid[1][2], grid[2][1], grid[2][2], fx, fy)
    missing = F.lit(False)
    for row in grid:
        for v in row:
            missing = missing | v.isNull()
    return F.when(missing, flat).otherwise(F.greatest(flat, constrained_bicubic(grid, fx, fy)))


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3 or 4) of an 8-bit RGB or RGBA picture that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, width, height, channels, packed = 8, 0, 0, 0, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in (2, 6) or interlace:
                raise ValueError("only 8-bit RGB and RGBA without interlace")
            channels = 3 if colour == 2 else 4
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.int64)
    above = np.zeros((width, channels), np.int64)
    for k in range(height):
        filtered, line = lines[k, 0], lines[k, 1:].astype(np.int64).reshape(width, channels)
        if filtered == 1:
            line = np.cumsum(line, axis=0) % 256
        elif filtered == 2:
            line = (line + above) % 256
        elif filtered in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                if filtered == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    da, db, dc = np.abs(p - left), np.abs(p - above[x]), np.abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above[x], corner))
                corner = above[x]
                left = line[x] = (line[x] + guess) % 256
        elif filtered:
            raise ValueError("unknown scanline filter")
        out[k] = above = line
    return out.astype(np.uint8)


def pixels_to_cm(pixels: np.ndarray) -> np.ndarray:
    """Centimetres of decoded pixels, NO_DATA_CM where there is none."""
    v = pixels[..., 0].astype(np.int64) * 65536 + pixels[..., 1].astype(np.int64) * 256 + pixels[..., 2]
    return np.where(v == 1 << 23, NO_DATA_CM, np.where(v > 1 << 23, v - (1 << 24), v)).astype(np.int32)

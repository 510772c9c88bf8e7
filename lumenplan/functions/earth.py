"""WGS84 positions, elevation angles, terrestrial refraction, and map coordinates."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import asind, clamp, col, cosd, finite, sind

SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)
MEAN_RADIUS = 6371008.8
K_STANDARD, K_LOW, K_HIGH = 0.13, -0.2, 0.5
MERCATOR_LATITUDE = 85.05112878


def ecef(lat, lon, height) -> Column:
    """Geocentric x, y, z in metres of geodetic degrees and ellipsoidal height."""
    n = F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - F.lit(ECCENTRICITY2) * sind(lat) * sind(lat))
    h = col(height)
    return F.struct(
        ((n + h) * cosd(lat) * cosd(lon)).alias("x"),
        ((n + h) * cosd(lat) * sind(lon)).alias("y"),
        ((n * F.lit(1 - ECCENTRICITY2) + h) * sind(lat)).alias("z"),
    )


def enu(lat, lon, dx, dy, dz) -> Column:
    """East, north and up parts of a geocentric vector at a place; at a pole east is the x axis."""
    dx, dy, dz = col(dx), col(dy), col(dz)
    pole = F.abs(col(lat)) >= F.lit(90.0)
    east_x = F.when(pole, F.lit(1.0)).otherwise(-sind(lon))
    east_y = F.when(pole, F.lit(0.0)).otherwise(cosd(lon))
    up_x, up_y, up_z = cosd(lat) * cosd(lon), cosd(lat) * sind(lon), sind(lat)
    east = dx * east_x + dy * east_y
    up = dx * up_x + dy * up_y + dz * up_z
    north = dx * (-up_z * east_y) + dy * (up_z * east_x) + dz * (up_x * east_y - up_y * east_x)
    return F.struct(east.alias("east"), north.alias("north"), up.alias("up"))


def elevation_and_range(observer: tuple, target: tuple) -> Column:
    """Geometric elevation in degrees and slant range between (lat, lon, height) columns."""
    a, b = ecef(*observer), ecef(*target)
    dx, dy, dz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    distance = F.sqrt(dx * dx + dy * dy + dz * dz)
    up = enu(observer[0], observer[1], dx, dy, dz)["up"]
    return F.struct(
        F.when(distance > 0, asind(up / F.greatest(distance, F.lit(1e-12)))).otherwise(F.lit(90.0)).alias("elevation"), distance.alias("range")
    )


def k_factor(k) -> Column:
    """A refraction coefficient within its bounds; the standard one for a missing value."""
    return F.when(finite(k), clamp(k, F.lit(K_LOW), F.lit(K_HIGH))).otherwise(F.lit(K_STANDARD))


def effective_radius(k=K_STANDARD) -> Column:
    return F.lit(MEAN_RADIUS) / (F.lit(1.0) - k_factor(k))


def terrestrial_refraction(distance, k=K_STANDARD) -> Column:
    """Degrees by which refraction lifts a point so far away."""
    d = col(distance)
    return F.when(finite(d) & (d > 0), F.degrees(k_factor(k) * d / F.lit(2 * MEAN_RADIUS))).otherwise(F.lit(0.0))


def refraction_uncertainty(distance) -> Column:
    """Half the spread between coefficients 0.05 and 0.2, in degrees."""
    return (terrestrial_refraction(distance, 0.2) - terrestrial_refraction(distance, 0.05)) / 2


def apparent_elevation(elevation, distance, mode: str) -> Column:
    """Elevation with terrestrial refraction in mode "pro", without in "standard"."""
    return col(elevation) + terrestrial_refraction(distance) if mode == "pro" else col(elevation)


def curvature_drop(distance, k=K_STANDARD) -> Column:
    d = col(distance)
    return F.when(finite(d) & (d > 0), d * d / (F.lit(2.0) * effective_radius(k))).otherwise(F.lit(0.0))


def elevation_for_height(height, distance, k=K_STANDARD) -> Column:
    """Elevation in degrees of something so much higher on the curved Earth; 90 at no distance."""
    d = col(distance)
    return F.when(d <= 0, F.lit(90.0)).otherwise(F.degrees(F.atan2(col(height) - curvature_drop(d, k), d)))


def heights(ellipsoidal, orthometric, geoid, height) -> Column:
    """Ellipsoidal and orthometric height of a point of which some are known."""
    e, o, n, h = (col(c) for c in (ellipsoidal, orthometric, geoid, height))
    return F.struct(F.coalesce(e, h).alias("ellipsoidal"), F.coalesce(o, h - n, h).alias("orthometric"))


def raised(point: Column, lens) -> Column:
    """A point's ellipsoidal, orthometric and plain height lifted by the lens height."""
    fields = ("ellipsoidal", "orthometric", "height")
    return F.struct(*[(point[f] + col(lens)).alias(f) for f in fields])


def local_metres(lat, lon, lat0, lon0) -> Column:
    """Plane east and north offsets in metres; good for a few kilometres."""
    m = F.lit(pi * MEAN_RADIUS / 180)
    return F.struct(
        ((col(lon) - col(lon0)) * m * cosd(lat0)).alias("x"), ((col(lat) - col(lat0)) * m).alias("y")
    )


def spherical_destination(lat, lon, bearing, distance, radius: float = SEMI_MAJOR) -> Column:
    """Latitude and longitude at a bearing and distance on a sphere."""
    d = F.degrees(col(distance) / F.lit(radius))
    lat2 = asind(sind(lat) * cosd(d) + cosd(lat) * sind(d) * cosd(bearing))
    dlon = F.degrees(F.atan2(sind(bearing) * sind(d) * cosd(lat), cosd(d) - sind(lat) * sind(lat2)))
    return F.struct(lat2.alias("lat"), (F.pmod(col(lon) + dlon + F.lit(540.0), F.lit(360.0)) - F.lit(180.0)).alias("lon"))


def _asinh(x: Column) -> Column:
    return F.signum(x) * F.log(F.abs(x) + F.sqrt(x * x + F.lit(1.0)))


def tile(lat, lon, zoom) -> Column:
    """XYZ tile of a place, whole pixel in the tile and the fractions beyond it."""
    n = F.pow(F.lit(2.0), col(zoom))
    lat = clamp(lat, F.lit(-MERCATOR_LATITUDE), F.lit(MERCATOR_LATITUDE))
    x = (col(lon) + 180) / 360 * n
    y = (F.lit(1.0) - _asinh(F.tan(F.radians(lat))) / F.lit(pi)) / 2 * n
    tx, ty = clamp(F.floor(x), F.lit(0), n - 1), clamp(F.floor(y), F.lit(0), n - 1)
    px, py = clamp((x - tx) * 256, F.lit(0.0), F.lit(255.999)), clamp((y - ty) * 256, F.lit(0.0), F.lit(255.999))
    return F.struct(
        tx.cast("int").alias("x"), ty.cast("int").alias("y"), F.floor(px).cast("int").alias("px"), F.floor(py).cast("int").alias("py"),
        (px - F.floor(px)).alias("fx"), (py - F.floor(py)).alias("fy"),
    )


def mercator_pixel(lat, lon, zoom) -> Column:
    """World pixel coordinates at a zoom, 256 pixels a tile."""
    s = F.pow(F.lit(2.0), col(zoom)) * 256
    lat = clamp(lat, F.lit(-MERCATOR_LATITUDE), F.lit(MERCATOR_LATITUDE))
    return F.struct(((col(lon) + 180) / 360 * s).alias("x"), ((F.lit(0.5) - _asinh(F.tan(F.radians(lat))) / F.lit(2 * pi)) * s).alias("y"))


def mercator_place(x, y, zoom) -> Column:
    """Latitude and longitude of world pixel coordinates."""
    s = F.pow(F.lit(2.0), col(zoom)) * 256
    lat = F.degrees(F.atan(F.sinh(F.lit(pi) * (F.lit(1.0) - F.lit(2.0) * col(y) / s))))
    return F.struct(lat.alias("lat"), (col(x) / s * 360 - 180).alias("lon"))


def sky_dome(azimuth, altitude, radius) -> Column:
    """Offset of a sky position on a dome drawn around a map point: zenith in the middle, horizon at the radius."""
    r = col(radius) * (F.lit(90.0) - clamp(altitude, F.lit(0.0), F.lit(90.0))) / 90
    return F.struct((r * sind(azimuth)).alias("x"), (-r * cosd(azimuth)).alias("y"))

"""Row generators: instants, compositions, rings, profiles, prefetch grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import clamp, col, cosd, wrap360
from ..functions.earth import spherical_destination
from ..functions.geodesic import geodesic_direct
from ..functions.optics import FRAME_WIDTH, fields_of_view
from ..functions.zoned import to_instant, to_local

MINUTE, DAY = 60_000_000, 86_400_000_000
INTERVALS = {"1-minute": MINUTE, "5-minutes": 5 * MINUTE, "10-minutes": 10 * MINUTE, "30-minutes": 30 * MINUTE, "1-hour": 60 * MINUTE, "1-day": DAY, "1-week": 7 * DAY}
CROSSING_STEP = 10 * MINUTE


def frame_step(h_fov, v_fov) -> Column:
    """Microseconds between samples such that a body moving 0.3 degrees a minute is met four times in the shorter side."""
    shortest = F.least(col(h_fov), col(v_fov))
    return clamp(F.floor(shortest / F.lit(0.3) * 60_000 / 4) * 1000, F.lit(MINUTE), F.lit(10 * MINUTE)).cast("long")


def instants(df: DataFrame, start: str, end: str, step: Column | int, out: str = "instant") -> DataFrame:
    """A row per instant from ``start`` on in fixed steps, and the end itself."""
    micros = F.sequence(F.unix_micros(start), F.unix_micros(end), col(step).cast("long"))
    every = F.array_distinct(F.concat(micros, F.array(F.unix_micros(end))))
    return df.withColumn(out, F.explode(F.transform(every, lambda t: F.timestamp_micros(t))))


def local_instants(df: DataFrame, start: str, end: str, interval: str, zone: str, out: str = "instant") -> DataFrame:
    """A row per instant up to ``end`` included.

    Days and weeks keep the wall clock.  Months are stepped one after the other, so that a day cut to a
    shorter month stays cut.
    """
    if interval in ("1-day", "1-week"):
        local = F.sequence(F.unix_micros(to_local(F.col(start), zone)), F.unix_micros(to_local(F.col(end), zone)) + DAY, F.lit(INTERVALS[interval]))
        rows = df.withColumn(out, to_instant(F.timestamp_micros(F.explode(local)), zone))
    elif interval == "1-month":
        n = F.ceil(F.months_between(end, start)).cast("int") + 1
        first = to_local(F.col(start), zone)
        time = F.pmod(F.unix_micros(first), F.lit(DAY))
        days = F.aggregate(F.sequence(F.lit(1), n), F.array(F.to_date(first)), lambda a, _: F.concat(a, F.array(F.add_months(F.element_at(a, -1), 1))))
        rows = df.withColumn("_time", time).withColumn("_day", F.explode(days))
        rows = rows.withColumn(out, to_instant(F.timestamp_micros(F.unix_micros(F.col("_day").cast("timestamp")) + F.col("_time")), zone)).drop("_day", "_time")
    else:
        rows = df.withColumn(out, F.explode(F.sequence(F.unix_micros(start), F.unix_micros(end), F.lit(INTERVALS[interval])))).withColumn(out, F.timestamp_micros(out))
    return rows.where(F.col(out) <= F.col(end))


def composition_offsets(df: DataFrame, azimuth: str, altitude: str, focal_mm, aspect, full_width: bool = False) -> DataFrame:
    """Five rows per sky position: the middle, and the subject moved to the sides and up and down; those too low go."""
    f = fields_of_view(focal_mm, aspect)
    half_h, half_v = f["h"] / 2, f["v"] / 2
    if full_width:
        half_h = F.degrees(F.atan(F.lit(FRAME_WIDTH) / (F.lit(2.0) * col(focal_mm))))
        half_v = F.degrees(F.atan(F.lit(FRAME_WIDTH) / F.greatest(col(aspect), F.lit(0.25)) / (F.lit(2.0) * col(focal_mm))))
    h, v, zero = half_h * F.lit(0.62), half_v * F.lit(0.55), F.lit(0.0)
    options = [(zero, zero), (-h, zero), (h, zero), (zero, -v), (zero, v)]
    moved = F.array(
        *[F.struct(F.lit(k + 1).alias("composition"), wrap360(F.col(azimuth) + a).alias("azimuth"), (F.col(altitude) + b).alias("altitude")) for k, (a, b) in enumerate(options)]
    )
    rows = df.withColumn("_c", F.explode(moved)).drop(azimuth, altitude)
    return rows.select("*", F.col("_c.composition"), F.col("_c.azimuth").alias(azimuth), F.col("_c.altitude").alias(altitude)).drop("_c").where(F.col(altitude) > 0.25)


def log_distances(low, high, count: int) -> Column:
    """``count`` distances with equal ratios from ``low`` (8 m at least) to ``high``."""
    a = F.greatest(col(low), F.lit(8.0))
    b = F.greatest(col(high), a)
    return F.transform(F.sequence(F.lit(0), F.lit(max(count, 2) - 1)), lambda k: a * F.pow(b / a, k / F.lit(float(max(count, 2) - 1))))


def refined_distances(distances: Column, at: Column, count: int = 48) -> Column:
    """``count`` even distances between the second neighbours of the one at index ``at``."""
    start = F.get(distances, F.greatest(at - 2, F.lit(0)))
    end = F.get(distances, F.least(at + 2, F.size(distances) - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: start + (end - start) * k / F.lit(float(count - 1)))


def disc_edge(df: DataFrame, azimuth: str, altitude: str, radius, count: int) -> DataFrame:
    """The middle of a disc (edge 0) and ``count`` points on its edge."""
    k = F.explode(F.sequence(F.lit(0), F.lit(count)))
    rows = df.withColumn("edge", k)
    turn = F.radians((F.col("edge") - 1) * F.lit(360.0 / max(count, 1)))
    r = F.when(F.col("edge") == 0, F.lit(0.0)).otherwise(col(radius))
    up, side = r * F.cos(turn), r * F.sin(turn) / F.greatest(F.lit(0.05), cosd(F.col(altitude)))
    return rows.withColumn(azimuth, wrap360(F.col(azimuth) + side)).withColumn(altitude, F.col(altitude) + up)


def ring(df: DataFrame, lat: str, lon: str, radii=(5, 10, 15, 20), bearings: int = 12) -> DataFrame:
    """The place itself and points around it; geodesic, with columns ``radius`` and ``bearing``."""
    offsets = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.lit(b * 360.0 / bearings).alias("bearing")) for r in (0, *radii) for b in range(bearings if r else 1)])
    rows = df.withColumn("_o", F.explode(offsets)).select("*", "_o.radius", "_o.bearing").drop("_o")
    return rows.withColumn("_p", geodesic_direct(lat, lon, "bearing", "radius")).withColumn(lat, F.col("_p.lat")).withColumn(lon, F.col("_p.lon")).drop("_p")


def directional_candidates(df: DataFrame, lat: str, lon: str, azimuth: str, distance: float = 500.0) -> DataFrame:
    """The place from where the subject stands under the body, at a fixed distance."""
    back = F.pmod(F.col(azimuth) + 180, F.lit(360.0))
    return df.withColumn("_p", geodesic_direct(lat, lon, back, F.lit(distance))).select("*", F.col("_p.lat").alias("candidate_lat"), F.col("_p.lon").alias("candidate_lon")).drop("_p")


def base_lines(df: DataFrame, lat: str, lon: str, azimuth: str, altitude: str, distance: float = 250_000.0, step: float = 10_000.0) -> DataFrame:
    """The lines from subjects away from bodies above the horizon, in segments of ``step`` metres along the geodesic.

    Columns idx, part, lat1, lon1, lat2, lon2.  A segment that crosses the 180th meridian is cut there into
    two parts, so that no segment runs around the globe.
    """
    count = int(-(-distance // step))
    rows = df.where(F.col(altitude) > 0).withColumn("bearing", wrap360(F.col(azimuth) + 180)).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    ends = rows.withColumn("_d1", F.col("idx") * F.lit(step)).withColumn("_d2", F.least(F.lit(distance), (F.col("idx") + 1) * F.lit(step)))
    placed = ends.withColumn("_a", geodesic_direct(lat, lon, "bearing", "_d1")).withColumn("_b", geodesic_direct(lat, lon, "bearing", "_d2"))
    a, b = F.col("_a"), F.col("_b")
    segment = lambda part, *v: F.struct(F.lit(part).alias("part"), *[x.alias(n) for n, x in zip(("lat1", "lon1", "lat2", "lon2"), v)])
    edge = F.signum(a["lon"]) * 180.0
    share = F.try_divide(F.lit(180.0) - F.abs(a["lon"]), F.lit(360.0) - F.abs(a["lon"]) - F.abs(b["lon"]))
    between = a["lat"] + (b["lat"] - a["lat"]) * F.coalesce(share, F.lit(0.0))
    cut = F.abs(b["lon"] - a["lon"]) > 180
    parts = F.when(cut, F.array(segment(0, a["lat"], a["lon"], between, edge), segment(1, between, -edge, b["lat"], b["lon"]))).otherwise(F.array(segment(0, a["lat"], a["lon"], b["lat"], b["lon"])))
    return placed.withColumn("_s", F.explode(parts)).select(*df.columns, "idx", "_s.*")


def follow_bodies(bodies: DataFrame, previous: DataFrame, keys: list[str], lat: str, lon: str, least_altitude: float = 0.25) -> DataFrame:
    """Earlier places of the tripod moved along with bodies that have moved, at the distances found earlier.

    ``bodies`` has the subject's ``lat`` and ``lon``, ``azimuth`` and ``altitude``; ``previous`` has
    ``distance``.  Bodies that are low or had no place are left out.
    """
    seen = bodies.where(F.col("altitude") > least_altitude).join(previous.select(*keys, "distance"), keys)
    rows = seen.withColumn("bearing", F.pmod(F.col("azimuth") + 180, F.lit(360.0)))
    return rows.withColumn("_p", geodesic_direct(lat, lon, "bearing", "distance")).select("*", F.col("_p.lat").alias("candidate_lat"), F.col("_p.lon").alias("candidate_lon")).drop("_p")


def prefetch_points(df: DataFrame, lat: str, lon: str, low, high, start=None, end=None, steps: int = 12) -> DataFrame:
    """The origin and ``steps`` distances along bearings: every 5 degrees of a band, else 24 around."""
    if start is None:
        bearings = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: k * F.lit(15.0))
    else:
        span = F.pmod(col(end) - col(start), F.lit(360.0))
        bearings = F.transform(F.sequence(F.lit(0), F.ceil(span / 5).cast("int")), lambda k: wrap360(col(start) + F.least(span, k * F.lit(5.0))))
    every = df.withColumn("bearing", F.explode(bearings)).withColumn("distance", F.explode(log_distances(low, high, steps)))
    origin = df.withColumn("bearing", F.lit(0.0)).withColumn("distance", F.lit(0.0))
    rows = origin.unionByName(every).withColumn("_p", spherical_destination(lat, lon, "bearing", "distance"))
    return rows.withColumn("point_lat", F.col("_p.lat")).withColumn("point_lon", F.col("_p.lon")).drop("_p").dropDuplicates([lat, lon, "point_lat", "point_lon"])

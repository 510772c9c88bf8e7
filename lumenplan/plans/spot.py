"""Places from where a body stands over or beside a subject: the spot search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.angles import signed_difference
from ..functions.earth import apparent_elevation, elevation_and_range
from ..functions.geodesic import geodesic_direct, geodesic_inverse
from ..functions.zoned import in_time_range, minute_of_day, on_weekdays, weekday
from ..operators.lineage import cut
from ..operators.ranking import best_within, first_per_key
from ..operators.sampling import composition_offsets, log_distances, ring
from ..operators.windows import first_bracket
from ..sources.dem import Sampler
from ..sources.places import passes_site

HEIGHT_LIMIT, GOOD_ENOUGH, ROUNDS = 100.0, 0.002, 3
CONVERGED_METRES, CONVERGED_DEGREES = 0.05, 0.0001
DISC_RADIUS = {"sun": 0.272, "moon": 0.285}
#: Samples of the first scan, refinements, and sections of each.
PROFILES = {"standard": (16, 2, 6), "pro": (32, 3, 8), "interactive": (32, 1, 576)}
#: A placer gives rows (instant, lat, lon, height) columns azimuth and altitude of the body.
Placer = Callable[[DataFrame], DataFrame]


def calendar(rows: DataFrame, zone: str, weekdays: list[int], first: Column, last: Column) -> DataFrame:
    """Cheap filters first: weekday and time of day."""
    return rows.where(on_weekdays(weekday(F.col("instant"), zone), weekdays) & in_time_range(minute_of_day(F.col("instant"), zone), first, last))


def sun_samples(rows: DataFrame, timing: str = "all", mode: str = "standard") -> DataFrame:
    """Rows (instant, lat, lon) with the Sun between 0.25 and 45 degrees; for sunrise and sunset low and next to night."""
    placed = sky.add_sun(rows)
    placed = placed.withColumn("altitude", sky.apparent_altitude(F.col("altitude"), mode))
    out = placed.where((F.col("altitude") > 0.25) & (F.col("altitude") < 45))
    if timing == "all":
        return out
    out = out.where(F.col("altitude") < 12)
    up = lambda minutes: sky.apparent_altitude(
        sky.sun(sky.days_since_j2000("instant") + minutes / F.lit(1440.0), F.col("lat").cast("double"), F.col("lon").cast("double"))["altitude"], mode
    )
    out = out.withColumn("rising", up(F.lit(10)) > F.col("altitude"))
    out = out.withColumn("_far", up(F.when(F.col("rising"), -360).otherwise(360))).where(F.col("_far") <= 0.25)
    out = out if timing == "both" else out.where(F.col("rising") if timing == "sunrise" else ~F.col("rising"))
    return out.drop("_far", "rising")


def moon_samples(rows: DataFrame, least_age: float = 0.0, most_age: float = sky.SYNODIC_DAYS, mode: str = "standard") -> DataFrame:
    """Rows (instant, lat, lon) with the Moon between 0.25 and 50 degrees and of some age by its phase."""
    placed = rows.withColumn("_m", sky.moon_horizon("instant", "lat", "lon")).select(
        "*", F.col("_m.azimuth").alias("azimuth"), sky.apparent_altitude(F.col("_m.altitude"), mode).alias("altitude"), sky.moon_age_by_phase(F.col("_m.phase")).alias("age"), F.col("_m.fraction").alias("fraction")
    ).drop("_m")
    return placed.where((F.col("altitude") > 0.25) & (F.col("altitude") < 50) & F.col("age").between(least_age, most_age))


def milky_way_samples(rows: DataFrame, mode: str = "standard") -> DataFrame:
    """Rows with the galactic centre between 8 and 55 degrees, the Sun at most at -12, and no bright Moon up."""
    placed = rows.withColumn("_h", sky.star_horizon("instant", "lat", "lon")).withColumn("azimuth", F.col("_h.azimuth")).withColumn("altitude", sky.apparent_altitude(F.col("_h.altitude"), mode)).drop("_h")
    dark = sky.add_sun(placed.where(F.col("altitude").between(8, 55)), azimuth="_az", altitude="_sun").where("_sun <= -12").drop("_az", "_sun")
    with_moon = dark.withColumn("_m", sky.moon_horizon("instant", "lat", "lon"))
    return with_moon.where(~((F.col("_m.altitude") > 0) & (F.col("_m.fraction") > 0.35))).drop("_m")


def _errors(points: DataFrame, sampler: Sampler, detail: str, mode: str) -> DataFrame:
    """Elevation of the subject seen from the ground at each point, less the body's altitude."""
    placed = points.withColumn("_p", geodesic_direct("subject_lat", "subject_lon", "back", "distance"))
    placed = placed.withColumn("lat", F.col("_p.lat")).withColumn("lon", F.col("_p.lon")).drop("_p").withColumn("_k", F.concat_ws(":", "key", F.col("distance").cast("string")))
    ground = sampler(placed.select(F.col("_k").alias("key"), "lat", "lon", F.lit(detail).alias("detail"))).select(F.col("key").alias("_k"), "height")
    rows = placed.join(ground, "_k", "left").drop("_k")
    seen = elevation_and_range((F.col("lat"), F.col("lon"), F.col("height") + F.col("lens")), (F.col("subject_lat"), F.col("subject_lon"), F.col("subject_height")))
    return rows.withColumn("_s", seen).withColumn("error", apparent_elevation(F.col("_s.elevation"), F.col("_s.range"), mode) - F.col("altitude")).drop("_s")


def distance_roots(targets: DataFrame, sampler: Sampler, low: float, high: float, profile: str = "standard", mode: str = "standard") -> DataFrame:
    """The tripod distance per target at which the subject is as high as the body.

    ``targets`` has key, subject_lat, subject_lon, subject_height, lens, back (bearing away from the body)
    and altitude.  A logarithmic scan finds the first bracket outward; a fixed number of rounds cuts it
    into sections over finer terrain.  The best point seen is kept where nothing brackets.
    """
    samples, passes, sections = PROFILES[profile]
    scan = cut(_errors(targets.withColumn("distance", F.explode(log_distances(F.lit(low), F.lit(high), samples))), sampler, "10m", mode))
    finite = lambda df: df.where(F.col("error").isNotNull() & ~F.isnan("error"))
    columns = ["key", "lat", "lon", "height", "distance", "error"]
    seen = finite(scan).select(*columns)
    bracket = first_bracket(scan, ["key"], "distance", "error").select("key", F.col("previous_distance").alias("a"), F.col("distance").alias("b"))
    for _ in range(passes):
        step = (F.col("b") - F.col("a")) / sections
        cuts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(sections)), lambda k: F.col("a") + step * k))
        fine = cut(_errors(targets.join(bracket, "key").withColumn("distance", cuts).drop("a", "b"), sampler, "1m", mode))
        seen = seen.unionByName(finite(fine).select(*columns))
        bracket = first_bracket(fine, ["key"], "distance", "error").select("key", F.col("previous_distance").alias("a"), F.col("distance").alias("b"))
    return first_per_key(seen, ["key"], [F.abs(F.col("error")), F.col("distance")])


def candidates(points: DataFrame, placer: Placer, sampler: Sampler, low: float, high: float, h_fov: Column, v_fov: Column, profile: str = "standard", mode: str = "standard", rounds: int = ROUNDS) -> DataFrame:
    """Tripod places per point (key, body, instant, azimuth, altitude, subject place, lens) by a fixed number of rounds.

    In each round the body is placed anew from the last solution.  A solution that has settled stays.
    The subject must then be in the field of view with the body's disc.
    """
    now = points.withColumn("back", F.pmod(F.col("azimuth") + 180, F.lit(360.0)))
    for _ in range(rounds):
        solved = distance_roots(now, sampler, low, high, profile, mode).select("key", "lat", "lon", "height", "distance", "error")
        again = cut(placer(points.drop("azimuth", "altitude").join(solved, "key").withColumn("height", F.col("height") + F.col("lens"))))
        now = again.withColumn("height", F.col("height") - F.col("lens")).withColumn("back", F.pmod(F.col("azimuth") + 180, F.lit(360.0)))
        last = now
        now = now.drop("lat", "lon", "height", "distance", "error")
    placed = last.withColumn("_g", geodesic_inverse("lat", "lon", "subject_lat", "subject_lon"))
    radius = F.coalesce(*[F.when(F.col("body") == b, F.lit(r)) for b, r in DISC_RADIUS.items()], F.lit(0.0))
    off_azimuth = F.abs(signed_difference(F.col("_g.azimuth"), F.col("azimuth")))
    return placed.where((off_azimuth + radius <= h_fov / 2) & (F.abs("error") + radius <= v_fov / 2)).drop("_g", "back")


def accept(found: DataFrame, sites: DataFrame, low: float, high: float, same_height: bool, subject_ground: Column, constraints: tuple[bool, bool, bool, bool]) -> DataFrame:
    """Per search sample the first candidate in order of composition that passes distance, height and site."""
    rows = found.where(F.col("distance").between(low, high))
    if same_height:
        rows = rows.where(F.abs(F.col("height") - subject_ground) <= HEIGHT_LIMIT)
    rows = rows.join(sites, "key").where(passes_site(*constraints))
    return first_per_key(rows, ["sample"], [F.col("composition")])


def search(samples: DataFrame, placer: Placer, sampler: Sampler, contexts: Callable[[DataFrame], DataFrame], focal_mm: float, aspect: float, low: float, high: float,
           h_fov: Column, v_fov: Column, constraints: tuple[bool, bool, bool, bool] = (False, False, False, False), limit: int = 100) -> DataFrame:
    """The spot search over filtered samples: compositions, places, constraints, and the first results in time."""
    points = composition_offsets(samples, "azimuth", "altitude", F.lit(focal_mm), F.lit(aspect)).withColumn("key", F.concat_ws(":", "sample", "composition"))
    found = candidates(points, placer, sampler, low, high, h_fov, v_fov)
    kept = accept(found, contexts(found.select("key", "lat", "lon")), low, high, False, F.lit(0.0), constraints)
    return kept.orderBy("instant", "sample").limit(limit)


def refine(origins: DataFrame, sampler: Sampler, evaluate: Callable[[DataFrame], DataFrame], contexts: Callable[[DataFrame], DataFrame] | None = None,
           checks: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The best of the rings of points around every origin (key, lat, lon), and the points set aside.

    In stages: points where nobody may stand go (``contexts``, with the flags of a site); points without a
    height of the highest detail are set aside with a reason and stop nothing else; ``evaluate`` adds error;
    ``checks`` adds ``clear``, from terrain, surface or mesh hits along the line to the subject, and what is
    not clear goes.  Of the rest the least error wins, of equal ones the nearest to the origin.
    """
    rows = ring(origins, "lat", "lon").withColumn("point", F.concat_ws(":", "key", F.col("radius").cast("int").cast("string"), F.col("bearing").cast("int").cast("string")))
    if contexts is not None:
        rows = rows.join(contexts(rows.select(F.col("point").alias("key"), "lat", "lon")).withColumnRenamed("key", "point"), "point").where(passes_site(True, True, False, True))
    heights = sampler(rows.select(F.col("point").alias("key"), "lat", "lon", F.lit("1m").alias("detail"))).select(F.col("key").alias("point"), "height")
    sampled = cut(rows.join(heights, "point", "left"))
    aside = sampled.where("height IS NULL").select("key", "point", F.lit("no height").alias("reason"))
    scored = evaluate(sampled.where("height IS NOT NULL"))
    if checks is not None:
        scored = checks(scored).where("clear")
    return best_within(scored, ["key"], "error", "radius"), aside

"""Map features: tag rules, heights, and plane geometry of lines and rings.

A feature is a row with ``tags`` (map of strings) and ``points`` (array of structs x, y in metres from
the place that is asked about).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import clamp, col, cosd, sind

# Access tags, highway classes, half widths in metres, and vegetation heights.
PRIVATE = ("private", "no", "customers", "permit")
NOT_WALKABLE = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed")
MOTOR_HALF_WIDTH = {
    "motorway": 7.5, "motorway_link": 4.0, "trunk": 6.0, "trunk_link": 4.0, "primary": 5.0, "primary_link": 4.0, "secondary": 4.5,
    "secondary_link": 3.8, "tertiary": 4.0, "tertiary_link": 3.5, "unclassified": 3.5, "residential": 3.2, "living_street": 3.2,
    "service": 2.8, "road": 3.5,
}
OTHER_HALF_WIDTH = {"pedestrian": 4.0, "track": 2.5, "footway": 2.0, "path": 2.0, "steps": 2.0, "cycleway": 2.0}
DEFAULT_HALF_WIDTH, LEVEL_HEIGHT = 3.0, 3.0
CANOPY = {"single-tree": 8.0, "tree-row": 9.0, "hedge": 2.0, "orchard": 5.0, "forest": 12.0}


def _table(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for v in chain(*values.items())]), key)


def tag(name: str, tags="tags") -> Column:
    """A tag's text; null if it is absent or empty."""
    return F.nullif(F.try_element_at(col(tags), F.lit(name)), F.lit(""))


def metres(text: Column) -> Column:
    """The number at the start of a text in metres; null for feet and inches."""
    t = F.lower(F.trim(text))
    return F.when(~(t.contains("ft") | t.contains("'")), F.nullif(F.regexp_extract(t, r"^-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double"))


def building_height(tags="tags") -> Column:
    """Height and its source from a height tag, else from the number of levels."""
    mapped, levels = metres(tag("height", tags)), metres(tag("building:levels", tags))
    return F.struct(
        F.coalesce(mapped, levels * LEVEL_HEIGHT).alias("height"),
        F.when(mapped.isNotNull(), "surveyed").when(levels.isNotNull(), "levels-estimate").alias("source"),
    )


def vegetation(tags="tags") -> Column:
    t = lambda n: tag(n, tags)
    return (
        F.when(t("natural") == "tree", "single-tree").when(t("natural") == "tree_row", "tree-row").when(t("barrier") == "hedge", "hedge")
        .when(t("landuse") == "orchard", "orchard").when((t("natural") == "wood") | (t("landuse") == "forest"), "forest")
    )


def obstacle_height(tags="tags") -> Column:
    """Height of a building (only if known and above 0) or of vegetation (typical if unknown)."""
    b = building_height(tags)["height"]
    return F.when(tag("building", tags).isNotNull(), F.when(b > 0, b)).otherwise(
        F.when(vegetation(tags).isNotNull(), F.coalesce(metres(tag("height", tags)), _table(CANOPY, vegetation(tags))))
    )


def is_private(tags="tags") -> Column:
    return F.coalesce(tag("access", tags).isin(*PRIVATE), F.lit(False)) | F.coalesce(tag("foot", tags).isin(*PRIVATE), F.lit(False))


def half_width(tags="tags") -> Column:
    width = metres(tag("width", tags))
    highway = tag("highway", tags)
    return F.when(width.isNotNull(), F.greatest(F.lit(1.5), width / 2)).otherwise(F.coalesce(_table(MOTOR_HALF_WIDTH | OTHER_HALF_WIDTH, highway), F.lit(DEFAULT_HALF_WIDTH)))


def walkable(distance, tags="tags") -> Column:
    h = tag("highway", tags)
    return F.coalesce(h.isNotNull() & ~h.isin(*NOT_WALKABLE) & ~is_private(tags) & (col(distance) <= 25), F.lit(False))


def on_way(distance, tags="tags") -> Column:
    return F.coalesce(tag("highway", tags).isNotNull() & (col(distance) <= half_width(tags)), F.lit(False))


def on_motor_road(distance, tags="tags") -> Column:
    return F.coalesce(tag("highway", tags).isin(*MOTOR_HALF_WIDTH) & (col(distance) <= half_width(tags)), F.lit(False))


def restricted(distance, inside, tags="tags") -> Column:
    return F.coalesce(is_private(tags) & (col(inside) | (tag("highway", tags).isNotNull() & (col(distance) <= 12))), F.lit(False))


def structure_type(tags="tags") -> Column:
    t = lambda n: tag(n, tags)
    man = t("man_made")
    return (
        F.when(t("tourism") == "hotel", "hotel").when(man == "communications_tower", "communications-tower").when(man == "mast", "communications-mast")
        .when((man == "tower") & ((t("tower:type") == "communication") | t("communication").isNotNull()), "communications-tower")
        .when((man == "tower") | (t("building") == "tower"), "tower")
    )


def landmark_type(tags="tags") -> Column:
    t = lambda n: tag(n, tags)
    return F.coalesce(
        structure_type(tags),
        F.when((t("ceremonial_gate") == "torii") | (t("man_made") == "torii"), "torii")
        .when(((t("amenity") == "place_of_worship") & (t("religion") == "shinto")) | (t("building") == "shrine") | (t("historic") == "wayside_shrine"), "shrine")
        .when(t("building").isNotNull() & t("historic").isNotNull(), "historic-building")
        .when(t("building").isNotNull() & (t("wikidata").isNotNull() | t("wikipedia").isNotNull() | (t("tourism") == "attraction")), "landmark-building"),
    )


def _segments(points: Column) -> Column:
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def distance_to(points) -> Column:
    """Least distance from the origin to a point or a line; null for none."""
    p = col(points)

    def segment(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(s["a"]["x"] * dx + s["a"]["y"] * dy), square)))).otherwise(F.lit(0.0))
        return F.hypot(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)

    return F.when(F.size(p) == 1, F.hypot(F.get(p, F.lit(0))["x"], F.get(p, F.lit(0))["y"])).otherwise(F.array_min(F.transform(_segments(p), segment)))


def contains_origin(points) -> Column:
    """True if the origin is inside a closed ring of four or more points."""
    p = col(points)
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > 0) != (b["y"] > 0)) & (F.try_divide((b["x"] - a["x"]) * -a["y"], b["y"] - a["y"]) + a["x"] > 0)

    odd = F.pmod(F.size(F.filter(_segments(p), crosses)), F.lit(2)) == 1
    return F.coalesce((F.size(p) >= 4) & (first == last) & odd, F.lit(False))


def centroid(points) -> Column:
    """Mean of the vertices."""
    p = col(points)
    total = lambda k: F.aggregate(p, F.lit(0.0), lambda s, v: s + v[k]) / F.size(p)
    return F.when(F.size(p) > 0, F.struct(total("x").alias("x"), total("y").alias("y")))


def ray_approach(points, azimuth) -> Column:
    """Where a feature comes closest to a ray from the origin: metres off it and along it; null if all of it is behind.

    Vertices, crossings of the ray, and the points of the edges closest to the origin are considered;
    of equally close ones the nearer counts.
    """
    p = col(points)
    rx, ry = sind(azimuth), cosd(azimuth)

    def candidates(s: Column) -> Column:
        a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        across = dx * ry - dy * rx
        t = F.when(F.abs(across) > F.lit(1e-9), F.try_divide(a["y"] * rx - a["x"] * ry, across))
        cut = F.when(t.between(0, 1), F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y")))
        square = dx * dx + dy * dy
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(a["x"] * dx + a["y"] * dy), square)))
        near = F.when(square > 0, F.struct((a["x"] + u * dx).alias("x"), (a["y"] + u * dy).alias("y")))
        return F.array(cut, near)

    plain = F.transform(p, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    every = F.filter(F.concat(plain, F.flatten(F.transform(_segments(p), candidates))), lambda v: v.isNotNull())
    measured = F.transform(every, lambda v: F.struct(F.abs(v["x"] * ry - v["y"] * rx).alias("off"), (v["x"] * rx + v["y"] * ry).alias("along")))
    return F.array_min(F.filter(measured, lambda m: m["along"] > 0))


def point_approach(x, y, rx, ry) -> Column:
    """As ``ray_approach`` for a feature of one point, given the sine and cosine of the ray's azimuth."""
    along = col(x) * col(rx) + col(y) * col(ry)
    return F.when(along > 0, F.struct(F.abs(col(x) * col(ry) - col(y) * col(rx)).alias("off"), along.alias("along")))


def between_ends(length, bearing, distance, direction) -> Column:
    """True for a place between tripod and subject, given both as seen from the tripod in metres and degrees.

    Along the line it keeps off either end by half a percent of the length, 25 cm at most; off the line
    it is within a fifth of the length, 5 to 30 m.  Never true where the ends coincide (2 cm).
    """
    d, off = col(length), col(direction) - col(bearing)
    along, aside, gap = col(distance) * cosd(off), F.abs(col(distance) * sind(off)), F.least(F.lit(0.25), d * 0.005)
    return F.coalesce((d > 0.02) & along.between(gap, d - gap) & (aside <= clamp(d * 0.2, F.lit(5.0), F.lit(30.0))), F.lit(False))

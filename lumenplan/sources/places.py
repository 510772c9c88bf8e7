"""Map features, landmarks, structures, gazetteers and time-zone polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..functions.angles import let
from ..functions.earth import local_metres
from ..functions.text import literal_place, nfkc, title_score
from ..operators.cells import cells_around, line_cells
from ..operators.joins import in_polygon, ocean_zone, unmatched
from ..operators.lineage import cut, spread
from ..operators.ranking import first_per_key, top_per_key

ELEMENT_SCHEMA = (
    "elements array<struct<type:string, id:long, lat:double, lon:double, center:struct<lat:double, lon:double>,"
    " geometry:array<struct<lat:double, lon:double>>, tags:map<string,string>>>"
)
STRUCTURE_SCHEMA = "name string, type string, latitude double, longitude double, structure_height double, osm_type string, osm_id long"
#: Metres within which features of a kind are looked up, and how many are kept.
ACCESS_RADIUS, DETAIL_RADIUS, STRUCTURE_RADIUS = 120.0, 600.0, 1800.0
LANDMARKS, BUILDINGS, STRUCTURES, COMBINED = 8, 8, 24, 16
METRES_A_DEGREE = 111320.0


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows (type, id, geometry, tags, bounds) of a map snapshot in JSON."""
    raw = spark.read.schema(ELEMENT_SCHEMA).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    return with_bounds(raw)


def with_bounds(elements: DataFrame) -> DataFrame:
    """Elements with one geometry column and their bounds, which scans can be pruned by."""
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(F.struct("lat", "lon")))
    shape = F.coalesce(F.filter("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), point, F.when(F.col("center").isNotNull(), F.array("center")))
    bound = lambda f, g, k: f(F.transform(g, lambda p: p[k]))
    # each outline is made once; as the only row of an explode it is not made again for the test and the bounds
    whole = let(shape, lambda g: F.struct(
        g.alias("geometry"), bound(F.array_min, g, "lat").alias("south"), bound(F.array_max, g, "lat").alias("north"),
        bound(F.array_min, g, "lon").alias("west"), bound(F.array_max, g, "lon").alias("east"),
    ))
    rows = elements.select("type", "id", "tags", F.explode(F.filter(F.array(whole), lambda w: F.size(w["geometry"]) > 0)).alias("_w"))
    return rows.select("type", "id", "_w.geometry", "tags", "_w.south", "_w.north", "_w.west", "_w.east")


def relevant(elements: DataFrame) -> DataFrame:
    """Elements with a tag that any rule looks at."""
    names = ("highway", "access", "foot", "tourism", "man_made", "building", "natural", "landuse", "barrier", "historic", "amenity", "ceremonial_gate")
    return elements.where(F.arrays_overlap(F.map_keys("tags"), F.array(*[F.lit(n) for n in names])))


def curve_place(lat: Column, lon: Column) -> Column:
    """Place along a space-filling curve: the bits of 16 of latitude and longitude in turn."""
    y, x = F.floor((lat + 90) / F.lit(180.0) * 65535).cast("long"), F.floor((lon + 180) / F.lit(360.0) * 65535).cast("long")
    bit = lambda v, k, out: F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), out)
    code = F.lit(0).cast("long")
    for k in range(16):
        code = code.bitwiseOR(bit(y, k, 2 * k + 1)).bitwiseOR(bit(x, k, 2 * k))
    return code


def save_elements(elements: DataFrame, path: str, files: int = 64, rows_a_group: int = 20_000) -> None:
    """Write elements with bounds along the curve, so that the statistics of files and row groups are small areas."""
    placed = elements.withColumn("place", curve_place((F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2))
    ordered = placed.repartitionByRange(files, "place").sortWithinPartitions("place")
    ordered.write.option("parquet.block.row.count.limit", rows_a_group).mode("overwrite").parquet(path)


def elements_in_bounds(spark: SparkSession, path: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """The saved elements whose bounds meet an area; the comparisons reach the scan, which skips all other row groups."""
    inside = (F.col("north") >= south) & (F.col("south") <= north) & (F.col("east") >= west) & (F.col("west") <= east)
    return spark.read.parquet(path).where(inside).drop("place")


def near_segments(points: DataFrame, elements: DataFrame, radius: float, key: str = "key") -> DataFrame:
    """The segments of elements at most ``radius`` metres from points (key, lat, lon): key, type, id, ``ends`` in local metres, ``distance``.

    A segment is spread over the cells that it passes, so a long line costs its length in cells and not
    the area of its bounds.  A single point is a segment without length.  A segment may come more than once.
    """
    cell = radius / METRES_A_DEGREE * 2
    last = F.greatest(F.size("geometry") - 1, F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(F.element_at("geometry", k).alias("a"), F.element_at("geometry", F.least(k + 1, F.size("geometry"))).alias("b")))
    segments = elements.select("type", "id", F.explode(pairs).alias("s")).select("type", "id", *[F.col(f"s.{e}.{c}").alias(e + c) for e in "ab" for c in ("lat", "lon")])
    asks = cells_around(points.select(key, F.col("lat").alias("plat"), F.col("lon").alias("plon")), cell, cell / 2, "plat", "plon")
    met = asks.join(line_cells(segments, cell), ["_cy", "_cx"])
    end = lambda e: local_metres(F.col(e + "lat"), F.col(e + "lon"), F.col("plat"), F.col("plon"))
    measured = met.withColumn("ends", F.array(end("a"), end("b"))).withColumn("distance", features.distance_to("ends"))
    return measured.where(F.col("distance") <= radius).select(key, "type", "id", "ends", "distance")


def near_points(points: DataFrame, elements: DataFrame, radius: float, key: str = "key") -> DataFrame:
    """Pairs of points and elements at most ``radius`` metres away or around the point, with ``distance`` and ``inside``.

    Distances are taken by segment and combined per element before the shuffle; areas contain a point by
    their cells.  Only where an area contains a point and no edge is near, its whole outline is measured.
    Different places are met with different outlines, which a digest of 128 bits tells apart; what is found
    is then given to all points of a place and all elements of an outline.
    """
    held = points.select(key, "lat", "lon").where("lat is not null and lon is not null")
    asked = held.select(F.struct("lat", "lon").alias(key), "lat", "lon").distinct()
    digest = let("geometry", lambda g: F.struct(g.alias("g"), F.xxhash64(g).alias("a"), F.xxhash64(F.lit(1), g).alias("b")))
    marked = elements.withColumn("_w", F.explode(F.array(digest)))  # an outline that is computed is so once for both
    marked = marked.withColumn("geometry", F.col("_w.g")).withColumn("_s", F.struct("_w.a", "_w.b")).drop("_w")
    shapes = spread(marked.select("_s", "geometry").distinct().select(F.col("_s.a").alias("type"), F.col("_s.b").alias("id"), "geometry"))
    found = _near_shapes(asked, cut(shapes), radius, key)
    found = found.select(F.col(f"{key}.lat").alias("lat"), F.col(f"{key}.lon").alias("lon"), F.struct(F.col("type").alias("a"), F.col("id").alias("b")).alias("_s"), "distance", "inside")
    return held.join(found, ["lat", "lon"]).drop("lat", "lon").join(marked.drop("geometry"), "_s").drop("_s")


def _near_shapes(points: DataFrame, elements: DataFrame, radius: float, key: str) -> DataFrame:
    """key, type, id, distance and inside for different points and different outlines."""
    near = near_segments(points, elements, radius, key).groupBy(key, "type", "id").agg(F.min("distance").alias("distance"))
    closed = (F.size("geometry") >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    areas = elements.where(closed).select("type", "id", F.col("geometry").alias("ring"))
    around = in_polygon(points.select(key, "lat", "lon"), areas, "lat", "lon").select(key, "type", "id", F.lit(True).alias("inside"))
    found = near.join(around, [key, "type", "id"], "full").withColumn("inside", F.coalesce("inside", F.lit(False)))
    named = found.where("distance IS NOT NULL")
    deep = found.where("distance IS NULL").drop("distance").join(elements, ["type", "id"]).join(points.select(key, F.col("lat").alias("plat"), F.col("lon").alias("plon")), key)
    local = F.transform("geometry", lambda p: local_metres(p["lat"], p["lon"], F.col("plat"), F.col("plon")))
    return named.unionByName(deep.withColumn("distance", features.distance_to(local)).drop("plat", "plon", "geometry"))


def site_contexts(points: DataFrame, elements: DataFrame, key: str = "key") -> DataFrame:
    """Points with four flags: walkable, on a mapped way, on a motor road, restricted; all false where nothing is mapped."""
    pairs = near_points(points, elements, ACCESS_RADIUS, key)
    d = F.col("distance")
    flags = pairs.groupBy(key).agg(
        F.bool_or(features.walkable(d)).alias("walkable"), F.bool_or(features.on_way(d)).alias("on_way"),
        F.bool_or(features.on_motor_road(d)).alias("on_motor_road"), F.bool_or(features.restricted(d, F.col("inside"))).alias("restricted"),
    )
    names = ("walkable", "on_way", "on_motor_road", "restricted")
    return points.join(flags, key, "left").select(*points.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])


def passes_site(require_walkable: bool, avoid_restricted: bool, avoid_way: bool, avoid_motor: bool):
    """The predicate of the four site constraints."""
    ok = F.lit(True)
    for wanted, test in ((require_walkable, F.col("walkable")), (avoid_restricted, ~F.col("restricted")), (avoid_way, ~F.col("on_way")), (avoid_motor, ~F.col("on_motor_road"))):
        ok = ok & test if wanted else ok
    return ok


def landmarks(points: DataFrame, elements: DataFrame, key: str = "key") -> DataFrame:
    """The eight nearest landmarks of every point."""
    rows = near_points(points, elements, DETAIL_RADIUS, key).withColumn("kind", features.landmark_type()).where("kind is not null")
    rows = rows.withColumn("metres", F.floor(F.col("distance") + 0.5).cast("long"))
    return top_per_key(rows, [key], [F.col("metres"), F.col("id")], LANDMARKS).select(key, "kind", "metres", "type", "id")


def structures(points: DataFrame, elements: DataFrame, surveyed: DataFrame, key: str = "key") -> DataFrame:
    """The 24 nearest tall structures; surveyed ones replace map elements of the same type and id."""
    rows = near_points(points, elements, STRUCTURE_RADIUS, key).withColumn("kind", features.structure_type()).where("kind is not null")
    mapped = rows.select(key, "kind", F.floor(F.col("distance") + 0.5).cast("long").alias("metres"), "type", "id", features.building_height()["height"].alias("height"), F.lit(1).alias("rank"))
    known = with_bounds(
        surveyed.select(F.col("osm_type").alias("type"), F.col("osm_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
            F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("geometry"),
            F.create_map(F.lit("kind"), F.col("type"), F.lit("height"), F.col("structure_height").cast("string")).alias("tags"))
    )
    own = near_points(points, known, STRUCTURE_RADIUS, key)
    own = own.select(key, features.tag("kind").alias("kind"), F.floor(F.col("distance") + 0.5).cast("long").alias("metres"), "type", "id", features.metres(features.tag("height")).alias("height"), F.lit(0).alias("rank"))
    merged = first_per_key(own.unionByName(mapped), [key, "type", "id"], [F.col("rank")]).drop("rank")
    return top_per_key(merged, [key], [F.col("metres"), F.col("id")], STRUCTURES).drop("place")


def combined(found_landmarks: DataFrame, found_structures: DataFrame, key: str = "key") -> DataFrame:
    """The 16 nearest of structures and of the landmarks that no structure of the same kind and distance repeats."""
    others = unmatched(found_landmarks.select(key, "kind", "metres", "type", "id"), found_structures.select(key, "kind", "metres"), [key, "kind", "metres"])
    both = found_structures.select(key, "kind", "metres", "type", "id").unionByName(others)
    return top_per_key(both, [key], [F.col("metres"), F.col("kind"), F.col("id")], COMBINED)


def surveyed_structures(spark: SparkSession, path: str) -> DataFrame:
    """The table of surveyed structures, a small CSV with header."""
    return spark.read.schema(STRUCTURE_SCHEMA).option("header", True).csv(path)


def geocode(queries: DataFrame, gazetteer: DataFrame, query: str = "query", any_title: bool = False) -> DataFrame:
    """The best place per query: a literal "lat, lon", else the best title (score, then length, then order).

    ``gazetteer`` has (title, lat, lon, idx).  A title that holds the query is found by the query's first
    two characters among the title's pairs, one that the query holds by its own first two among the
    query's, so that no query meets the whole table.  With ``any_title`` a query that no title fits gets
    the shortest title (score 4), as for a gazetteer that has been searched before.
    """
    asks = queries.select(query).distinct().withColumn("_q", nfkc(query)).withColumn("_literal", literal_place(query))
    titles = gazetteer.withColumn("_t", nfkc("title"))
    first = lambda c: F.substring(c, 1, 2)
    every = lambda c: F.explode(
        F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda k: F.array(F.substring(F.col(c), k, F.lit(1)), F.substring(F.col(c), k, F.lit(2))))))
    )
    left = asks.where("_literal is null and _q != ''")
    holding = left.withColumn("_k", first("_q")).join(titles.withColumn("_k", every("_t")), "_k")
    held = left.withColumn("_k", every("_q")).join(titles.where("_t != ''").withColumn("_k", first("_t")), "_k")
    pairs = holding.unionByName(held).withColumn("score", title_score(F.col("_q"), F.col("_t"))).where("score < 4")
    order = [F.col("score"), F.length("title"), F.col("idx")]
    best = first_per_key(pairs, [query], order).select(query, "title", "lat", "lon", "score")
    if any_title:
        one = titles.select("title", "lat", "lon", "idx").orderBy(F.length("title"), "idx").limit(1).select("title", "lat", "lon", F.lit(4).alias("score"))
        rest = left.select(query).join(best.select(query), query, "left_anti")
        best = best.unionByName(rest.join(F.broadcast(one)))
    literal = asks.where("_literal is not null").select(query, F.col(query).alias("title"), "_literal.lat", "_literal.lon", F.lit(0).alias("score"))
    return queries.join(best.unionByName(literal), query, "left")


def time_zones(points: DataFrame, polygons: DataFrame, key: str = "key") -> DataFrame:
    """The zones of every point (key, lat, lon): those of the polygons (zone, ring) that contain it, else the ocean's."""
    inside = in_polygon(points, polygons, "lat", "lon").groupBy(key).agg(F.array_sort(F.collect_set("zone")).alias("zones"))
    return points.join(inside, key, "left").withColumn("zones", F.coalesce("zones", F.array(ocean_zone(F.col("lon")))))


def corridor(points: DataFrame, elements: DataFrame, key: str, azimuth: str, radius: float = 2000.0, half_width: float = 15.0) -> DataFrame:
    """Obstacles on the ray of every point (key, lat, lon, azimuth): off, along, height; only ahead and in the corridor.

    Each near segment is tried by itself, and the best of an element is kept.
    """
    obstacles = elements.withColumn("obstacle", features.obstacle_height()).where("obstacle IS NOT NULL")
    near = near_segments(points, obstacles, radius, key).join(points.select(key, azimuth), key)
    met = near.withColumn("_m", features.ray_approach("ends", F.col(azimuth))).where((F.col("_m.off") <= half_width) & (F.col("_m.along") <= radius))
    best = met.groupBy(key, "type", "id").agg(F.min("_m").alias("_m"))
    return best.join(obstacles.select("type", "id", "obstacle"), ["type", "id"]).select(key, "type", "id", F.col("_m.off").alias("off"), F.col("_m.along").alias("along"), "obstacle")

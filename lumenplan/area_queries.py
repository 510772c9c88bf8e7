"""Queries of areas, lines and searches by place, with SQL that tries every pair."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import policy, sky, text
from .functions.earth import K_STANDARD, MEAN_RADIUS, SEMI_MAJOR
from .functions.geodesic import geodesic_inverse
from .operators import lineage, ranking, sampling
from .plans import occlusion, spot
from .queries import lat_of, lon_of, query, sql_lat, sql_lon, sql_sun, table
from .sources import dem, places

#: Vertices of the outline that every nation gets: a star around a place of its own.
VERTICES = 720
_TURN = f"(2 * pi() * (i % {VERTICES}) / {VERTICES})"
_STAR = f"(2.5::DOUBLE * (1 + 0.4::DOUBLE * sin(7 * {_TURN})))"


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    turn = lambda i: F.lit(2.0) * F.pi() * (i % VERTICES) / VERTICES
    radius = lambda i: F.lit(2.5) * (1 + F.lit(0.4) * F.sin(turn(i) * 7))
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(VERTICES)),
        lambda i: F.struct((F.lit(31.0) + n % 5 * 2 + radius(i) * F.sin(turn(i))).alias("lat"), (F.lit(131.0) + n % 7 * 1.5 + radius(i) * F.cos(turn(i))).alias("lon")),
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), ring.alias("ring"))


@query(
    "zones_of_places",
    f"""WITH v AS (SELECT n_name, i, 31.0::DOUBLE + n_nationkey % 5 * 2 + {_STAR} * sin({_TURN}) AS y, 131.0::DOUBLE + n_nationkey % 7 * 1.5::DOUBLE + {_STAR} * cos({_TURN}) AS x FROM nation, range(0, {VERTICES + 1}) r(i)),
    e AS (SELECT a.n_name, a.y AS ay, a.x AS ax, b.y AS cy, b.x AS cx FROM v a JOIN v b ON a.n_name = b.n_name AND b.i = a.i + 1),
    p AS (SELECT c_custkey AS id, {sql_lat("c_custkey")} + 0.0037::DOUBLE AS y, {sql_lon("c_custkey")} + 0.0041::DOUBLE AS x FROM customer),
    c AS (SELECT id, n_name FROM p JOIN e ON (ay > y) <> (cy > y) AND (cx - ax) * (y - ay) / (cy - ay) + ax > x GROUP BY id, n_name HAVING count(*) % 2 = 1),
    o AS (SELECT id, floor((x + 7.5) / 15)::INTEGER AS h FROM p)
    SELECT o.id, coalesce(z.zones, CASE WHEN h = 0 THEN 'Etc/GMT' WHEN h > 0 THEN 'Etc/GMT-' || h ELSE 'Etc/GMT+' || -h END) AS zones
    FROM o LEFT JOIN (SELECT id, string_agg(n_name, ',' ORDER BY n_name) AS zones FROM c GROUP BY id) z USING (id)""",
)
def zones_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones whose outlines contain every customer's place, else the ocean's."""
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (lat_of("c_custkey") + F.lit(0.0037)).alias("lat"), (lon_of("c_custkey") + F.lit(0.0041)).alias("lon"))
    found = places.time_zones(points, _outline(spark, sf_dir))
    return found.select(F.col("key").alias("id"), F.array_join("zones", ",").alias("zones"))


#: Bends of the way that every part becomes.
BENDS = 40


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Parts dealt over tasks, and the way that each becomes."""
    k = F.col("p_partkey")
    parts = lineage.spread(table(spark, sf_dir, "part").select("p_partkey", lat_of("p_partkey").alias("y"), lon_of("p_partkey").alias("x")))
    path = F.transform(
        F.sequence(F.lit(0), F.lit(BENDS - 1)),
        lambda i: F.struct((F.col("y") + i * F.lit(0.004) + F.lit(0.003) * ((k + i) % 3)).alias("lat"), (F.col("x") + i * F.lit(0.0031) - F.lit(0.002) * ((k + i) % 4)).alias("lon")),
    )
    return parts, path


@query(
    "ways_near_places",
    f"""WITH v AS (SELECT p_partkey AS way, i, {sql_lat("p_partkey")} + i * 0.004::DOUBLE + 0.003::DOUBLE * ((p_partkey + i) % 3) AS lat, {sql_lon("p_partkey")} + i * 0.0031::DOUBLE - 0.002::DOUBLE * ((p_partkey + i) % 4) AS lon FROM part, range(0, {BENDS}) r(i)),
    s AS (SELECT a.way, a.lat AS a1, a.lon AS o1, b.lat AS a2, b.lon AS o2 FROM v a JOIN v b ON a.way = b.way AND b.i = a.i + 1),
    p AS (SELECT s_suppkey AS id, {sql_lat("s_suppkey")} + 0.0137::DOUBLE AS lat, {sql_lon("s_suppkey")} + 0.0123::DOUBLE AS lon FROM supplier),
    j AS (SELECT id, way, (o1 - lon) * k * cos(radians(lat)) AS ax, (a1 - lat) * k AS ay, (o2 - lon) * k * cos(radians(lat)) AS cx, (a2 - lat) * k AS cy
      FROM p JOIN s ON greatest(a1, a2) > lat - 0.02 AND least(a1, a2) < lat + 0.02 AND greatest(o1, o2) > lon - 0.04 AND least(o1, o2) < lon + 0.04 CROSS JOIN (SELECT {pi * MEAN_RADIUS / 180}::DOUBLE AS k)),
    t AS (SELECT *, greatest(0.0, least(1.0, -(ax * (cx - ax) + ay * (cy - ay)) / ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)))) AS t FROM j),
    d AS (SELECT id, way, min(sqrt(pow(ax + t * (cx - ax), 2) + pow(ay + t * (cy - ay), 2))) AS d FROM t GROUP BY id, way)
    SELECT id, way, round(d, 5) AS distance FROM d WHERE d <= 800""",
)
def ways_near_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with many bends within 800 m of suppliers."""
    parts, path = _paths(spark, sf_dir)
    ways = parts.select(F.lit("way").alias("type"), F.col("p_partkey").alias("id"), path.alias("geometry"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (lat_of("s_suppkey") + F.lit(0.0137)).alias("lat"), (lon_of("s_suppkey") + F.lit(0.0123)).alias("lon"))
    found = places.near_points(points, ways, 800.0)
    return found.select(F.col("key").alias("id"), F.col("id").alias("way"), F.round("distance", 5).alias("distance"))


_ANSWER = "(30.0::DOUBLE + lat * 0.1::DOUBLE - lon * 0.01::DOUBLE)"
_EVENT_PLACES = f"SELECT event_id, user_id, {sql_lat('event_id')} + (event_id % 7) * 0.001::DOUBLE AS lat, {sql_lon('event_id')} AS lon FROM events"


@query(
    "geoid_answers",
    f"""WITH e AS (SELECT *, floor(lat * 100 + 0.5)::INTEGER AS a, floor(lon * 100 + 0.5)::INTEGER AS o FROM ({_EVENT_PLACES})),
    r AS (SELECT a, o, min_by(lat, event_id) AS lat, min_by(lon, event_id) AS lon FROM e GROUP BY a, o)
    SELECT event_id, round({_ANSWER}, 6) AS geoid_height FROM (SELECT e.event_id, r.lat, r.lon FROM e JOIN r USING (a, o))""",
)
def geoid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the geoid height that was asked for once in its region."""
    points = table(spark, sf_dir, "events").select("event_id", (lat_of("event_id") + F.col("event_id") % 7 * F.lit(0.001)).alias("lat"), lon_of("event_id").alias("lon"))
    asked = dem.region_representatives(points, "lat", "lon", "event_id")
    answers = asked.select("region_lat", "region_lon", (F.lit(30.0) + F.col("lat") * 0.1 - F.col("lon") * 0.01).alias("geoid_height"))
    return dem.fan_out(points, answers, "lat", "lon", "event_id").select("event_id", F.round("geoid_height", 6).alias("geoid_height"))


@query(
    "last_network_events",
    """SELECT kind, event_id, place FROM (SELECT user_id % 5 AS kind, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 50""",
)
def last_network_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest network events of each kind."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("kind"), "event_id", "ts")
    return ranking.top_per_key(e, ["kind"], [F.desc("ts"), F.col("event_id")], 50).select("kind", "event_id", "place")


@query(
    "first_daylight_events",
    f"""SELECT event_id, round(alt, 6) AS altitude FROM ({sql_sun(f"SELECT event_id, ts, epoch_us(ts) AS t_us, {sql_lat('event_id')} AS lat, {sql_lon('event_id')} AS lon FROM events")}) WHERE alt > 30 ORDER BY ts, event_id LIMIT 100""",
)
def first_daylight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred events under a high Sun, searched window by window."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("instant"), lat_of("event_id").alias("lat"), lon_of("event_id").alias("lon"))
    high = lambda rows: sky.add_sun(rows).where("altitude > 30")
    return ranking.earliest_by_windows(e, "instant", "event_id", 100, 6 * 3600, high).select("event_id", F.round("altitude", 6).alias("altitude"))


_STEP_DEGREES = f"(10000.0::DOUBLE / {SEMI_MAJOR}::DOUBLE * 180 / pi())"


@query(
    "base_lines",
    f"""WITH s AS (SELECT c_custkey AS id, (c_custkey * 53 % 360 - 180)::DOUBLE AS lon, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS way, i FROM customer, range(0, 25) r(i) WHERE c_custkey % 5 <> 0),
    p AS (SELECT id, i AS idx, way, lon + way * i * {_STEP_DEGREES} AS a, lon + way * (i + 1) * {_STEP_DEGREES} AS b FROM s),
    w AS (SELECT *, ((a + 540.0) % 360.0 + 360.0) % 360.0 - 180.0 AS lon1, ((b + 540.0) % 360.0 + 360.0) % 360.0 - 180.0 AS lon2 FROM p),
    c AS (SELECT id, idx, 0 AS part, lon1, CASE WHEN abs(lon2 - lon1) > 180 THEN sign(lon1) * 180.0 ELSE lon2 END AS lon2 FROM w
      UNION ALL SELECT id, idx, 1, -sign(lon1) * 180.0, lon2 FROM w WHERE abs(lon2 - lon1) > 180)
    SELECT id, idx::INTEGER AS idx, part::INTEGER AS part, round(lon1, 6) AS lon1, round(lon2, 6) AS lon2 FROM c WHERE abs(lon1) < 179.9999999 OR part = 1""",
)
def base_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 250 km along the equator away from bodies above the horizon, cut at the 180th meridian."""
    k = F.col("c_custkey")
    subjects = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.lit(0.0).alias("lat"), (k * 53 % 360 - 180).cast("double").alias("lon"), F.when(k % 2 == 0, 270.0).otherwise(90.0).alias("azimuth"), F.when(k % 5 == 0, -1.0).otherwise(20.0).alias("altitude")
    )
    lines = sampling.base_lines(lineage.spread(subjects), "lat", "lon", "azimuth", "altitude")
    return lines.where((F.abs("lon1") < 179.9999999) | (F.col("part") == 1)).select("id", F.col("idx").cast("int").alias("idx"), F.col("part").cast("int").alias("part"), F.round("lon1", 6).alias("lon1"), F.round("lon2", 6).alias("lon2"))


@query(
    "refined_places",
    """WITH o AS (SELECT s_suppkey AS key, (s_suppkey % 9 - 4) * 0.03::DOUBLE AS wanted FROM supplier),
    p AS (SELECT key, wanted, 0 AS radius, 0 AS bearing FROM o UNION ALL SELECT key, wanted, r * 5, b * 30 FROM o, range(1, 5) x(r), range(0, 12) y(b)),
    h AS (SELECT *, 0.01::DOUBLE * radius * cos(radians(bearing)) AS height FROM p WHERE NOT (key % 4 = 0 AND bearing = 0)),
    e AS (SELECT *, abs(height - wanted) AS error FROM h WHERE NOT (key % 3 = 0 AND bearing BETWEEN 100 AND 200)),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY floor(error / 1e-6 + 0.5), radius, bearing) AS k FROM e)
    SELECT key, radius::INTEGER AS radius, bearing::INTEGER AS bearing, round(error, 6) AS error FROM n WHERE k = 1""",
)
def refined_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 49 points around every supplier on sloping ground; points without a height or a free line are left out."""
    origins = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), lat_of("s_suppkey").alias("lat"), lon_of("s_suppkey").alias("lon"))
    part = lambda k: F.element_at(F.split("key", ":"), k).cast("double")
    slope = F.lit(0.01) * part(2) * F.cos(F.radians(part(3)))
    sampler = lambda asks: asks.withColumn("height", F.when(~((part(1) % 4 == 0) & (part(3) == 0)), slope))
    wanted = (F.col("key") % 9 - 4) * F.lit(0.03)
    evaluate = lambda rows: rows.withColumn("error", F.abs(F.col("height") - wanted))
    checks = lambda rows: rows.withColumn("clear", ~((F.col("key") % 3 == 0) & F.col("bearing").between(100, 200)))
    best, _ = spot.refine(origins, sampler, evaluate, checks=checks)
    return best.select("key", F.col("radius").cast("int").alias("radius"), F.col("bearing").cast("int").alias("bearing"), F.round("error", 6).alias("error"))


@query(
    "request_keys",
    f"""SELECT event_id, sha256(printf('%.5f|%.5f|1m', lat, lon)) AS key FROM ({_EVENT_PLACES})""",
)
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached height requests."""
    e = table(spark, sf_dir, "events").select("event_id", (lat_of("event_id") + F.col("event_id") % 7 * F.lit(0.001)).alias("lat"), lon_of("event_id").alias("lon"))
    return e.select("event_id", text.cache_key(F.col("lat"), F.col("lon"), "1m").alias("key"))


_TAGS = ["highway", "shop", "tourism", "name", "building", "office", "natural", "sport", "historic"]


@query(
    "relevant_elements",
    f"""SELECT p_partkey AS id FROM part WHERE ({_TAGS!r})[(p_partkey % {len(_TAGS)}) + 1] NOT IN ('shop', 'name', 'office', 'sport') OR p_size % 10 = 3""",
)
def relevant_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements with a tag that any rule looks at."""
    first = F.get(F.array(*[F.lit(t) for t in _TAGS]), (F.col("p_partkey") % len(_TAGS)).cast("int"))
    second = F.when(F.col("p_size") % 10 == 3, F.lit("amenity")).otherwise(F.lit("note"))
    elements = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(first, F.lit("yes"), second, F.lit("x")).alias("tags"))
    return places.relevant(elements).select("id")


_K = f"(1 - {K_STANDARD}::DOUBLE)"
_RADIUS = f"{MEAN_RADIUS}::DOUBLE"


@query(
    "line_of_sight",
    f"""WITH b AS (SELECT event_id AS key, user_id, value / 50 - 1 AS altitude FROM events),
    t AS (SELECT key, (user_id % 30) / 10.0::DOUBLE AS terrain, (user_id % 50) * 700.0::DOUBLE + 40 AS distance FROM b WHERE key % 5 <> 0),
    o AS (SELECT key, 12.0::DOUBLE + key % 40 + n * 3 AS height, 150.0::DOUBLE + user_id % 70 * 9 + n * 55 AS along FROM b, range(0, 3) r(n) WHERE key % 4 <> 1),
    s AS (SELECT key, max(degrees(atan2(height - 1.6 - along * along / (2 * ({_RADIUS} / {_K})), along))) AS surface FROM o GROUP BY key),
    h AS (SELECT b.key, altitude, distance, CASE WHEN surface > terrain THEN surface ELSE terrain END AS horizon, CASE WHEN surface > terrain THEN 'surface' WHEN terrain IS NOT NULL THEN 'terrain' END AS source FROM b LEFT JOIN t USING (key) LEFT JOIN s ON s.key = b.key AND t.key IS NOT NULL),
    c AS (SELECT *, greatest(0.015::DOUBLE, degrees((0.2 - 0.05)::DOUBLE * distance / (2 * {_RADIUS})) / 2) AS band, round(altitude - horizon, 9) AS clear FROM h),
    v AS (SELECT *, CASE WHEN altitude <= 0 THEN 'obstructed' WHEN horizon IS NULL THEN 'visible' WHEN clear < -band THEN 'obstructed' WHEN clear <= band THEN 'uncertain' ELSE 'visible' END AS status FROM c)
    SELECT key AS event_id, round(horizon, 6) AS horizon, status, CASE WHEN altitude <= 0 THEN 'below-horizon' WHEN status = 'obstructed' THEN CASE WHEN source = 'surface' THEN 'building-or-surface' ELSE 'terrain' END ELSE 'clear' END AS reason FROM v""",
)
def line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether terrain or the obstacles of a corridor hide a body at every event."""
    k, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf_dir, "events")
    bodies = e.select(k.alias("key"), (F.col("value") / 50 - 1).alias("altitude"))
    terrain = e.where(k % 5 != 0).select(k.alias("key"), (u % 30 / F.lit(10.0)).alias("elevation"), (u % 50 * F.lit(700.0) + 40).alias("distance"))
    n = F.explode(F.sequence(F.lit(0), F.lit(2)))
    obstacles = e.where(k % 4 != 1).select(k.alias("key"), u.alias("u"), n.alias("id")).select(
        "key", "id", (F.lit(12.0) + F.col("key") % 40 + F.col("id") * 3).alias("obstacle"), (F.lit(150.0) + F.col("u") % 70 * 9 + F.col("id") * 55).alias("along")
    )
    found = occlusion.verdict(bodies, terrain, occlusion.surface_horizon(obstacles, "key", F.lit(1.6)))
    return found.select(F.col("key").alias("event_id"), F.round("horizon", 6).alias("horizon"), "status", "reason")


@query(
    "equator_lines",
    f"""SELECT c_custkey AS id, round(radians(c_custkey % 90 + 0.5::DOUBLE) * {SEMI_MAJOR}::DOUBLE, 5) AS distance, CASE WHEN c_custkey % 2 = 0 THEN 90.0 ELSE 270.0 END::DOUBLE AS azimuth FROM customer""",
)
def equator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines along the equator, whose length is known (F1)."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(0.0).alias("a"), (k * 53 % 80).cast("double").alias("o"), (F.when(k % 2 == 0, 1).otherwise(-1) * (k % 90 + F.lit(0.5))).alias("turn"))
    line = lineage.spread(p).withColumn("o2", F.col("o") + F.col("turn")).withColumn("g", geodesic_inverse("a", "o", "a", "o2"))
    return line.select("id", F.round("g.distance", 5).alias("distance"), F.round("g.azimuth", 6).alias("azimuth"))


@query(
    "disc_edges",
    """WITH d AS (SELECT event_id, (user_id * 7 % 360)::DOUBLE AS az, (event_id % 80)::DOUBLE AS alt, i, 0.27::DOUBLE AS r, radians((i - 1) * 30.0::DOUBLE) AS turn FROM events, range(0, 13) x(i))
    SELECT event_id, i::INTEGER AS edge, round((((az + CASE WHEN i = 0 THEN 0 ELSE r * sin(turn) / greatest(0.05::DOUBLE, cos(radians(alt))) END) % 360.0) + 360.0) % 360.0, 6) AS azimuth, round(alt + CASE WHEN i = 0 THEN 0 ELSE r * cos(turn) END, 6) AS altitude FROM d""",
)
def disc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle and edge of a disc at every event."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 7 % 360).cast("double").alias("azimuth"), (F.col("event_id") % 80).cast("double").alias("altitude"))
    found = occlusion.disc_samples(e, F.lit(0.27), 12)
    return found.select("event_id", "edge", F.round("azimuth", 6).alias("azimuth"), F.round("altitude", 6).alias("altitude"))


@query(
    "first_of_each_type",
    "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE value > 20) WHERE n = 1",
)
def first_of_each_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type above a value."""
    e = table(spark, sf_dir, "events").where("value > 20")
    return ranking.first_per_key(e, ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_type", "event_id")


@query(
    "tripod_distances",
    """SELECT c_custkey AS id, round(least(10000.0, greatest(0.0, c_acctbal / 3)), 6) AS low, CASE WHEN c_nationkey % 3 = 0 THEN 3000.0 + 7000 ELSE round(least(10000.0, greatest(0.0, c_acctbal)), 6) END::DOUBLE AS high FROM customer""",
)
def tripod_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored least and most distances kept in their bounds."""
    high = F.when(F.col("c_nationkey") % 3 == 0, F.lit(1e9)).otherwise(F.col("c_acctbal"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), policy.distance_range(F.col("c_acctbal") / 3, high).alias("d"))
    return c.select("id", F.round("d.low", 6).alias("low"), F.round("d.high", 6).alias("high"))


@query(
    "broken_places",
    """WITH p AS (SELECT event_id, value - 50 AS latitude, user_id * 2.0::DOUBLE - 120 AS longitude, CASE WHEN event_id % 6 = 0 THEN 'NaN'::DOUBLE ELSE event_id % 30 + 1.0::DOUBLE END AS focal FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN NOT (abs(latitude) <= 90) THEN 'latitude' END, CASE WHEN NOT (abs(longitude) <= 180) THEN 'longitude' END, CASE WHEN isnan(focal) OR NOT focal BETWEEN 9 AND 1600 THEN 'focal' END], lambda x: x IS NOT NULL), ',') AS failed
    FROM p WHERE NOT (abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT isnan(focal) AND focal BETWEEN 9 AND 1600)""",
)
def broken_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose derived place or lens is out of bounds, with what failed (P25)."""
    e = table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") - 50).alias("latitude"), (F.col("user_id") * 2.0 - 120).alias("longitude"), F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("event_id") % 30 + F.lit(1.0)).alias("focal")
    )
    _, bad = policy.quarantine(e, {"latitude": "latitude", "longitude": "longitude", "focal": "focal"})
    return bad.select("event_id", F.array_join("failed", ",").alias("failed"))


@query(
    "way_bounds",
    f"""SELECT p_partkey AS id, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM (
      SELECT p_partkey, {sql_lat("p_partkey")} + i * 0.004::DOUBLE + 0.003::DOUBLE * ((p_partkey + i) % 3) AS lat, {sql_lon("p_partkey")} + i * 0.0031::DOUBLE - 0.002::DOUBLE * ((p_partkey + i) % 4) AS lon FROM part, range(0, {BENDS}) r(i)) GROUP BY 1""",
)
def way_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of ways."""
    parts, path = _paths(spark, sf_dir)
    null = F.lit(None)
    ways = parts.select(
        F.lit("way").alias("type"), F.col("p_partkey").alias("id"), null.cast("double").alias("lat"), null.cast("double").alias("lon"), null.cast("struct<lat:double,lon:double>").alias("center"), path.alias("geometry"), F.create_map(F.lit("highway"), F.lit("path")).alias("tags")
    )
    return places.with_bounds(ways).select("id", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])

"""Queries of Sun, Moon and stars by ephemeris segments, with SQL that evaluates the series themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import optics, sky
from .plans import passes, screen, spot
from .queries import DAY_END, DAY_START, ORACLE_SQL, _signed, lat_of, lon_of, query, r6, sql_lat, sql_lon, sql_sun, sql_wrap, table

DAY = 86_400_000_000


def r5(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 5)


def _sql_terms(text: str) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{v:.1f}" for v in row) + "]" for row in sky._terms(text).tolist()) + "]::DOUBLE[][]"


def _sql_total(terms: str, value: int, trig: str) -> str:
    return f"list_sum(list_transform({_sql_terms(terms)}, lambda r: r[{value}] * pow(e, abs(r[2])) * {trig}(r[1] * d + r[2] * m + r[3] * mm + r[4] * f)))"


def sql_moon(source: str) -> str:
    """SQL that adds az, alt, km, phase and fraction of the Moon to rows with t_us, lat, lon."""
    return f"""SELECT * EXCLUDE (n, t, mean, d, m, mm, f, e, ml, mb, mk, node, tilt, ra, de, r, turn, x, y, z, sun),
      {sql_wrap("degrees(atan2(-y, z * cos(radians(lat)) - x * sin(radians(lat))))")} AS az,
      degrees(asin(greatest(-1.0, least(1.0, (z * sin(radians(lat)) + x * cos(radians(lat))) / sqrt(x*x + y*y + z*z))))) AS alt,
      sqrt(x*x + y*y + z*z) AS km, {sql_wrap("ml - sun")} AS phase, (1 - cos(acos(greatest(-1.0, least(1.0, cos(radians(mb)) * cos(radians(ml - sun))))))) / 2 AS fraction
    FROM (SELECT *, r * cos(de) * cos(turn) - 6378.137 * cos(atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat)))) AS x, r * cos(de) * sin(turn) AS y,
      r * sin(de) - 6378.137 * (1 - 1 / 298.257223563::DOUBLE) * sin(atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat)))) AS z,
      280.460 + 0.9856474*n + 1.915*sin(radians(357.528 + 0.9856003*n)) + 0.020*sin(2*radians(357.528 + 0.9856003*n)) AS sun
    FROM (SELECT *, radians({sql_wrap("280.46061837 + 360.98564736629*n + lon")}) - ra AS turn
    FROM (SELECT *, atan2(sin(radians(ml)) * cos(tilt) - tan(radians(mb)) * sin(tilt), cos(radians(ml))) AS ra,
      asin(sin(radians(mb)) * cos(tilt) + cos(radians(mb)) * sin(tilt) * sin(radians(ml))) AS de, mk AS r
    FROM (SELECT * REPLACE (ml - 0.00478 * sin(node) AS ml), radians(23.4392911 - 0.0130042 * t + 0.00256 * cos(node)) AS tilt
    FROM (SELECT *, radians(125.04452 - 1934.136261 * t) AS node,
      mean + ({_sql_total(sky._LONGITUDE, 5, "sin")} + 3958 * sin(radians(119.75 + 131.849 * t)) + 1962 * sin(radians(mean) - f) + 318 * sin(radians(53.09 + 479264.290 * t))) / 1e6 AS ml,
      ({_sql_total(sky._LATITUDE, 5, "sin")} - 2235 * sin(radians(mean)) + 382 * sin(radians(313.45 + 481266.484 * t)) + 175 * sin(radians(119.75 + 131.849 * t) - f) + 175 * sin(radians(119.75 + 131.849 * t) + f)
        + 127 * sin(radians(mean) - mm) - 115 * sin(radians(mean) + mm)) / 1e6 AS mb,
      385000.56 + {_sql_total(sky._LONGITUDE, 6, "cos")} / 1000 AS mk
    FROM (SELECT *, 218.3164477 + 481267.88123421 * t - 0.0015786 * t * t AS mean, radians(297.8501921 + 445267.1114034 * t - 0.0018819 * t * t) AS d, radians(357.5291092 + 35999.0502909 * t) AS m,
      radians(134.9633964 + 477198.8675055 * t + 0.0087414 * t * t) AS mm, radians(93.2720950 + 483202.0175233 * t - 0.0036539 * t * t) AS f, 1 - 0.002516 * t - 0.0000074 * t * t AS e
    FROM (SELECT *, n / 36525.0 AS t FROM (SELECT *, (t_us / 1e6 - 946728000.0) / 86400.0 AS n FROM ({source}) m0) m1) m2) m3) m4) m5) m6) m7) m8"""


def sql_star(source: str, star: tuple[float, float]) -> str:
    """SQL that adds az and alt of a star to rows with t_us, lat, lon."""
    ra, dec = f"({star[0] * 15!r}::DOUBLE + zeta)", f"radians({star[1]!r}::DOUBLE)"
    return f"""SELECT * EXCLUDE (n, t, zeta, zz, theta, sa, sb, sc, h),
      {sql_wrap("degrees(atan2(-cos(radians(sc))*sin(radians(h)), sin(radians(sc))*cos(radians(lat)) - cos(radians(sc))*cos(radians(h))*sin(radians(lat))))")} AS az,
      degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat))*sin(radians(sc)) + cos(radians(lat))*cos(radians(sc))*cos(radians(h)))))) AS alt
    FROM (SELECT * REPLACE (degrees(asin(greatest(-1.0, least(1.0, sc)))) AS sc), {sql_wrap("280.46061837 + 360.98564736629*n + lon")} - {sql_wrap("degrees(atan2(sa, sb)) + zz")} AS h
    FROM (SELECT *, cos({dec}) * sin(radians{ra}) AS sa, cos(radians(theta)) * cos({dec}) * cos(radians{ra}) - sin(radians(theta)) * sin({dec}) AS sb,
      sin(radians(theta)) * cos({dec}) * cos(radians{ra}) + cos(radians(theta)) * sin({dec}) AS sc
    FROM (SELECT *, (2306.2181*t + 0.30188*t*t + 0.017998*t*t*t) / 3600 AS zeta, (2306.2181*t + 1.09468*t*t + 0.018203*t*t*t) / 3600 AS zz, (2004.3109*t - 0.42665*t*t - 0.041833*t*t*t) / 3600 AS theta
    FROM (SELECT *, n / 36525.0 AS t FROM (SELECT *, (t_us / 1e6 - 946728000.0) / 86400.0 AS n FROM ({source}) p0) p1) p2) p3) p4) p5"""


def sql_sun_km(source: str) -> str:
    """As sql_sun, with the distance in km."""
    g = f"radians({sql_wrap('357.528 + 0.9856003*((t_us/1e6 - 946728000.0)/86400.0)')})"
    return f"SELECT *, (1.00014 - 0.01671*cos({g}) - 0.00014*cos(2*{g})) * {sky.AU_KM}::DOUBLE AS km FROM ({sql_sun(source)}) k0"


def sql_frame(source: str, radius: float | None) -> str:
    """SQL that adds dist and seen (any of the disc in the frame) to rows with az, alt, km, bearing, elevation, h_fov, v_fov."""
    disc = f"degrees(2*asin({radius}::DOUBLE / greatest({radius}::DOUBLE, km)))" if radius else "0.0::DOUBLE"
    return f"""SELECT * EXCLUDE (vx, vy, vz, fw, rt, up, di), degrees(acos(greatest(-1.0, least(1.0, fw)))) AS dist,
      coalesce(fw > 1e-8 AND alt + di / 2 > -1 AND abs(rt / fw) <= tan(radians(h_fov) / 2) + tan(radians(di) / 2) AND abs(up / fw) <= tan(radians(v_fov) / 2) + tan(radians(di) / 2), false) AS seen
    FROM (SELECT *, vx*cos(radians(elevation))*sin(radians(bearing)) + vy*cos(radians(elevation))*cos(radians(bearing)) + vz*sin(radians(elevation)) AS fw, vx*cos(radians(bearing)) - vy*sin(radians(bearing)) AS rt,
      -vx*sin(radians(bearing))*sin(radians(elevation)) - vy*cos(radians(bearing))*sin(radians(elevation)) + vz*cos(radians(elevation)) AS up, {disc} AS di
    FROM (SELECT *, cos(radians(alt))*sin(radians(az)) AS vx, cos(radians(alt))*cos(radians(az)) AS vy, sin(radians(alt)) AS vz FROM ({source}) f0) f1) f2"""


def _sql_inside(source: str) -> str:
    return f"SELECT *, seen AND alt > 0.25 AND alt >= elevation AS inside FROM ({sql_frame(sql_sun_km(source), sky.SUN_RADIUS_KM)}) i0"


#: Local minutes of the windows of in_frame_refined, the last one included.
FROM_MINUTE, TO_MINUTE, DAYS = 300, 1110, 2
_WINDOW_A, _WINDOW_B = f"({DAY_START} + day * {DAY} + {FROM_MINUTE * 60_000_000})", f"({DAY_START} + day * {DAY} + {(TO_MINUTE + 1) * 60_000_000})"
_FOV = "degrees(2 * atan(36.0::DOUBLE / (2 * focal))) AS h_fov, degrees(2 * atan(24.0::DOUBLE / (2 * focal))) AS v_fov"
_FRAMES = f"""SELECT *, greatest(60000000, least(600000000, floor(least(h_fov, v_fov) / 0.3::DOUBLE * 60000 / 4) * 1000))::BIGINT AS step FROM (SELECT *, {_FOV} FROM (
    SELECT s_suppkey AS id, {sql_lat("s_suppkey")} AS lat, {sql_lon("s_suppkey")} AS lon, (90 + s_suppkey * 97 % 180)::DOUBLE AS bearing, (s_suppkey * 7 % 50)::DOUBLE AS elevation,
      ([24.0, 50.0, 135.0]::DOUBLE[])[s_suppkey % 3 + 1] AS focal FROM supplier))"""


@query(
    "in_frame_refined",
    f"""WITH RECURSIVE p AS ({_FRAMES}), days AS (SELECT range AS day FROM range(0, {DAYS})),
    pts AS (SELECT id, day, {_WINDOW_A} AS t_us FROM p, days UNION SELECT id, day, {_WINDOW_B} FROM p, days
      UNION SELECT id, day, ({_WINDOW_B} // {DAY}) * {DAY} FROM p, days WHERE ({_WINDOW_B} // {DAY}) * {DAY} > {_WINDOW_A}
      UNION SELECT id, day, {DAY_START} + k * step FROM p, days, range(0, {DAYS * 1440}) g(k) WHERE {DAY_START} + k * step > {_WINDOW_A} AND {DAY_START} + k * step < {_WINDOW_B}),
    s AS ({_sql_inside("SELECT pts.day, pts.t_us, p.* FROM pts JOIN p USING (id)")}),
    w AS (SELECT *, lag(inside) OVER u AS ins0, lag(t_us) OVER u AS t0, lead(t_us) OVER u AS t1 FROM s WINDOW u AS (PARTITION BY id, day ORDER BY t_us)),
    n AS (SELECT *, sum(CASE WHEN inside AND NOT coalesce(ins0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY id, day ORDER BY t_us) AS island FROM w),
    r AS (SELECT id, day, island, min(t_us) AS i, max(t_us) AS j, arg_min(t0, t_us) AS i0, arg_max(t1, t_us) AS j1, list(t_us ORDER BY dist, t_us)[1] AS best, min(t0 IS NULL) AS x FROM n WHERE inside GROUP BY ALL),
    b AS (SELECT r.id, day, island, false AS leaving, i0 AS low, i AS high, 0 AS k FROM r WHERE i0 IS NOT NULL UNION ALL SELECT r.id, day, island, true, j, j1, 0 FROM r WHERE j1 IS NOT NULL
      UNION ALL SELECT id, day, island, leaving, CASE WHEN high - low > 1000000 AND inside = leaving THEN t_us ELSE low END, CASE WHEN high - low > 1000000 AND inside <> leaving THEN t_us ELSE high END, k + 1
        FROM ({_sql_inside("SELECT b.day, island, leaving, low, high, k, (low + high) // 2 AS t_us, p.* FROM b JOIN p USING (id) WHERE k < 24")})),
    v AS (SELECT r.id, r.day, r.island, coalesce(e.low, r.i) AS enter, coalesce(l.high, r.j) AS leave, best FROM r
      LEFT JOIN (SELECT * FROM b WHERE k = 24 AND NOT leaving) e USING (id, day, island) LEFT JOIN (SELECT * FROM b WHERE k = 24 AND leaving) l USING (id, day, island)),
    c AS (SELECT v.id, day, island, enter, leave, greatest(enter, best - step) AS low, least(leave, best + step) AS high, 0 AS k FROM v JOIN p USING (id)
      UNION ALL SELECT id, day, island, enter, leave, CASE WHEN high - low > 1000000 AND NOT dl <= dist THEN low + third ELSE low END, CASE WHEN high - low > 1000000 AND dl <= dist THEN high - third ELSE high END, k + 1
        FROM ({_sql_inside("SELECT * EXCLUDE (t_us, az, alt, km, dist, seen, inside), dist AS dl, high - third AS t_us FROM (" + _sql_inside("SELECT c.day, island, enter, leave, low, high, k, (high - low) // 3 AS third, low + (high - low) // 3 AS t_us, p.* FROM c JOIN p USING (id) WHERE k < 32") + ")")})),
    z AS ({_sql_inside("SELECT c.day, enter, leave, (low + high) // 2 AS t_us, p.* FROM c JOIN p USING (id) WHERE k = 32")})
    SELECT id, enter // 1000000 AS enter, leave // 1000000 AS leave, t_us // 1000000 AS closest, round(az, 5) AS azimuth, round(alt, 5) AS altitude, round(dist, 5) AS distance FROM z WHERE seen AND alt > 0.25""",
)
def in_frame_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the Sun in every supplier's frame, with edges to a second and the closest instant."""
    k = F.col("s_suppkey")
    focal = F.get(F.array(F.lit(24.0), F.lit(50.0), F.lit(135.0)), (k % 3).cast("int"))
    fov = optics.fields_of_view(focal, F.lit(1.5))
    searches = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.timestamp_micros(F.lit(DAY_START)).alias("start"), F.timestamp_micros(F.lit(DAY_START + DAYS * DAY)).alias("end"), lat_of("s_suppkey").alias("lat"), lon_of("s_suppkey").alias("lon"),
        (90 + k * 97 % 180).cast("double").alias("bearing"), (k * 7 % 50).cast("double").alias("subject_elevation"), fov["h"].alias("h_fov"), fov["v"].alias("v_fov"),
    )
    found = passes.frame_intervals(searches, ["sun"], "Asia/Tokyo", [], F.lit(FROM_MINUTE), F.lit(TO_MINUTE))
    second = lambda c: F.floor(F.unix_micros(c) / 1000000).alias(c)
    return found.select("id", second("enter"), second("leave"), second("closest"), r5("azimuth").alias("azimuth"), r5("altitude").alias("altitude"), r5("distance").alias("distance"))


@query(
    "moon_direction_crossing",
    f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, {sql_lat("c_custkey")} AS lat, {sql_lon("c_custkey")} AS lon, (c_custkey * 97 % 360)::DOUBLE AS bearing, (c_custkey % 60)::DOUBLE AS elevation,
      degrees(2 * atan(36.0::DOUBLE / 28)) AS h_fov, degrees(2 * atan(24.0::DOUBLE / 28)) AS v_fov FROM customer),
    grid AS (SELECT p.*, {DAY_START} + i * 600000000 AS t_us FROM p, range(0, 145) r(i)),
    w AS (SELECT *, lag(err) OVER (PARTITION BY id ORDER BY t_us) AS before FROM (SELECT *, {_signed("az", "bearing")} AS err FROM ({sql_moon("SELECT * FROM grid")}))),
    s AS (SELECT id, lat, lon, bearing, elevation, h_fov, v_fov, t_us - 600000000 AS a, t_us AS b, sign(before) AS fa, 0 AS k FROM w WHERE ((before < 0 AND err >= 0) OR (before > 0 AND err <= 0)) AND abs(err - before) < 180
      UNION ALL SELECT id, lat, lon, bearing, elevation, h_fov, v_fov, CASE WHEN go AND same THEN t_us ELSE a END, CASE WHEN go AND NOT same THEN t_us ELSE b END, fa, k + 1
      FROM (SELECT *, sign({_signed("az", "bearing")}) = fa AS same, b - a > 1000000 AS go FROM ({sql_moon("SELECT *, (a + b) // 2 AS t_us FROM s WHERE k < 20")}))),
    f AS ({sql_frame(sql_moon("SELECT *, b AS t_us FROM s WHERE k = 20"), sky.MOON_RADIUS_KM)})
    SELECT id, t_us // 1000000 AS instant, round(az, 5) AS azimuth, round(alt, 5) AS altitude, round(dist, 5) AS distance FROM f WHERE alt > 0.25 AND alt >= elevation AND seen""",
)
def moon_direction_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the Moon stands over each customer's bearing, in the frame and not below the subject."""
    k = F.col("c_custkey")
    fov = optics.fields_of_view(F.lit(14.0), F.lit(1.5))
    searches = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.timestamp_micros(F.lit(DAY_START)).alias("start"), F.timestamp_micros(F.lit(DAY_END)).alias("end"), lat_of("c_custkey").alias("lat"), lon_of("c_custkey").alias("lon"),
        (k * 97 % 360).cast("double").alias("bearing"), (k % 60).cast("double").alias("subject_elevation"), fov["h"].alias("h_fov"), fov["v"].alias("v_fov"),
    )
    found = passes.crossings(searches, ["moon"], "Asia/Tokyo", [], F.lit(0), F.lit(1439))
    return found.select("id", F.floor(F.unix_micros("instant") / 1000000).alias("instant"), r5("azimuth").alias("azimuth"), r5("altitude").alias("altitude"), r5("distance").alias("distance"))


def _sql_rise_set(body: str, at: str) -> str:
    return f"""{body}_e AS (SELECT *, lag(alt) OVER (PARTITION BY id ORDER BY t_us) AS before FROM ({at.format("SELECT * FROM g")})),
    {body}_b AS (SELECT id, lat, lon, alt >= 0 AS rises, t_us - 120000000 AS a, t_us AS b, 0 AS k FROM {body}_e WHERE (before < 0) <> (alt < 0)
      UNION ALL SELECT id, lat, lon, rises, CASE WHEN (alt >= 0) = rises THEN a ELSE t_us END, CASE WHEN (alt >= 0) = rises THEN t_us ELSE b END, k + 1 FROM ({at.format(f"SELECT *, (a + b) // 2 AS t_us FROM {body}_b WHERE k < 18")})),
    {body}_f AS (SELECT g.id, '{body}' AS body, min(b) FILTER (rises) // 1000000 AS rise, min(b) FILTER (NOT rises) // 1000000 AS set FROM (SELECT DISTINCT id FROM g) g LEFT JOIN (SELECT * FROM {body}_b WHERE k = 18) x USING (id) GROUP BY ALL)"""


@query(
    "body_rise_set",
    f"""WITH RECURSIVE g AS (SELECT s_suppkey AS id, {sql_lat("s_suppkey")} AS lat, {sql_lon("s_suppkey")} AS lon, {DAY_START} + i * 120000000 AS t_us FROM supplier, range(0, 721) r(i)),
    {_sql_rise_set("sun", sql_sun("{}"))}, {_sql_rise_set("moon", sql_moon("{}"))}, {_sql_rise_set("milkyWay", sql_star("{}", sky.GALACTIC_CENTRE))}
    SELECT * FROM sun_f UNION ALL SELECT * FROM moon_f UNION ALL SELECT * FROM milkyWay_f""",
)
def body_rise_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rise and set of Sun, Moon and galactic centre at every supplier on one day, refined."""
    days = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.timestamp_micros(F.lit(DAY_START)).alias("start"), F.timestamp_micros(F.lit(DAY_END)).alias("end"), lat_of("s_suppkey").alias("lat"), lon_of("s_suppkey").alias("lon")
    )
    found = passes.rises_and_sets(days, ["sun", "moon", "milkyWay"])
    return found.select("id", "body", F.floor(F.unix_micros("rise") / 1000000).alias("rise"), F.floor(F.unix_micros("set") / 1000000).alias("set"))


_EVENTS = f"SELECT event_id, epoch_us(ts) AS t_us, {sql_lat('event_id')} AS lat, {sql_lon('event_id')} AS lon FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("instant"), lat_of("event_id").alias("lat"), lon_of("event_id").alias("lon"))


@query(
    "moon_samples",
    f"""SELECT event_id, round(az, 6) AS azimuth, round(alt, 6) AS altitude, round(phase / 360 * {sky.SYNODIC_DAYS}::DOUBLE, 6) AS age, round(fraction, 6) AS fraction FROM ({sql_moon(_EVENTS)})
    WHERE alt > 0.25 AND alt < 50 AND phase / 360 * {sky.SYNODIC_DAYS}::DOUBLE BETWEEN 10 AND 20""",
)
def moon_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a Moon of 10 to 20 days between 0.25 and 50 degrees."""
    found = spot.moon_samples(_events(spark, sf_dir), 10.0, 20.0)
    return found.select("event_id", *[r6(c).alias(c) for c in ("azimuth", "altitude", "age", "fraction")])


@query(
    "milky_way_samples",
    f"""WITH c AS (SELECT event_id, lat, lon, t_us, az AS azimuth, alt AS altitude FROM ({sql_star(_EVENTS, sky.GALACTIC_CENTRE)}) WHERE alt BETWEEN 8 AND 55),
    d AS (SELECT * EXCLUDE (az, alt) FROM ({sql_sun("SELECT * FROM c")}) WHERE alt <= -12),
    m AS ({sql_moon("SELECT * FROM d")})
    SELECT event_id, round(azimuth, 6) AS azimuth, round(altitude, 6) AS altitude FROM m WHERE NOT (alt > 0 AND fraction > 0.35)""",
)
def milky_way_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the galactic centre up in a dark sky."""
    return spot.milky_way_samples(_events(spark, sf_dir)).select("event_id", r6("azimuth").alias("azimuth"), r6("altitude").alias("altitude"))


@query(
    "sun_near_night",
    f"""WITH a AS (SELECT * EXCLUDE (az, alt), az AS azimuth, alt AS altitude FROM ({sql_sun(_EVENTS)}) WHERE alt > 0.25 AND alt < 12),
    b AS (SELECT * EXCLUDE (az, alt) REPLACE (now_us AS t_us), alt > altitude AS rising FROM ({sql_sun("SELECT *, t_us AS now_us FROM a").replace("SELECT *, t_us AS now_us FROM a", "SELECT * REPLACE (t_us + 600000000 AS t_us), t_us AS now_us FROM a")})),
    c AS ({sql_sun("SELECT * REPLACE (now_us + CASE WHEN rising THEN -21600000000 ELSE 21600000000 END AS t_us) FROM b")})
    SELECT event_id, round(azimuth, 6) AS azimuth, round(altitude, 6) AS altitude FROM c WHERE alt <= 0.25 AND rising""",
)
def sun_near_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at sunrise: a low, rising Sun that was down six hours before."""
    return spot.sun_samples(_events(spark, sf_dir), "sunrise").select("event_id", r6("azimuth").alias("azimuth"), r6("altitude").alias("altitude"))


_TRACK_FOV = "degrees(2 * atan(24.0::DOUBLE / 200))"
_TRACK = f"SELECT s_suppkey AS id, {sql_lat('s_suppkey')} AS lat, {sql_lon('s_suppkey')} AS lon, {DAY_START} + i * greatest(1, least(10, floor({_TRACK_FOV})))::BIGINT * 60000000 AS t_us FROM supplier, range(0, 1441) r(i) WHERE i * greatest(1, least(10, floor({_TRACK_FOV}))) <= 1440"


@query(
    "daily_tracks",
    f"""WITH t AS ({_TRACK}), e AS (SELECT 'sun' AS body, id, t_us, alt FROM ({sql_sun("SELECT * FROM t")}) UNION ALL SELECT 'moon', id, t_us, alt FROM ({sql_moon("SELECT * FROM t")})
      UNION ALL SELECT 'milkyWay', id, t_us, alt FROM ({sql_star("SELECT * FROM t", sky.GALACTIC_CENTRE)}) UNION ALL SELECT 'polaris', id, t_us, alt FROM ({sql_star("SELECT * FROM t", sky.POLARIS)})),
    s AS (SELECT *, CASE WHEN alt >= -1 AND NOT coalesce(lag(alt >= -1) OVER u, false) THEN 1 ELSE 0 END AS st FROM e WINDOW u AS (PARTITION BY id, body ORDER BY t_us)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY id, body ORDER BY t_us) AS island FROM s)
    SELECT id, body, island, min(t_us) // 1000000 AS first, max(t_us) // 1000000 AS last, count(*) AS n FROM i WHERE alt >= -1 GROUP BY id, body, island HAVING count(*) > 1""",
)
def daily_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible stretches of the bodies' tracks through a day at every supplier."""
    fov = optics.fields_of_view(F.lit(100.0), F.lit(1.5))
    days = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.timestamp_micros(F.lit(DAY_START)).alias("start"), lat_of("s_suppkey").alias("lat"), lon_of("s_suppkey").alias("lon"))
    found = screen.visible_segments(screen.daily_tracks(days, screen.track_step(fov["h"], fov["v"])), ["id", "body"])
    second = lambda c: F.floor(F.unix_micros(c) / 1000000).alias(c)
    return found.select("id", "body", "island", second("first"), second("last"), "n")


def sql_refracted(alt: str) -> str:
    """An altitude lifted by standard air."""
    low = f"greatest({alt}, -1.0)"
    bend = f"(1.02::DOUBLE / tan(radians({low} + 10.3::DOUBLE / ({low} + 5.11))) / 60)"
    return f"({alt} + CASE WHEN {alt} < -1 THEN {bend} * greatest({alt} + 90, 0.0) / 89 ELSE {bend} END)"


def sql_project(source: str, bearing: float, elevation: float, h_fov: str, v_fov: str) -> str:
    """SQL that adds x and y in per cent of the frame (null behind the camera) to rows with az and alt."""
    sb, cb, se, ce = (f"{f}(radians({v}::DOUBLE))" for v in (bearing, elevation) for f in ("sin", "cos"))
    return f"""SELECT * EXCLUDE (vx, vy, vz, fw), 50.0::DOUBLE + 50.0::DOUBLE * (vx*{cb} - vy*{sb}) / fw / tan(radians({h_fov} / 2)) AS x, 50.0::DOUBLE - 50.0::DOUBLE * (-vx*{sb}*{se} - vy*{cb}*{se} + vz*{ce}) / fw / tan(radians({v_fov} / 2)) AS y
    FROM (SELECT *, CASE WHEN vx*{ce}*{sb} + vy*{ce}*{cb} + vz*{se} > 1e-8 THEN vx*{ce}*{sb} + vy*{ce}*{cb} + vz*{se} END AS fw
    FROM (SELECT *, cos(radians(alt))*sin(radians(az)) AS vx, cos(radians(alt))*cos(radians(az)) AS vy, sin(radians(alt)) AS vz FROM ({source}) j0) j1) j2"""


def _sql_fov(focal: float) -> tuple[str, str]:
    return f"degrees(2 * atan(36.0::DOUBLE / {2 * focal}))", f"degrees(2 * atan(24.0::DOUBLE / {2 * focal}))"


_SCREEN = _sql_fov(24.0)
_DISC = "degrees(2 * asin(radius / greatest(radius, km)))"

ORACLE_SQL["body_screen"] = f"""WITH e AS ({_EVENTS}),
    b AS (SELECT event_id, 'sun' AS body, az, alt, km, {sky.SUN_RADIUS_KM}::DOUBLE AS radius FROM ({sql_sun_km("SELECT * FROM e")}) UNION ALL SELECT event_id, 'moon', az, alt, km, {sky.MOON_RADIUS_KM}::DOUBLE FROM ({sql_moon("SELECT * FROM e")})
      UNION ALL SELECT event_id, 'milkyWay', az, alt, NULL, NULL FROM ({sql_star("SELECT * FROM e", sky.GALACTIC_CENTRE)}) UNION ALL SELECT event_id, 'polaris', az, alt, NULL, NULL FROM ({sql_star("SELECT * FROM e", sky.POLARIS)})),
    p AS ({sql_project(f"SELECT event_id, body, az, {sql_refracted('alt')} AS alt, CASE WHEN radius IS NOT NULL THEN {_DISC} END AS disc FROM b", 180.0, 20.0, *_SCREEN)}),
    w AS (SELECT *, 100.0::DOUBLE * tan(radians(disc / 2)) / tan(radians({_SCREEN[0]} / 2)) AS width, 100.0::DOUBLE * tan(radians(disc / 2)) / tan(radians({_SCREEN[1]} / 2)) AS height FROM p)
    SELECT event_id, body, round(az, 6) AS azimuth, round(alt, 6) AS altitude, round(x, 3) AS x, round(y, 3) AS y, round(width, 6) AS width,
      coalesce(CASE WHEN disc IS NULL THEN x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 100 AND alt > -1
        ELSE x IS NOT NULL AND alt + disc / 2 > -1 AND x + width / 2 >= 0 AND x - width / 2 <= 100 AND y + height / 2 >= 0 AND y - height / 2 <= 100 END, false) AS in_frame FROM w"""

_BAND = _sql_fov(14.0)

ORACLE_SQL["milky_way_band"] = f"""WITH k AS (SELECT s_suppkey AS key, {sql_lat("s_suppkey")} AS lat, {sql_lon("s_suppkey")} AS lon, (i * 5)::DOUBLE AS longitude, (1784815200000000 / 1e6 - 946728000.0) / 86400.0 AS n FROM supplier, range(0, 73) r(i)),
    h AS (SELECT *, 7.0::DOUBLE + 8.0::DOUBLE * exp(-pow(least(longitude, 360.0 - longitude) / 38, 2.0)) AS half FROM k),
    g AS (SELECT *, 'centre' AS part, 0.0::DOUBLE AS latitude FROM h UNION ALL SELECT *, 'upper', half FROM h UNION ALL SELECT *, 'lower', -half FROM h),
    v AS (SELECT *, cos(radians(latitude))*cos(radians(longitude)) AS gx, cos(radians(latitude))*sin(radians(longitude)) AS gy, sin(radians(latitude)) AS gz FROM g),
    q AS (SELECT *, {sql_wrap("degrees(atan2(-0.8734370902*gx - 0.4448296300*gy - 0.1980763734*gz, -0.0548755604*gx + 0.4941094279*gy - 0.8676661490*gz))")} AS ra,
      degrees(asin(greatest(-1.0, least(1.0, -0.4838350155*gx + 0.7469822445*gy + 0.4559837762*gz)))) AS de FROM v),
    t AS (SELECT *, {sql_wrap("280.46061837 + 360.98564736629*n + lon")} - ra AS h FROM q),
    a AS (SELECT key, longitude, part, {sql_wrap("degrees(atan2(-cos(radians(de))*sin(radians(h)), sin(radians(de))*cos(radians(lat)) - cos(radians(de))*cos(radians(h))*sin(radians(lat))))")} AS az,
      degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat))*sin(radians(de)) + cos(radians(lat))*cos(radians(de))*cos(radians(h)))))) AS alt FROM t),
    p AS ({sql_project("SELECT * FROM a", 180.0, 30.0, *_BAND)})
    SELECT key, longitude, round(max(alt) FILTER (part = 'centre'), 6) AS altitude, {", ".join(f"round(max({c}) FILTER (part = '{n}'), 3) AS {n}_{c}" for n in ("centre", "upper", "lower") for c in "xy")},
      coalesce(bool_or(x BETWEEN -15 AND 115 AND y BETWEEN -15 AND 115) AND max(alt) FILTER (part = 'centre') > -8, false) AS visible FROM p GROUP BY key, longitude"""

_MONTH = f"{sky.SYNODIC_DAYS}::DOUBLE"

ORACLE_SQL["moon_age"] = f"""WITH r AS (SELECT epoch_us(CAST(min(ts) AS DATE) - INTERVAL 40 DAY) AS a, epoch_us(date_trunc('day', max(ts))) AS b FROM events),
    d AS (SELECT a + i * {DAY} AS t_us, 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon FROM r, range(0, 100000) g(i) WHERE a + i * {DAY} <= b),
    p AS (SELECT t_us, phase FROM ({sql_moon("SELECT * FROM d")})), q AS (SELECT t_us, phase AS later FROM ({sql_moon(f"SELECT * REPLACE (t_us + {DAY} AS t_us) FROM d")})),
    m AS (SELECT trunc(p.t_us + (360 - phase) / (later + 360 - phase) * {DAY})::BIGINT AS new_us FROM p JOIN q ON q.t_us = p.t_us + {DAY} WHERE phase > later + 180),
    e AS (SELECT event_id, (epoch_us(ts) - max(new_us)) / {DAY}::DOUBLE AS age FROM events JOIN m ON new_us <= epoch_us(ts) GROUP BY event_id, ts)
    SELECT event_id, round(age, 3) AS age_days, ({list(sky.PHASES)!r})[(floor(({sql_wrap(f"age / {_MONTH} * 360")} + 22.5) / 45)::BIGINT % 8) + 1] AS phase FROM e"""

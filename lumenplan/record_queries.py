"""Queries of saved records, map pixels, checked values and mesh hits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import earth, optics, policy, text
from .functions.earth import SEMI_MAJOR
from .operators import joins, sampling
from .plans import occlusion
from .queries import lat_of, lon_of, query, r6, sql_lat, sql_lon, table
from .sources import store, weather


@query(
    "map_pixels",
    f"""WITH p AS (SELECT c_custkey AS id, {sql_lat("c_custkey")} AS a, {sql_lon("c_custkey")} AS o, 256 * pow(2.0, c_custkey % 12) AS s FROM customer),
    x AS (SELECT id, s, (o + 180) / 360 * s AS x, (0.5 - asinh(tan(radians(a))) / (2 * pi())) * s AS y FROM p)
    SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(degrees(atan(sinh(pi() * (1 - 2 * y / s)))), 6) AS lat, round(x / s * 360 - 180, 6) AS lon FROM x""",
)
def map_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World pixels of every customer's place, and the places that they stand for."""
    zoom = F.col("id") % 12
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lat_of("c_custkey").alias("a"), lon_of("c_custkey").alias("o"))
    pixels = rows.withColumn("p", earth.mercator_pixel("a", "o", zoom)).withColumn("b", earth.mercator_place(F.col("p.x"), F.col("p.y"), zoom))
    return pixels.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), r6("b.lat").alias("lat"), r6("b.lon").alias("lon"))


@query(
    "people_in_frame",
    """SELECT p_partkey AS id, round(100 * 1.7 / (2 * d * tan(radians(v) / 2)), 6) AS height, round(40 * 1.7 / (2 * d * tan(radians(h) / 2)), 6) AS width
    FROM (SELECT p_partkey, p_size * 4.0::DOUBLE AS d, 20.0::DOUBLE + p_partkey % 50 AS h, 15.0::DOUBLE + p_partkey % 30 AS v FROM part)""",
)
def people_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the frame that a standing person takes."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), optics.person_box(F.lit(1.7), F.col("p_size") * F.lit(4.0), k % 50 + F.lit(20.0), k % 30 + F.lit(15.0)).alias("box"))
    return rows.select("id", r6("box.height").alias("height"), r6("box.width").alias("width"))


@query(
    "kept_projects",
    """WITH n AS (SELECT o_custkey AS id, max(o_orderdate)::DATE AS u FROM orders GROUP BY 1),
    h AS (SELECT c_custkey AS id, DATE '1995-01-01' + (c_custkey % 1000)::INTEGER AS u FROM customer),
    m AS (SELECT * FROM n UNION ALL SELECT * FROM h WHERE id NOT IN (SELECT id FROM n)),
    k AS (SELECT * FROM m ORDER BY u DESC, id LIMIT 500)
    SELECT id, u - DATE '1990-01-01' AS day FROM k WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def kept_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of customers after newer ones were saved over them and those of overdrawn customers deleted."""
    c = table(spark, sf_dir, "customer")
    held = c.select(F.col("c_custkey").alias("id"), F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("c_custkey") % 1000).cast("int")).alias("updated_at"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("updated_at"))
    kept = store.delete_projects(store.save_projects(held, new), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    return kept.select("id", F.datediff("updated_at", F.to_date(F.lit("1990-01-01"))).cast("long").alias("day"))


@query(
    "overriding_records",
    """WITH o AS (SELECT o_custkey AS id, 'order' AS source, max(o_totalprice)::DOUBLE AS amount FROM orders GROUP BY 1)
    SELECT id, source, round(amount, 6) AS amount FROM (SELECT * FROM o UNION ALL SELECT c_custkey, 'account', c_acctbal::DOUBLE FROM customer WHERE c_custkey NOT IN (SELECT id FROM o))""",
)
def overriding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per customer, from the orders where there are any (union with override)."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit("order").alias("source"), F.max("o_totalprice").cast("double").alias("amount"))
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("account").alias("source"), F.col("c_acctbal").cast("double").alias("amount"))
    return joins.union_override(own, other, ["id"]).select("id", "source", r6("amount").alias("amount"))


@query(
    "full_years",
    """WITH n AS (SELECT year(max(o_orderdate)) AS y FROM orders)
    SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders, n WHERE year(o_orderdate) BETWEEN y - 5 AND y - 1 GROUP BY 1""",
)
def full_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the five full years before the newest one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"))
    newest = F.broadcast(o.agg(F.max("time").alias("now")))  # one row
    return weather.last_full_years(o.crossJoin(newest), F.col("now")).groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"))


@query(
    "lens_heights",
    f"""WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 700 + 30.0::DOUBLE END AS e, (s_suppkey % 40)::DOUBLE AS n, (s_suppkey % 900)::DOUBLE AS h, {sql_lat("s_suppkey")} AS lat FROM supplier)
    SELECT id, round(lat, 6) AS lat, round(coalesce(e, h) + 1.5, 6) AS ellipsoidal, round(h - n + 1.5, 6) AS orthometric, round(h + 1.5, 6) AS height FROM p""",
)
def lens_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of a lens above points whose latitude is checked; a bad one would stop the query."""
    k = F.col("s_suppkey")
    e, n, h = F.when(k % 3 == 0, k % 700 + F.lit(30.0)), (k % 40).cast("double"), (k % 900).cast("double")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), policy.asserted(lat_of("s_suppkey"), "latitude").alias("lat"), h.alias("h"), earth.heights(e, F.lit(None).cast("double"), n, h).alias("p"))
    lifted = rows.select("id", "lat", earth.raised(F.col("p").withField("height", F.col("h")), F.lit(1.5)).alias("r"))
    return lifted.select("id", r6("lat").alias("lat"), *[r6(f"r.{c}").alias(c) for c in ("ellipsoidal", "orthometric", "height")])


@query(
    "mesh_verdicts",
    """WITH s AS (SELECT l_orderkey, l_linestatus = 'F' AS verified, CASE WHEN l_returnflag <> 'A' THEN l_quantity::DOUBLE END AS hit, CASE WHEN l_discount > 0.02 THEN l_discount * 600 END AS until, 1 + l_tax * 100.0 AS lens FROM lineitem),
    o AS (SELECT *, coalesce(hit > greatest(3.0, lens * 0.75) AND (until IS NULL OR hit < until), false) AS hidden FROM s)
    SELECT l_orderkey, round(avg(hidden::INTEGER) * 100, 6) AS obstructed_pct, min(CASE WHEN hidden THEN hit END) AS nearest, bool_and(verified) AS verified FROM o GROUP BY 1""",
)
def mesh_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each body's samples that mesh hits hide, beyond the tripod's surroundings and before the end (T8's hits as input, A10)."""
    samples = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linestatus") == "F").alias("verified"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("double")).alias("hit"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 600).cast("double").alias("end_distance"), (1 + F.col("l_tax") * 100.0).cast("double").alias("lens"),
    )
    found = occlusion.disc_obstruction(occlusion.mesh_hits(samples, F.col("lens")), ["l_orderkey"])
    return found.select("l_orderkey", r6("obstructed_pct").alias("obstructed_pct"), "nearest", "verified")


@query(
    "plain_titles",
    r"""WITH t AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '\s+', '', 'g') AS title, regexp_replace(lower(p_type), '\s+', '', 'g') AS asked FROM part)
    SELECT id, title, CASE WHEN title = asked THEN 0 WHEN starts_with(title, asked) THEN 1 WHEN contains(title, asked) THEN 2 WHEN contains(asked, title) THEN 3 ELSE 4 END::INTEGER AS score FROM t""",
)
def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without white space and case, and how they fit a query."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.ascii_normal("p_name").alias("title"), text.ascii_normal("p_type").alias("asked"))
    return rows.select("id", "title", text.title_score(F.col("asked"), F.col("title")).cast("int").alias("score"))


@query(
    "places_under_bodies",
    f"""SELECT c_custkey AS id, round(c_custkey % 340 - 170 + CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * 500.0::DOUBLE / {SEMI_MAJOR}::DOUBLE * 180 / pi(), 6) AS lon FROM customer""",
)
def places_under_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places 500 m along the equator from where a subject stands under a body in the east or west."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(0.0).alias("lat"), (k % 340 - 170).cast("double").alias("lon"), F.when(k % 2 == 0, 90.0).otherwise(270.0).alias("azimuth"))
    return sampling.directional_candidates(rows, "lat", "lon", "azimuth").select("id", r6("candidate_lon").alias("lon"))

"""Joins: nearest in time, within a radius, raster samples, features on a ray, upserts."""

from __future__ import annotations

from math import floor, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import col
from ..functions.rasters import SIZE, SOURCES, source_allowed
from .cells import in_cells, polygon_cells
from .lineage import cut, tasks
from .ranking import first_per_key, top_per_key


def nearest_in_time(left: DataFrame, right: DataFrame, time: str, right_time: str, tolerance_seconds: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Each left row with the right row nearest in time, at most ``tolerance_seconds`` off; of two as near the earlier.

    Times are cut into slots as long as the tolerance.  A slot holds its own rows, the last right row of the
    slot before and the first of the slot after, as no other one can be nearest; in order of time each left
    row sees the right row before and the one after it, so no pairs are made.  Right columns are null where
    there is no match.
    """
    width = tolerance_seconds * 1_000_000
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(width))
    named = [c for c in right.columns if c not in keys]
    one = right.select(*keys, slot(F.col(right_time)).alias("_slot"), F.unix_micros(right_time).alias("_at"), F.struct(*named).alias("_match"))
    one = one.where("_at is not null").groupBy(*keys, "_slot", "_at").agg(F.min("_match").alias("_match"))
    ends = one.groupBy(*keys, "_slot").agg(F.min(F.struct("_at", "_match")).alias("_first"), F.max(F.struct("_at", "_match")).alias("_last"))
    lent = F.explode(F.array(F.struct((F.col("_slot") - 1).alias("s"), F.col("_first").alias("m")), F.struct((F.col("_slot") + 1).alias("s"), F.col("_last").alias("m"))))
    lent = ends.select(*keys, lent.alias("_e")).select(*keys, F.col("_e.s").alias("_slot"), "_e.m._at", "_e.m._match")
    shelves = one.unionByName(lent).select(*keys, "_slot", "_at", F.struct("_at", "_match").alias("_m"), F.lit(None).cast("timestamp").alias(time))
    # the match depends on the keys and the time alone, so no row needs a number of its own
    asks = left.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("timestamp").alias(time)).distinct()
    asks = asks.select(*keys, slot(F.col(time)).alias("_slot"), F.unix_micros(time).alias("_at"), F.lit(None).cast(shelves.schema["_m"].dataType).alias("_m"), time)
    w = Window.partitionBy(*keys, "_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = shelves.unionByName(asks)
    # a right row of the same time comes first both ways
    rows = rows.withColumn("_before", F.last("_m", True).over(w.orderBy(F.col("_at"), F.col("_m").isNull())))
    rows = rows.withColumn("_after", F.last("_m", True).over(w.orderBy(F.desc("_at"), F.col("_m").isNull()))).where(F.col(time).isNotNull())
    back, on = F.col("_at") - F.col("_before._at"), F.col("_after._at") - F.col("_at")
    nearest = F.when((back <= width) & (on.isNull() | (back <= on)), F.col("_before._match")).when(on <= width, F.col("_after._match"))
    best = rows.withColumn("_best", nearest).where("_best is not null").select(*keys, time, "_best.*")
    return left.join(best, [*keys, time], "left").select(*left.columns, *named)


def within_radius(points: DataFrame, places: DataFrame, radius: float, x: str = "x", y: str = "y", px: str = "px", py: str = "py", also: Column | None = None) -> DataFrame:
    """Pairs of points and places at most ``radius`` apart on a plane, with ``distance``; only those that fulfil ``also``.

    An equi join on square cells of half that size: a place, of which there are fewer, stands in each cell
    that its circle touches (21 to 25), a point in its own.  Pairs are many beside the rows, so the cells are dealt
    over a number of tasks of their own.
    """
    size = radius / 2
    cell = lambda c: F.floor(F.col(c) / F.lit(size))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    cx, cy = F.col("_cx"), F.col("_cy")
    off = lambda c, k: F.greatest(k * F.lit(size) - F.col(c), F.col(c) - (k + 1) * F.lit(size), F.lit(0.0))
    touched = off(px, cx) * off(px, cx) + off(py, cy) * off(py, cy) <= radius * radius * (1 + 1e-9)
    shelves = places.withColumn("_o", F.explode(around)).withColumn("_cx", cell(px) + F.col("_o.i")).withColumn("_cy", cell(py) + F.col("_o.j")).where(touched).drop("_o")
    asks = points.withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
    n = tasks(points)
    dx, dy = F.col(px) - F.col(x), F.col(py) - F.col(y)
    near = dx * dx + dy * dy <= radius * radius * (1 + 1e-9)  # spares most pairs the root
    met = asks.repartition(n, "_cx", "_cy").join(shelves.repartition(n, "_cx", "_cy"), ["_cx", "_cy"]).where(near if also is None else near & also)
    return met.drop("_cx", "_cy").withColumn("distance", F.hypot(dx, dy)).where(F.col("distance") <= radius)


def _first_reach(places: DataFrame, radius: float, wanted: int, px: str, py: str) -> float:
    """A whole number of metres within which a point meets about ``wanted`` places, ``radius`` at most."""
    box = places.agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{c}") for c in (px, py) for k, f in (("low", F.min), ("high", F.max))]).first()
    if not box["n"] or box[f"low{px}"] is None or box[f"low{py}"] is None:
        return radius
    area = max(box[f"high{px}"] - box[f"low{px}"], 1.0) * max(box[f"high{py}"] - box[f"low{py}"], 1.0)
    reach = radius
    while reach > 16 and box["n"] * pi * reach * reach / area > wanted:
        reach = float(floor(reach / 2))
    return reach


def nearest_places(points: DataFrame, places: DataFrame, key: str, place_key: str, radius: float, k: int, x: str = "x", y: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """The ``k`` places nearest to each point by whole ``metres``, then ``place_key``, at most ``radius`` away, numbered from 1 in ``place``.

    ``key`` tells points apart.  A first search reaches so far that a point meets a few times ``k``; points
    with fewer are searched again twice as far, up to ``radius``.  So the pairs grow with the points,
    however dense the places are.
    """
    reach, left, found = _first_reach(places, radius, 6 * k, px, py), points, []
    while True:
        last = reach >= radius
        # all places of up to ``reach`` whole metres are less than half a metre beyond it
        rows = within_radius(left, places, radius if last else min(radius, reach + 1), x, y, px, py).withColumn("metres", F.floor(F.col("distance") + 0.5))
        top = top_per_key(rows if last else rows.where(F.col("metres") <= reach), [key], [F.col("metres"), F.col(place_key)], k)
        if last and not found:
            return top
        top = cut(top)
        if last:
            found.append(top)
            break
        full = top.where(F.col("place") == k).select(key)
        found.append(top.join(full, key, "left_semi"))
        left = cut(left.join(full, key, "left_anti"))
        reach = min(radius, reach * 2)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def any_within(points: DataFrame, places: DataFrame, key: str, radius: float, x: str = "x", y: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """The different ``key`` of points with any place at most ``radius`` away.

    As ``nearest_places``: the first search reaches a few places, and only points without one are searched
    again twice as far.
    """
    reach, left, found = _first_reach(places, radius, 6, px, py), points, []
    while True:
        hit = within_radius(left, places, reach, x, y, px, py).select(key).distinct()
        if reach >= radius:
            found.append(hit)
            break
        found.append(cut(hit))
        left = cut(left.join(found[-1], key, "left_anti"))
        reach = min(radius, reach * 2)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def near_flags(points: DataFrame, places: DataFrame, key: str, flags: dict[str, tuple[float, Column]]) -> DataFrame:
    """Every point with flags that say whether a place of a kind (a predicate on ``places``) is within the flag's own radius; false for none."""
    out = points
    for name, (radius, kind) in flags.items():
        hit = any_within(points, places.where(kind), key, radius).withColumn(name, F.lit(True))
        out = out.join(hit, key, "left")
    return out.select(*points.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in flags])


#: Rings that one number can hold.
RINGS = 63


def rings(pairs: DataFrame, keys: list[str], ring: Column, kinds: dict[str, Column]) -> DataFrame:
    """Per ``keys`` a number for each kind of pairs, whose bit k is set if any pair lies in ring k (0 to 62).

    The different rings of a key are a few numbers whatever its pairs, so these are combined before the shuffle.
    """
    rows = pairs.withColumn("_ring", ring.cast("int"))
    bit = F.when(F.col("_ring").between(0, RINGS - 1), F.expr("shiftleft(1L, _ring)")).otherwise(F.raise_error(F.lit("a ring beyond 62")).cast("long"))
    return rows.withColumn("_bit", bit).groupBy(*keys).agg(*[F.coalesce(F.bit_or(F.when(c, F.col("_bit"))), F.lit(0).cast("long")).alias(n) for n, c in kinds.items()])


def ring_rows(df: DataFrame, mask: str, out: str) -> DataFrame:
    """A row for each ring that a number of ``rings`` holds."""
    rows = df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(RINGS - 1))))
    return rows.where(F.expr(f"shiftright(`{mask}`, `{out}`) & 1L = 1L")).withColumn(out, F.col(out).cast("long"))


def site_flags(points: DataFrame, pairs: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Every point with flags that say whether any of its joined features fulfils a predicate; false for none."""
    any_of = pairs.groupBy(key).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    return points.join(any_of, key, "left").select(*points.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in flags])


def sample_grid(points: DataFrame, pixels: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """Columns ``q_i_j`` (metres) with the pixels around each point's pixel (gx, gy), for offsets 0..1 or -1..2.

    One equi join of exploded offsets with the pixel table, folded back by a map-side combined
    aggregate; a missing pixel is null.
    """
    offsets = (0, 1) if reach == 1 else (-1, 0, 1, 2)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in offsets for j in offsets])
    asks = points.select(key, "gx", "gy", F.explode(around).alias("o")).select(key, (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"), "o")
    found = asks.join(pixels.select("gx", "gy", "cm"), ["gx", "gy"], "left")
    corner = lambda i, j: F.max(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col("cm"))) / F.lit(100.0)
    wide = found.groupBy(key).agg(*[corner(i, j).alias(f"q_{i}_{j}".replace("-", "m")) for j in offsets for i in offsets])
    return points.join(wide, key)


def sample_tiles(points: DataFrame, tiles: DataFrame, key: str, reach: int = 2) -> DataFrame:
    """As ``sample_grid`` for rows (tile_x, tile_y, px, py) and tiles (x, y, cm array of 256 x 256).

    A point needs four tiles at most, so it is joined with those instead of with its pixels.
    """
    offsets = (0, 1) if reach == 1 else (-1, 0, 1, 2)
    place = lambda i, j: F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"),
        (F.col("tile_x") + F.floor((F.col("px") + i) / SIZE)).cast("int").alias("x"), (F.col("tile_y") + F.floor((F.col("py") + j) / SIZE)).cast("int").alias("y"),
        (F.pmod(F.col("py") + j, F.lit(SIZE)) * SIZE + F.pmod(F.col("px") + i, F.lit(SIZE))).cast("int").alias("at"),
    )
    wanted = points.select(key, F.array(*[place(i, j) for j in offsets for i in offsets]).alias("w"))
    tile = F.explode(F.array_distinct(F.transform("w", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    asks = wanted.select(key, "w", tile.alias("t")).select(key, "t.x", "t.y", F.filter("w", lambda p: (p["x"] == F.col("t.x")) & (p["y"] == F.col("t.y"))).alias("w"))
    found = asks.join(tiles.select("x", "y", "cm"), ["x", "y"]).select(
        key, F.explode(F.transform("w", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), F.get("cm", p["at"]).alias("cm")))).alias("o")
    )
    corner = lambda i, j: F.max(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col("o.cm"))) / F.lit(100.0)
    wide = found.groupBy(key).agg(*[corner(i, j).alias(f"q_{i}_{j}".replace("-", "m")) for j in offsets for i in offsets])
    return points.join(wide, key, "left")


def by_priority(points: DataFrame, samples: DataFrame, key: str, detail: str) -> DataFrame:
    """The height of the best source that answers and may answer: ``samples`` has (key, label, height)."""
    order = F.create_map(*[F.lit(v) for k, (_, label, _) in enumerate(SOURCES) for v in (label, k)])
    ranked = samples.join(points.select(key, detail), key).where(source_allowed(F.col("label"), F.col(detail)) & F.col("height").isNotNull())
    best = ranked.groupBy(key).agg(F.min(F.struct(F.try_element_at(order, F.col("label")).alias("rank"), "label", "height")).alias("b"))
    return points.join(best.select(key, "b.label", "b.height"), key, "left")


def finest_request(requests: DataFrame, lat: str, lon: str, detail: str) -> DataFrame:
    """Every request with the finest detail that any request of the same place asks for ("1m" before "5m" before "10m")."""
    rank = F.when(F.col(detail) == "1m", 0).when(F.col(detail) == "5m", 1).when(F.col(detail) == "10m", 2).otherwise(0)
    best = requests.groupBy(lat, lon).agg(F.min(rank).alias("_r"))
    name = F.get(F.array(F.lit("1m"), F.lit("5m"), F.lit("10m")), F.col("_r"))
    return requests.join(best, [lat, lon]).withColumn("finest", name).drop("_r")


def upsert(held: DataFrame, new: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those of the same key; the ``cap`` latest stay."""
    merged = held.join(new.select(key), key, "left_anti").unionByName(first_per_key(new, [key], [F.desc(order)]))
    return merged.orderBy(F.desc(order), key).limit(cap)


def union_override(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables; where keys are equal the row of ``first``."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    return first_per_key(both, keys, [F.col("_p")]).drop("_p")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def higher_of(terrain: DataFrame, surface: DataFrame, key: str) -> DataFrame:
    """Per line of sight the higher horizon and its source; terrain where they are equal."""
    t, s = F.col("terrain_elevation"), F.col("surface_elevation")
    rows = terrain.join(surface, key, "left")
    over = F.coalesce(s > t, F.lit(False))
    return rows.withColumn("horizon", F.when(over, s).otherwise(t)).withColumn("source", F.when(over, "surface").otherwise("terrain"))


def in_polygon(points: DataFrame, polygons: DataFrame, lat: str, lon: str) -> DataFrame:
    """Points with the polygons (ring of lat/lon, closed) that contain them.

    Polygons are spread over quadtree cells that follow their borders: a large one costs few cells inside
    and as many along the border as its edges need.
    """
    return in_cells(points, polygon_cells(polygons), lat, lon)


def ocean_zone(lon) -> Column:
    """Nautical zone of a longitude, for points in no polygon."""
    hours = F.floor((col(lon) + F.lit(7.5)) / 15).cast("int")
    return F.when(hours == 0, "Etc/GMT").when(hours > 0, F.concat(F.lit("Etc/GMT-"), hours.cast("string"))).otherwise(F.concat(F.lit("Etc/GMT+"), (-hours).cast("string")))

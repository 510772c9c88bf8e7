"""Shapes by cells: polygons as quadtrees whose cells follow the border, lines by the cells they pass.

Cells of level k are squares of 360 / 4^k degrees.  A polygon's cell without border is inside or left out;
one with border holds the few edges that touch it and says whether its reference point is inside, so a point
is tested against those edges alone.  A point meets a cell of each level, by equality.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Levels of cells; sixteen cells of a level make one of the level before.
LEVELS, SIDES = 10, 4
#: Edges of a border cell above which it is split, where a level is left.
EDGES = 32
#: Place of a cell's reference point in its sides; no round share, so that no vertex lies on its lines.
REFERENCE = (0.6180339887, 0.3819660113)
#: Rows of cells up to which they are broadcast.
BROADCAST_CELLS = 200_000

_CELL = "_level int, _cx long, _cy long, _border boolean, _inside boolean, _rx double, _ry double, _edges array<struct<ax:double,ay:double,bx:double,by:double>>"


def cell_size(level: int) -> float:
    return 360.0 / SIDES**level


def _odd(edges: np.ndarray, x: float, y: float, rx: float, ry: float) -> bool:
    """True if the way from (x, y) along the parallel and then the meridian to (rx, ry) crosses the edges an odd number of times."""
    ax, ay, bx, by = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (bx - ax) * (y - ay) / (by - ay) + ax
        first = ((ay > y) != (by > y)) & ((cut > x) != (cut > rx))
        cut = (by - ay) * (rx - ax) / (bx - ax) + ay
        second = ((ax > rx) != (bx > rx)) & ((cut > y) != (cut > ry))
    return bool((np.count_nonzero(first) + np.count_nonzero(second)) % 2)


def _touching(edges: np.ndarray, x: float, y: float, size: float) -> np.ndarray:
    """The edges that touch a cell, and perhaps a few that pass its corners closely."""
    ax, ay, bx, by = edges.T
    slack = size * 1e-9
    box = (np.minimum(ax, bx) <= x + size + slack) & (np.maximum(ax, bx) >= x - slack) & (np.minimum(ay, by) <= y + size + slack) & (np.maximum(ay, by) >= y - slack)
    # distance of the middle from the line, against the half width of the cell across it
    dx, dy, h = bx - ax, by - ay, size / 2
    across = np.abs(dx * (y + h - ay) - dy * (x + h - ax)) <= (np.abs(dx) + np.abs(dy)) * h * (1 + 1e-9) + 1e-15
    return edges[box & across]


def ring_cells(lat: np.ndarray, lon: np.ndarray) -> list[tuple]:
    """(level, x, y, border, inside, reference x, reference y, edges) of the cells of a closed ring."""
    if len(lat) < 4:
        return []
    edges = np.column_stack([lon[:-1], lat[:-1], lon[1:], lat[1:]])
    extent = max(np.ptp(lat), np.ptp(lon), 1e-12)
    level = int(min(LEVELS, max(1, floor(log(360.0 / extent, SIDES)))))
    size = cell_size(level)
    far = (float(lon.max()) + 1.0, float(lat.max()) + 1.0)  # certainly outside
    span = lambda v: range(floor(float(v.min()) / size), floor(float(v.max()) / size) + 1)
    left = [(level, i, j, edges, far, False) for i in span(lon) for j in span(lat)]
    out = []
    while left:
        level, i, j, near, known, state = left.pop()
        size = cell_size(level)
        x, y = i * size, j * size
        reference = (x + REFERENCE[0] * size, y + REFERENCE[1] * size)
        inside = state != _odd(near, *reference, *known)
        own = _touching(near, x, y, size)
        if not len(own):
            if inside:
                out.append((level, i, j, False, True, *reference, None))
        elif len(own) <= EDGES or level == LEVELS:
            out.append((level, i, j, True, inside, *reference, own))
        else:
            left += [(level + 1, i * SIDES + a, j * SIDES + b, own, reference, inside) for a in range(SIDES) for b in range(SIDES)]
    return out


def polygon_cells(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """The columns of ``polygons`` but the ring (array of lat, lon; the first point again at the end) with their cells."""
    kept = [f for f in polygons.schema.fields if f.name != ring]
    rows = polygons.select(*[f.name for f in kept], F.transform(ring, lambda p: p["lat"].cast("double")).alias("_lat"), F.transform(ring, lambda p: p["lon"].cast("double")).alias("_lon"))

    def run(batches):
        for pdf in batches:
            cells = [ring_cells(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(pdf["_lat"], pdf["_lon"])]
            at = np.repeat(np.arange(len(pdf)), [len(c) for c in cells])
            flat = [c for own in cells for c in own]
            found = pd.DataFrame(flat, columns=["_level", "_cx", "_cy", "_border", "_inside", "_rx", "_ry", "_edges"])
            edges = [None if c[-1] is None else [dict(zip(("ax", "ay", "bx", "by"), row)) for row in c[-1].tolist()] for c in flat]
            found["_edges"] = pd.Series(edges, dtype=object)
            yield pd.concat([pdf.iloc[at][[f.name for f in kept]].reset_index(drop=True), found], axis=1)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.where(F.col("_lat").isNotNull()).mapInPandas(run, fields + _CELL)


def in_cells(points: DataFrame, cells: DataFrame, lat: str, lon: str) -> DataFrame:
    """Points with every polygon that contains them, by cells made by ``polygon_cells``.

    The cells are written to the checkpoint folder and counted: few are broadcast, more are met by a
    shuffle on the cell.
    """
    cells = cut(cells)
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    own = F.array(*[F.struct(F.lit(k).alias("l"), F.floor(x / F.lit(cell_size(k))).alias("x"), F.floor(y / F.lit(cell_size(k))).alias("y")) for k in range(1, LEVELS + 1)])
    asks = points.where(x.isNotNull() & y.isNotNull()).withColumn("_c", F.explode(own)).select(*points.columns, F.col("_c.l").alias("_level"), F.col("_c.x").alias("_cx"), F.col("_c.y").alias("_cy"))
    rx, ry = F.col("_rx"), F.col("_ry")

    def crossed(e: Column) -> Column:
        cut = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        first = ((e["ay"] > y) != (e["by"] > y)) & ((cut > x) != (cut > rx))
        up = F.try_divide((e["by"] - e["ay"]) * (rx - e["ax"]), e["bx"] - e["ax"]) + e["ay"]
        second = ((e["ax"] > rx) != (e["bx"] > rx)) & ((up > y) != (up > ry))
        return F.coalesce(first, F.lit(False)).cast("int") + F.coalesce(second, F.lit(False)).cast("int")

    turns = F.aggregate("_edges", F.lit(0), lambda n, e: n + crossed(e))
    inside = F.when(F.col("_border"), F.col("_inside") != (turns % 2 == 1)).otherwise(F.col("_inside"))
    small = cells.count() <= BROADCAST_CELLS
    met = asks.join(F.broadcast(cells) if small else cells, ["_level", "_cx", "_cy"])
    return met.where(inside).drop("_level", "_cx", "_cy", "_border", "_inside", "_rx", "_ry", "_edges")


def line_cells(segments: DataFrame, cell: float, a: tuple[str, str] = ("alat", "alon"), b: tuple[str, str] = ("blat", "blon")) -> DataFrame:
    """Segments by the square cells (``_cy``, ``_cx``, of ``cell`` degrees) that they pass: column by column the rows between both ends."""
    (ay, ax), (by, bx) = ((F.col(p) / cell for p in end) for end in (a, b))
    rows = segments.withColumn("_cx", F.explode(F.sequence(F.floor(F.least(ax, bx)), F.floor(F.greatest(ax, bx)))))
    at = lambda x: F.least(F.greatest(ay, by), F.greatest(F.least(ay, by), F.coalesce(ay + F.try_divide((x - ax) * (by - ay), bx - ax), ay)))
    low, high = F.greatest(F.least(ax, bx), F.col("_cx").cast("double")), F.least(F.greatest(ax, bx), F.col("_cx") + F.lit(1.0))
    upright = F.abs(bx - ax) < F.lit(1e-9)
    first, last = F.when(upright, ay).otherwise(at(low)), F.when(upright, by).otherwise(at(high))
    return rows.withColumn("_cy", F.explode(F.sequence(F.floor(F.least(first, last)), F.floor(F.greatest(first, last)))))


def cells_around(points: DataFrame, cell: float, degrees: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points by the cells within ``degrees`` of latitude, and as many metres of longitude."""
    wide = F.lit(degrees) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col(lat)) + degrees, F.lit(89.9)))), F.lit(1e-3))
    span = lambda c, d: F.explode(F.sequence(F.floor((F.col(c) - d) / cell), F.floor((F.col(c) + d) / cell)))
    return points.withColumn("_cy", span(lat, F.lit(degrees))).withColumn("_cx", span(lon, wide))


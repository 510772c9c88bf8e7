"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors are compared where their labels are equal.  Every vector is projected on the same random
directions.  A pair collides on a direction if one projection lies in a window centred on the other;
pairs with enough collisions are verified by their cosine in double precision.  The number asked for
is such that a pair at the threshold passes with the wanted recall.

Equal vectors are one class with a weight.  The classes of a label are sorted along the first
direction and cut into blocks of a fixed size; a pair of blocks is skipped where their ranges on the
directions leave too few that could collide.  A task holds two blocks at a time, counts the
collisions of their pairs tile by tile, and returns a link count and one tree edge per class, never
the pairs.  The pairs of blocks of a label are rows of their own, so a hot label fills many tasks.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .graph import name_components
from .hot import join_keys
from .ranks import add_rank

THRESHOLD = 0.93
DIRECTIONS = 24
#: Half a window, in distances of a pair at the threshold, and the recall of such a pair.
WINDOW, RECALL = 2.0, 0.999
#: Classes of one block, and of one tile of a block.
BLOCK, TILE = 2048, 512
#: Cosines from two formulas differ by less; within it the slower one decides, for every pair alike.
ROUNDING = 1e-9
#: Ranges of the first projection, and rows' hash classes in each, by which classes are ranked.
RANGES, PARTS = 256, 16
SEED = 11
#: Pairs of label and length whose numbers of blocks are broadcast; with more they are shuffled, and each has few blocks.
BROADCAST_LABELS = 100_000


def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(DIRECTIONS, dims))


def window(threshold: float) -> float:
    """Half the window on a projection of unit vectors."""
    return WINDOW * sqrt(2 - 2 * threshold)


def collisions_needed() -> int:
    """Collisions that a pair at the threshold reaches with probability RECALL."""
    p = erf(WINDOW / sqrt(2))
    tail = 0.0
    for k in range(DIRECTIONS, 0, -1):
        tail += comb(DIRECTIONS, k) * p**k * (1 - p) ** (DIRECTIONS - k)
        if tail >= RECALL:
            return k
    return 1


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, vector, class, first, weight) of the usable vectors; equal ones are one class, ``first`` its least vec_id."""
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", "label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    rows = rows.withColumn("same", F.struct("label", "vector"))
    held = rows.groupBy("same").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("n", F.col("weight"))
    held = held.withColumn("class", F.monotonically_increasing_id())  # join_keys saves it, so a class keeps its number
    return join_keys(rows, held, "same", rows.count()).drop("same").withColumn("dims", F.size("vector"))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_range(classes: DataFrame) -> DataFrame:
    """Add ``part``: the range of the first projection among RANGES equally likely ones."""

    def run(batches):
        from math import erf as normal

        for b in batches:
            x = [np.array(v, float) for v in b.column("vector").to_pylist()]
            d = {len(v): directions(len(v))[0] for v in x}
            p = [0.5 * (1 + normal(float(unit_vectors(v[None])[0] @ d[len(v)]) / sqrt(2))) for v in x]
            part = pa.array([min(RANGES - 1, int(q * RANGES)) for q in p], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, part], [*b.schema.names, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{fields}, part int")


def _blocks(classes: DataFrame) -> DataFrame:
    """One row per block: label, dims, block, and its ids, weights, unit vectors and projections as binaries."""
    placed = _first_range(classes)
    bucket = F.col("part") * PARTS + F.pmod(F.xxhash64("class"), F.lit(PARTS))
    ranked = add_rank(placed, ["label", "dims"], bucket, RANGES * PARTS, ["class"])
    packed = (
        ranked.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int"))
        .groupBy("label", "dims", "block")
        .agg(F.collect_list(F.struct("class", "weight", "vector")).alias("rows"))  # BLOCK rows at most
    )

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                rows = one.column("rows")[0].values
                dims = one.column("dims")[0].as_py()
                x = unit_vectors(rows.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float))
                p = (x @ directions(dims).T).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        one.column("label"), one.column("dims"), one.column("block"),
                        pa.array([rows.field("class").to_numpy(zero_copy_only=False).astype("<i8").tobytes()]),
                        pa.array([rows.field("weight").to_numpy(zero_copy_only=False).astype("<i8").tobytes()]),
                        pa.array([x.tobytes()]), pa.array([p.T.tobytes()]),
                        pa.array([p.min(0).tolist()], pa.list_(pa.float32())), pa.array([p.max(0).tolist()], pa.list_(pa.float32())),
                    ],
                    ["label", "dims", "block", "ids", "weights", "units", "projections", "low", "high"],
                )

    label = dict(classes.dtypes)["label"]
    return packed.mapInArrow(
        run, f"label {label}, dims int, block int, ids binary, weights binary, units binary, projections binary, low array<float>, high array<float>"
    )


def _linked(a: dict, b: dict, same: bool, threshold: float) -> np.ndarray:
    """Which pairs of two blocks are linked."""
    half, need = np.float32(window(threshold) + 1e-6), collisions_needed()
    p, q = a["projections"], b["projections"]
    links = np.zeros((p.shape[1], q.shape[1]), bool)
    for k in range(0, len(links), TILE):
        rows, columns = slice(k, k + TILE), slice(0, k + TILE if same else None)
        counts = np.zeros(links[rows, columns].shape, np.uint8)
        for x, y in zip(p[:, rows], q[:, columns], strict=True):
            counts += np.abs(x[:, None] - y[None, :]) <= half
        passed = counts >= need
        if same:
            passed &= np.arange(k, k + len(passed))[:, None] > np.arange(passed.shape[1])[None, :]
        if passed.any():
            links[rows, columns] = passed & _cosines_reach(a["units"][rows], b["units"][columns], passed, threshold)
    return links


def _cosines_reach(x: np.ndarray, y: np.ndarray, of: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have the cosine; near the threshold one formula, summed pair by pair, decides for all."""
    cosines = x @ y.T
    reach = cosines >= threshold
    i, j = np.nonzero(of & (np.abs(cosines - threshold) < ROUNDING))
    for k in range(0, len(i), 1 << 16):
        at = slice(k, k + (1 << 16))
        reach[i[at], j[at]] = (x[i[at]] * y[j[at]]).sum(1) >= threshold
    return reach


def _trees(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row and column of a table of links the number of the component's first node; rows come first."""
    n, m = links.shape
    rows, columns = np.arange(n), np.full(m, n + m)
    while True:
        c = np.minimum(columns, np.where(links, rows[:, None], n + m).min(0, initial=n + m))
        r = np.minimum(rows, np.where(links, c[None, :], n + m).min(1, initial=n + m))
        if (c == columns).all() and (r == rows).all():
            return rows, np.where(columns == n + m, n + np.arange(m), columns)
        rows, columns = r, c


def _compare(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per pair of blocks and class with a link: class, n_links, and the first class of its component there."""
    names = ("ids", "weights", "units", "projections")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                dims = batch.column("dims")[k].as_py()
                same = batch.column("x_block")[k].as_py() == batch.column("y_block")[k].as_py()
                sides = []
                for s in ("x", "y"):
                    ids, weights, units, projections = (batch.column(f"{s}_{n}")[k].as_buffer() for n in names)
                    sides.append(
                        {
                            "ids": np.frombuffer(ids, "<i8"), "weights": np.frombuffer(weights, "<i8"),
                            "units": np.frombuffer(units, float).reshape(-1, dims),
                            "projections": np.frombuffer(projections, np.float32).reshape(DIRECTIONS, -1),
                        }
                    )
                a, b = sides
                links = _linked(a, b, same, threshold)
                if not links.any():
                    continue
                if same:
                    links = links | links.T
                of_a = links @ b["weights"]
                of_b = a["weights"] @ links if not same else np.zeros(len(b["ids"]), np.int64)
                r, c = _trees(links | np.eye(len(links), dtype=bool) if same else links)
                ids = np.concatenate([a["ids"], b["ids"]])
                root = np.concatenate([r, c])
                count = np.concatenate([of_a, of_b])
                at = np.flatnonzero(count > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(count[at].astype(np.int64)), pa.array(ids[root[at]])], ["class", "n", "root"]
                )

    return pairs.mapInArrow(run, "class long, n long, root long")


def deduplicate(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id, label and vector.  A vector that is null, zero, or holds null or non-finite
    components, and one with a null label, links with nothing; vectors of different lengths don't link.
    Rows that repeat a vec_id are vectors of their own; each of them gets the most links and the
    smallest component of all with the number.  A null vec_id links with nothing and keeps nulls.  An
    empty table gives none; other columns are ignored.
    """
    classes = scratch.save(_classes(vectors.select("vec_id", "label", F.col("vector").cast("array<double>").alias("vector"))), "vectors")
    different = scratch.save(classes.groupBy("label", "dims", "class", "first", "weight").agg(F.first("vector").alias("vector")), "different")
    blocks = scratch.save(_blocks(different), "vector-blocks")
    side = lambda s, heavy: blocks.select(
        "label", "dims", *[F.col(c).alias(f"{s}_{c}") for c in ("block", *(("ids", "weights", "units", "projections") if heavy else ("low", "high")))]
    )
    apart = F.size(
        F.filter(
            F.arrays_zip("x_low", "x_high", "y_low", "y_high"),
            lambda z: (z["y_low"] > z["x_high"] + window(threshold) + 1e-5) | (z["x_low"] > z["y_high"] + window(threshold) + 1e-5),
        )
    )
    # every block meets the numbers of its label's blocks, a few per label, and then their ranges by number
    numbers = blocks.groupBy("label", "dims").agg(F.max("block").alias("last"))
    wanted = side("x", False).join(F.broadcast(numbers), ["label", "dims"]) if numbers.count() <= BROADCAST_LABELS else side("x", False).join(numbers, ["label", "dims"])
    wanted = wanted.withColumn("y_block", F.explode(F.sequence("x_block", "last"))).drop("last")
    near = (
        wanted.join(side("y", False), ["label", "dims", "y_block"])
        .where(DIRECTIONS - apart >= collisions_needed())
        .select("label", "dims", "x_block", "y_block")
    )
    pairs = near.join(side("x", True), ["label", "dims", "x_block"]).join(side("y", True), ["label", "dims", "y_block"])
    found = scratch.save(_compare(pairs, threshold), "vector-links")
    edges = found.where("class != root").select(F.col("class").alias("left"), F.col("root").alias("right")).distinct()
    named = name_components(different.select("class", "first", "weight"), edges, "class", "first", "component")
    counts = found.groupBy("class").agg(F.sum("n").alias("found"))
    per_class = named.join(counts, "class", "left").select(
        "class", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("links"), "component", F.col("weight").alias("n")
    )
    known = (
        join_keys(classes.select("vec_id", "class"), per_class, "class", classes.count())
        .groupBy("vec_id").agg(F.max("links").alias("n_links"), F.min("component").alias("component_id"))
    )
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )

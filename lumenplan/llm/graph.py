"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .hot import BROADCAST_KEYS, add_least

#: Rounds after which the contraction is taken to be broken.  Each round at least halves the
#: depth of every tree, so 64 is beyond any graph that fits a cluster.
MAX_ROUNDS = 64


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row ``(node, component)`` per node that has an edge; the component is its smallest node.

    Edges may repeat and may be given in either direction; loops and edges with a null end say
    nothing and are left out.  Every round is a map-side combined minimum per node and one join,
    written to the shared folder; the least neighbours of the hubs are broadcast, so the edges of a hub
    are never in one task.  An empty edge table gives an empty result.  Raises RuntimeError if the
    rounds run out, rather than return unfinished components.
    """
    l, r = F.col(left), F.col(right)
    e = (
        edges.select(F.greatest(l, r).alias("a"), F.least(l, r).alias("b"))
        .where("a != b")
        .where(l.isNotNull() & r.isNotNull())
        .distinct()
    )
    table = scratch.save(e, "edges")
    before = _signature(table)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        total = 2 * before[0]
        both = table.union(table.select("b", "a")).toDF("u", "v")
        low = add_least(both, "u", "v", "m", total)
        large = low.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        if total > BROADCAST_KEYS:
            large = scratch.save(large, "large")  # read twice
        joined = add_least(large, "a", "b", "m", total)
        small = joined.select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        ).distinct()
        after_table = scratch.save(small, "edges")
        after = _signature(after_table)
        scratch.drop(table)
        table = after_table
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components are not finished after {MAX_ROUNDS} rounds")
    # finished: every node but the roots has one edge, to its root
    leaves = table.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def name_components(classes: DataFrame, edges: DataFrame, key: str, least: str, out: str) -> DataFrame:
    """Add to every class the least ``least`` of its component; ``edges (left, right)`` link values of ``key``.

    ``key`` is a long that no two classes share.  A class without edges is a component of its own.
    """
    parts = connected_components(edges, "left", "right").withColumnRenamed("node", key)
    members = scratch.save(parts.join(classes.select(key, F.col(least).alias("_least")), key), "members")
    named = add_least(members, "component", "_least", "_name", members.count()).select(key, "_name")
    return classes.join(named, key, "left").withColumn(out, F.coalesce("_name", least)).drop("_name")

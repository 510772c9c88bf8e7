"""Ranks over a whole table or within a few groups, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_rank(df: DataFrame, groups: list[str], bucket: Column, buckets: int, order: list[str], out: str = "rank") -> DataFrame:
    """Add the gapless rank from 0 within ``groups``, in the order of ``bucket`` and, in a bucket, of ``order``.

    ``bucket`` is an integer from 0 to ``buckets`` - 1, so the table of bucket sizes that is broadcast
    has at most ``buckets`` rows a group; rows are sorted bucket by bucket.
    """
    rows = df.withColumn("_bucket", bucket.cast("int"))
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_inside", F.row_number().over(inside))
    return (
        ranked.join(F.broadcast(offsets), [*groups, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_inside") - 1)
        .drop("_bucket", "_before", "_inside")
    )

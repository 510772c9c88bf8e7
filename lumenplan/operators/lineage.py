"""Cutting the lineage between the rounds of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder that the session names in ``spark.checkpoint.dir``.

    Later rounds read them instead of planning all earlier rounds again.  Where a local session names no
    folder a temporary one of this machine is set; on a cluster, whose machines share none, that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenplan-"))
    return df.checkpoint(eager=True)


def tasks(df: DataFrame) -> int:
    """Tasks for work that is large beside its input's bytes: Spark deals by bytes and would give it a few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over ``tasks``, before each becomes many rows or much work."""
    return df.repartition(tasks(df))

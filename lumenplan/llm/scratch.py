"""Intermediate tables in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Where a local session
names none (tests, notebooks) a temporary folder of this machine is set once; on
a cluster, whose machines do not share one, that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting of the rows of an Arrow batch, and the number it has by itself.
BATCH_ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lumenplan-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    This cuts the lineage: a lost executor loses no part of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows for this session, unless it names a number: Spark and a worker hold several whole batches of texts."""
    if spark.conf.get(BATCH_ROWS, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_ROWS, "2000")


def drop(table: DataFrame) -> None:
    """Delete the files of a table made by ``save`` that nothing reads any more."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)

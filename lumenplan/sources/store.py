"""Saved tables: jobs, projects, subjects, cached answers, share codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import share_decode, share_encode
from ..operators.joins import upsert
from ..operators.ranking import first_per_key, newest_within

JOB_SCHEMA = "version int, client_id string, job_id string, status string, progress_percent int, input string, error string, created_at timestamp, updated_at timestamp"
JOB_DAYS, HISTORY, PROJECTS, RETAINED, PREPARED, PREPARED_DAYS = 7, 10, 500, 100, 120, 90
TERMINAL = ("awaiting-3d", "completed", "failed")


def read_jobs(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The latest record of every job that hasn't expired."""
    rows = spark.read.schema(JOB_SCHEMA).json(path).where(F.col("updated_at") >= now - F.expr(f"INTERVAL {JOB_DAYS} DAYS"))
    return latest_jobs(rows)


def latest_jobs(records: DataFrame) -> DataFrame:
    return first_per_key(records, ["client_id", "job_id"], [F.desc("updated_at"), F.desc("progress_percent")])


def write_jobs(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def save_projects(held: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(held, new, "id", "updated_at", PROJECTS)


def delete_projects(held: DataFrame, ids: DataFrame) -> DataFrame:
    return held.join(ids, "id", "left_anti")


def save_subjects(held: DataFrame, new: DataFrame) -> DataFrame:
    """Subject history; a place within a millionth of a degree is the same subject."""
    cell = lambda c: F.floor(F.col(c) * 1_000_000 + 0.5)
    keyed = lambda df: df.withColumn("_place", F.concat_ws(":", cell("lat"), cell("lon")))
    return upsert(keyed(held), keyed(new), "_place", "updated_at", HISTORY).drop("_place")


def prepared(records: DataFrame, now: Column) -> DataFrame:
    """Prepared searches of a client: the 120 newest of the last 90 days."""
    return newest_within(records, ["client_id"], "created_at", PREPARED_DAYS, now, PREPARED)


def request_key(payload: Column) -> Column:
    """A key for a request: the hash of its JSON; structs keep their fields in one order."""
    return F.sha2(F.to_json(payload), 256)


def fresh(cache: DataFrame, now: Column, version: int) -> DataFrame:
    """Cached answers of this version that haven't expired."""
    return cache.where((F.col("version") == version) & (F.col("expires_at") > now))


def with_share_code(df: DataFrame, payload: Column, out: str = "code") -> DataFrame:
    return df.withColumn(out, share_encode(payload))


def from_share_code(df: DataFrame, code: str = "code", out: str = "payload") -> DataFrame:
    return df.withColumn(out, share_decode(code))

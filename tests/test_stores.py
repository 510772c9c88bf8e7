"""Saved tables, share codes and roots of many rows."""

import numpy as np
from pyspark.sql import functions as F

from lumenplan.plans import transit
from lumenplan.sources import places, store


def test_jobs_are_written_and_the_latest_are_read(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = [("a", "queued", 0, "2024-05-01 10:00:00"), ("a", "running", 40, "2024-05-01 11:00:00"), ("a", "running", 60, "2024-05-01 11:00:00"), ("b", "failed", 10, "2024-04-01 10:00:00")]
    df = spark.createDataFrame(rows, "job_id string, status string, progress_percent int, at string")
    records = df.select(F.lit(1).alias("version"), F.lit("c").alias("client_id"), "job_id", "status", "progress_percent", F.col("at").cast("timestamp").alias("updated_at"))
    for job in ("a", "b"):
        store.write_jobs(records.where(F.col("job_id") == job), path)
    got = store.read_jobs(spark, path, F.lit("2024-05-02 00:00:00").cast("timestamp")).collect()
    assert [(r.job_id, r.status, r.progress_percent) for r in got] == [("a", "running", 60)]


def test_surveyed_structures(spark, tmp_path):
    names = [f.strip().split(" ") for f in places.STRUCTURE_SCHEMA.split(",")]
    assert len({n for n, _ in names}) == len(names)
    row = ["7" if kind != "string" else "tower" for _, kind in names]
    (tmp_path / "surveyed.csv").write_text(",".join(n for n, _ in names) + "\n" + ",".join(row) + "\n")
    (got,) = places.surveyed_structures(spark, str(tmp_path)).collect()
    assert [str(v) for v in got] == [str(float(v)) if kind == "double" else v for v, (_, kind) in zip(row, names, strict=True)]


def test_share_codes_of_a_table(spark):
    df = spark.createDataFrame([(1, "Fuji", 35.0), (1, "a/b?c+d 漢", -90.0), (2, "another version", 1.0), (1, "out of range", 91.0)], "v int, name string, lat double")
    place = F.struct(F.col("lat").alias("latitude"), F.lit(138.5).alias("longitude"), F.col("name").alias("label"))
    plan = F.struct("v", "name", F.lit("Asia/Tokyo").alias("zone"), F.lit("2026-03-20T12:00").alias("shooting"), place.alias("subject"), place.alias("tripod"), F.lit(35.0).alias("focal_mm"), F.lit(1.6).alias("lens_m"))
    coded = store.with_share_code(df, plan)
    assert not any(set(r.code) & set("+/=\n") for r in coded.collect())
    back = {r.name: r.payload for r in store.from_share_code(coded).collect()}
    assert {n: p and (p.name, p.subject.latitude) for n, p in back.items()} == {"Fuji": ("Fuji", 35.0), "a/b?c+d 漢": ("a/b?c+d 漢", -90.0), "another version": None, "out of range": None}


def test_roots_of_many_rows(spark):
    rows = [(k, 0, 40_000_000, 1_000_000.0 * k) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "id long, low long, high long, at double")
    got = transit.refine_roots(df, "low", "high", lambda pdf, t: t - pdf["at"].to_numpy()).select("id", F.unix_micros("instant").alias("t")).collect()
    assert np.abs([r.t - 1_000_000 * r.id for r in got]).max() <= 1_000_000 and len(got) == 29

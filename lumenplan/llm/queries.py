"""Registered queries ``opN_<name>`` of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontam, html_text, pii, quality, shards, simhash, token_counts, token_files, urls, vector_dedup, whitening

#: Vocabulary file of the queries; the operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    """Place of the byte-level vocabulary that the queries use."""
    return str(public_tokenizers.path(VOCABULARY))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary_path())


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return vector_dedup.deduplicate(vectors.select("vec_id", "label", vectors["embedding"].alias("vector")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(read(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(read(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(read(spark, sf_dir, "documents"), vocabulary_path(), limit=512)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_vectors": op6_vectors,
    "op7_token_files": op7_token_files,
    "op8_simhash": op8_simhash,
    "op9_decontam": op9_decontam,
    "op10_shards": op10_shards,
    "op11_centroids": op11_centroids,
    "op12_token_counts": op12_token_counts,
    "op13_whitening": op13_whitening,
}


def _centroids_sql(rounds: int = 3) -> str:
    """The rounds as a chain of common tables; components and sums are integers."""
    nearest = """
        {name} AS (
            SELECT row, vec_id, x, c, d FROM (
                SELECT v.row, v.vec_id, v.x, p.c, list_sum(list_transform(list_zip(v.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
                    row_number() OVER (PARTITION BY v.row ORDER BY list_sum(list_transform(list_zip(v.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), p.c) AS k
                FROM kept v, {points} p
            ) WHERE k = 1
        )"""
    mean = """
        {name} AS (
            SELECT p.c, coalesce(m.x, p.x) AS x FROM {points} p LEFT JOIN (
                SELECT c, list(y ORDER BY i) AS x FROM (
                    SELECT c, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM {near}, range(1, 65) r(i) GROUP BY c, i
                ) GROUP BY c
            ) m ON p.c = m.c
        )"""
    parts = [
        """
        kept AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        )""",
        """
        p0 AS (
            SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS c, x FROM kept) WHERE c < 16
        )""",
    ]
    for k in range(rounds):
        parts += [nearest.format(name=f"n{k}", points=f"p{k}"), mean.format(name=f"p{k + 1}", points=f"p{k}", near=f"n{k}")]
    parts.append(nearest.format(name="last", points=f"p{rounds}"))
    return f"""
        WITH {",".join(parts)}
        SELECT vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p.x, ',')) AS centroid_sha256
        FROM last l JOIN p{rounds} p ON l.c = p.c"""


ORACLE_SQL: dict[str, str] = {"op11_centroids": _centroids_sql()}

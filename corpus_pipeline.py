"""Corpus pipeline (part of the ``llm`` subpackage): documents to token digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenplan.llm import bpe, decontam, near_copies, pii, quality, queries, scratch


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this corpus, does not reject.

    Null and empty texts are scored as documents without words; repeated rows stay or go together;
    without labels all stay; an empty table gives none; columns may have any names.
    """
    scratch.small_batches(spark)
    return quality.keep_good(docs, queries.read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Of rows that repeat doc_id and text one stays; texts without words are one group; rows without
    doc_id stay; an empty table gives none; columns may have any names.  Texts that op8's SimHash
    links are compared, and further ones beside it; their exact similarity decides.
    """
    scratch.small_batches(spark)
    return near_copies.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item.

    Null and empty texts, and rows without doc_id, stay; repeated rows of a doc_id go together; an
    empty table gives none; columns may have any names.
    """
    scratch.small_batches(spark)
    return decontam.keep_clean(docs, queries.read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind, and ``n_chars`` counted anew.

    Null and empty texts and repeated rows stay as they are; an empty table gives none; columns may
    have any names.
    """
    return pii.redact(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is encoded as the empty one; repeated rows give repeated rows; an empty table gives
    none; other columns are ignored.
    """
    scratch.small_batches(spark)
    return bpe.round_trip(docs, queries.vocabulary_path())


STAGES = [
    ("quality", keep_good_quality),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("encode_bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next.

    Every stage says what it does with nulls, empty texts and repeated rows; an empty table gives none.
    """
    docs = queries.read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A network and alignments decide what is kept, which SQL cannot express.
ORACLE_SQL = None

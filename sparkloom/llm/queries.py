"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import STATEMENTS

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attribution import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collisions import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixmerge import byte_dedup

    return byte_dedup(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .segmentations import sampled

    return sampled(table(spark, sf_dir, "documents"), ["doc_id"], k=4)


def op9_gumbel_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .segmentations import sampled

    return sampled(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], k=4)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned

    return aligned(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(STATEMENTS)

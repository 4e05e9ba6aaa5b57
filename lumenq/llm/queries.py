"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenq.llm import media, packing, pii, quality, quality_rules, repeats, resharding, simhash, tokenizing, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all documents from their own evidence and their site's."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as payloads in tar shards and read back."""
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents laid out in 24 shards of nearly equal size, as they are stored."""
    stored, _, _ = resharding.reshard(_table(spark, sf_dir, "documents"))
    return resharding.read_back(stored)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 50-byte strings of earlier ones."""
    return repeats.repeated_spans(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return tokenizing.bpe_round_trip(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for all documents."""
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the URLs of all pages."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.find(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_media": op2_media,
    "op3_resharding": op3_resharding,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_repeats": op6_repeats,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": quality_rules.ORACLE,
}

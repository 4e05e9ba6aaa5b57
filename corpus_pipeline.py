"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Each calls
one of the operators in lumenq.llm and works on all that its predecessor kept.

Defined results: a null or white text fails the quality rules; rows without id are kept by both kinds of dedup and lose
nothing to other rows; of copies and near copies the row of the smallest id stays, of repeated rows one; extra columns
of whatever name pass through all stages but the last unchanged; an empty table gives no rows. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm import packing, pii, quality_rules, repeats, simhash
from lumenq.llm.common import drop_path, scratch_path


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the text, in its place and type."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and near copies (five-word shingles, 0.8)."""
    return simhash.drop_near_duplicates(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that an earlier one holds."""
    return _recounted(repeats.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _recounted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("pii", personal_data),
    ("packing", pack),
]

#: SQL can express neither the similarity groups nor the tagger nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the stage that read it is written
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents and JSONL files as frames, and back."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.errors import LumenqError

MAGIC = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd"}
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def compression_of(data: bytes) -> str | None:
    """gzip or zstd by the first bytes."""
    return next((name for magic, name in MAGIC.items() if data.startswith(magic)), None)


def pack(data: bytes, codec: str | None) -> bytes:
    if codec in (None, "none"):
        return data
    if codec == "gzip":
        import gzip

        return gzip.compress(data, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    raise ValueError(f"unknown compression {codec!r}")


def unpack(data: bytes) -> bytes:
    codec = compression_of(data)
    if codec == "gzip":
        import gzip

        return gzip.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def document_from_text(spark: SparkSession, text: str) -> DataFrame:
    """One row, `doc`: the text as VARIANT; of duplicate keys the last one counts."""
    spark.conf.set(DUPLICATE_KEYS, "true")
    return spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("doc"))


def read_document(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """One row, `doc`, from a JSON file anywhere that Spark reads, plain, gzip or zstd; an empty file is an empty object."""
    spark.conf.set(DUPLICATE_KEYS, "true")
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            texts = [(unpack(x).decode("utf-8").strip() or "{}") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])

    return raw.mapInArrow(run, "t string").select(F.parse_json("t").alias("doc"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row for each readable line: `item`; blank and malformed lines are left out."""
    spark.conf.set(DUPLICATE_KEYS, "true")
    return spark.read.text(path).select(F.try_parse_json("value").alias("item")).where("item IS NOT NULL")


def item_text(df: DataFrame) -> Column:
    """The JSON text of a row: its `item`, or all its columns."""
    return F.to_json(F.col("item")) if "item" in df.columns else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def append_jsonl(df: DataFrame, folder: str, compression: str = "none") -> None:
    """Rows as JSON lines, as further files of a folder."""
    df.select(item_text(df).alias("value")).write.mode("append").option("compression", compression).text(folder)


def write_json_lines(df: DataFrame, folder: str, compression: str = "none") -> int:
    """Rows as JSON lines of a fresh folder; how many there are."""
    lines = df.select(item_text(df).alias("value"))
    lines.write.mode("overwrite").option("compression", compression).text(folder)
    return df.sparkSession.read.text(folder).count()


def write_json_array(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """One local file with a JSON array, row by row; rows pass the driver one partition at a time."""
    rows = df.orderBy(*order) if order else df
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for row in rows.select(item_text(df).alias("value")).toLocalIterator():
            out.write(("," if n else "") + row["value"])
            n += 1
        out.write("]")
    return n


def dumps(value: Any, pretty: bool = False) -> str:
    return json.dumps(value, indent=4 if pretty else None, sort_keys=True, ensure_ascii=False, separators=None if pretty else (",", ":"))


def loads(data: bytes) -> Any:
    """A document's bytes as a value; text that is no UTF-8 or no JSON is an error."""
    try:
        text = unpack(data).decode("utf-8")
    except UnicodeDecodeError as e:
        raise LumenqError(f"the document is not UTF-8: {e}") from e
    try:
        return json.loads(text) if text.strip() else {}
    except ValueError as e:
        raise LumenqError(f"the document is not JSON: {e}") from e

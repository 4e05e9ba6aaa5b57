"""Operator 7: BPE encoding and decoding of whole text columns.

Defined results: a null text is encoded as an empty one (no ids); rows are independent, so repeated rows, ties and an
empty table need nothing further; input columns are never carried along, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.bpe import load
from lumenq.llm.common import chunks_of, returning, text_of, utf8_rows

CHUNK_BYTES = 2_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_chunks(batches: Iterator[pa.RecordBatch], column: int, path: str):
    """(batch, first row, row after the last, ids, ids in each row) for each chunk of whole texts."""
    bpe = load(path)
    for batch in batches:
        raw, offsets = utf8_rows(batch.column(column))
        for a, b in chunks_of(offsets, CHUNK_BYTES):
            ids, counts = bpe.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch, a, b, ids, counts


def bpe_encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: id_column and ids array<int> of its whole text (null: none)."""
    path = path or default_path()

    def run(batches):
        for batch, a, b, ids, counts in encoded_chunks(batches, 1, path):
            edges = np.concatenate(([0], np.cumsum(counts)))
            if edges[-1] >= 2**31:  # of one text: chunks are small
                raise ValueError("a text of over 2**31 ids doesn't fit into an array column")
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_column, "ids"])

    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_column), text_of(df, text_column).alias("_text")).mapInArrow(returning(run), schema)


def bpe_decode(df: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row: id_column and text, the ids' bytes read as UTF-8 (what isn't valid becomes U+FFFD; null: empty)."""
    path = path or default_path()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            lists = batch.column(1)
            lists = lists.fill_null([]) if lists.null_count else lists
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.diff(lists.offsets.to_numpy())
            raw, size = bpe.decode_bytes(ids, counts)
            ends = np.cumsum(size)
            texts = [raw[e - n : e].tobytes().decode("utf-8", "replace") for e, n in zip(ends.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("text", T.StringType())])
    return df.select(id_column, ids_column).mapInArrow(returning(run), schema)


def bpe_round_trip(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Encode, then decode the ids, in one pass: id_column, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()

    def run(batches):
        bpe = load(path)
        for batch, a, b, ids, counts in encoded_chunks(batches, 1, path):
            said, said_size = bpe.decimal(ids, counts)
            raw, size = bpe.decode_bytes(ids, counts)
            said, raw = memoryview(np.ascontiguousarray(said)), memoryview(np.ascontiguousarray(raw))
            ids_sha, decoded_sha, s, r = [], [], 0, 0
            for n, m in zip(said_size.tolist(), size.tolist()):
                ids_sha.append(hashlib.sha256(said[s : s + max(0, n - 1)]).hexdigest())  # without the last comma
                piece = raw[r : r + m]
                try:
                    str(piece, "utf-8")
                except UnicodeDecodeError:
                    piece = str(piece, "utf-8", "replace").encode()
                decoded_sha.append(hashlib.sha256(piece).hexdigest())
                s, r = s + n, r + m
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(F.col(id_column), text_of(df, text_column).alias("_text")).mapInArrow(returning(run), schema)

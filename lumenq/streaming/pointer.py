"""Bounded streams: the array at a JSON pointer, filtered, paged and projected; and unbounded reads of JSONL folders."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import PointerError
from lumenq.functions.fields import Resolver, _quoted, variant_kind
from lumenq.functions.paths import is_index, pointer_tokens
from lumenq.operators.match import Compiler


def condition_column(resolver: Resolver, condition: Any) -> Column:
    """A match document; none, or one of no conditions (also as an empty list), holds for every item."""
    if condition is None or condition in ({}, []):
        return F.lit(True)
    return Compiler(resolver).match(condition, plain=True)


def stream(df: DataFrame, resolver: Resolver, position: list[str], condition: Any = None, limit: int | None = None, skip: int = 0, select: list[str] | None = None) -> DataFrame:
    """Filter, skip, project, stop at the limit; select takes top-level fields and always gives objects."""
    out = df.filter(condition_column(resolver, condition))
    if position and (skip or limit is not None):
        out = out.orderBy(*[F.col(f"`{p}`") for p in position])
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    if select is None:
        return out
    if not resolver.variant:
        return out.select(*[c for c in select if c in df.columns])
    m = F.try_variant_get(F.col("item"), "$", "map<string,variant>")
    kept = F.to_variant_object(F.map_filter(m, lambda k, _: k.isin(list(select))))
    return out.withColumn("item", F.when(resolver("").kind() == "object", kept).otherwise(F.col("item")))


@dataclass(frozen=True)
class StreamFilter:
    """Conditions, page and projection of a stream, to be applied to any frame of items."""

    conditions: Any = None
    select: list[str] | None = None
    limit: int | None = None
    skip: int = 0

    def apply(self, df: DataFrame, resolver: Resolver, position: list[str]) -> DataFrame:
        return stream(df, resolver, position, self.conditions, self.limit, self.skip, self.select)


def at_pointer(doc: DataFrame, pointer: str) -> tuple[Column, str]:
    """The value that the pointer leads to in a one-row frame with a column `doc`, and its kind; an error if there is none."""
    tokens = pointer_tokens(pointer)
    values = [F.col("doc")]
    for t in tokens:
        v = values[-1]
        key = F.try_variant_get(v, "$" + _quoted(t), "variant")  # NULL on a list
        values.append(F.coalesce(key, F.try_variant_get(v, f"$[{int(t)}]", "variant")) if is_index(t) else key)
    kinds = doc.select(F.array(*[F.coalesce(variant_kind(v), F.lit("missing")) for v in values])).first()[0]
    for token, kind, before in zip(tokens, kinds[1:], kinds):
        if kind == "missing":
            raise PointerError(f"{pointer!r}: {'nothing' if before in ('object', 'array') else 'no way'} at {token!r}")
    return values[-1], kinds[-1]


def items_at(doc: DataFrame, pointer: str) -> DataFrame:
    """(_pos, item): the elements of an array, none of an object, a scalar itself."""
    value, kind = at_pointer(doc, pointer)
    if kind == "array":
        return doc.select(F.posexplode(F.try_variant_get(value, "$", "array<variant>")).alias("_pos", "item")).withColumn("_pos", F.col("_pos").cast("bigint"))
    rows = doc.select(F.lit(0).cast("bigint").alias("_pos"), value.alias("item"))
    return rows.where(F.lit(False)) if kind == "object" else rows


def read_jsonl_stream(spark: SparkSession, folder: str, condition: Any = None) -> DataFrame:
    """An unbounded frame (item VARIANT) over the JSONL files that arrive in a folder; bad lines are left out."""
    from lumenq.functions.fields import VariantResolver

    lines = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).text(folder)
    parsed = lines.select(F.try_parse_json("value").alias("item")).where("item IS NOT NULL")
    return parsed.filter(condition_column(VariantResolver("item"), condition))


def windowed_counts(stream_df: DataFrame, time_path: str, length: str, late: str, key_path: str | None = None) -> DataFrame:
    """Counts of an unbounded frame of items by event-time window (and key), with a watermark for late items."""
    from lumenq.functions.fields import VariantResolver

    r = VariantResolver("item")
    timed = stream_df.select(F.to_timestamp(r(time_path).string()).alias("t"), (r(key_path).key() if key_path else F.lit("")).alias("key"))
    return timed.withWatermark("t", late).groupBy(F.window("t", length), "key").agg(F.count(F.lit(1)).alias("n"))

"""Index metadata, and lookups by value key.

Spark plans scans by statistics and pushed filters, so an index changes no result; it names a field (or several) whose
value keys can be looked up and counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions.fields import Resolver, TypedField
from lumenq.functions.values import value_key

LISTED = "collection string, type string, field string, unique_values long, total_entries long, dimension int, metric string"


@dataclass(frozen=True)
class IndexInfo:
    collection: str
    type: str  # single, compound or vector
    fields: tuple[str, ...]
    dimension: int | None = None
    metric: str | None = None


def key_column(resolver: Resolver, fields: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[resolver(f).key() for f in fields])


def lookup(df: DataFrame, resolver: Resolver, path: str, value) -> DataFrame:
    """Items whose value key is that of `value`, so "30" finds 30 as well."""
    f, key = resolver(path), value_key(value)
    if isinstance(f, TypedField) and f.type is not None and f.type.typeName() in ("byte", "short", "integer", "long"):
        # the same rows, by a comparison that reaches the scan
        return df.where(f.column == int(key)) if key.lstrip("-").isdigit() and str(int(key)) == key else df.where(f.key() == key)
    return df.where(f.key() == key)


def statistics(df: DataFrame, resolver: Resolver, fields: tuple[str, ...]) -> DataFrame:
    """One row: unique_values, total_entries."""
    return df.agg(F.count_distinct(key_column(resolver, fields)).alias("unique_values"), F.count(F.lit(1)).alias("total_entries"))


def describe(spark: SparkSession, indexes: list[tuple[IndexInfo, DataFrame, Resolver]]) -> DataFrame:
    """A row for each index."""
    rows = []
    for info, df, resolver in indexes:
        head = (F.lit(info.collection).alias("collection"), F.lit(info.type).alias("type"), F.lit(",".join(info.fields)).alias("field"))
        if info.type == "vector":
            stats = df.agg(F.lit(None).cast("long").alias("unique_values"), F.count(resolver(info.fields[0]).elements()).alias("total_entries"))
        else:
            stats = statistics(df, resolver, info.fields)
        rows.append(stats.select(*head, "unique_values", "total_entries", F.lit(info.dimension).cast("int").alias("dimension"), F.lit(info.metric).cast("string").alias("metric")))
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], LISTED)

"""Aggregates over one field, and grouping."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.errors import QueryError
from lumenq.functions.fields import Resolver

OPERATIONS = ("sum", "avg", "min", "max", "count")


def _number(resolver: Resolver, path: str) -> Column:
    return resolver(path).number().cast("double")


def aggregate_column(resolver: Resolver, path: str, operation: str) -> Column:
    """Over numbers only; NULL if there is none. `count` counts all items, but only where one has a number."""
    n = _number(resolver, path)
    if operation == "count":
        return F.when(F.count(n) > 0, F.count(F.lit(1)))
    if operation not in OPERATIONS:
        return F.max(F.lit(None).cast("double"))
    return getattr(F, operation)(n)


def aggregate(df: DataFrame, resolver: Resolver, path: str, operation: str) -> DataFrame:
    """One row, one column named like the operation."""
    return df.agg(aggregate_column(resolver, path, operation).alias(operation))


def aggregate_many(df: DataFrame, resolver: Resolver, spec: dict[str, str]) -> DataFrame:
    """{"sum": field, "avg": field, ...} in one pass; "count" counts items."""
    columns = [(F.count(F.lit(1)) if op == "count" else aggregate_column(resolver, path, op)).alias(op) for op, path in spec.items()]
    return df.agg(*columns)


def stream_aggregate(df: DataFrame, resolver: Resolver, operation: str, path: str) -> DataFrame:
    """As a running fold gives it: the sum and mean of nothing are 0, its least and greatest NULL; count counts items."""
    if operation not in OPERATIONS:
        raise QueryError(f"unknown operation {operation!r}", suggestion=f"use one of {', '.join(OPERATIONS)}")
    n = _number(resolver, path)
    if operation == "count":
        return df.agg(F.count(F.lit(1)).alias("count"))
    own = getattr(F, operation)(n)
    return df.agg((F.coalesce(own, F.lit(0.0)) if operation in ("sum", "avg") else own).alias(operation))


def group_sizes(df: DataFrame, resolver: Resolver, path: str) -> DataFrame:
    """(key, n); no items are gathered."""
    return df.groupBy(resolver(path).key().alias("key")).agg(F.count(F.lit(1)).alias("n"))


def group_by(df: DataFrame, resolver: Resolver, path: str, position: list[str]) -> DataFrame:
    """(key, items): whole items of each key, in item order.

    A group's items form one array, as the operation asks; use group_aggregate or group_sizes where groups are large.
    """
    item = F.col("item") if resolver.variant else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by = [F.col(f"`{p}`").alias(f"p{k}") for k, p in enumerate(position)]
    if not by:
        return df.groupBy(resolver(path).key().alias("key")).agg(F.collect_list(item).alias("items"))
    rows = F.collect_list(F.struct(*by, item.alias("item")))

    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for k in reversed(range(len(by))):
            x, y = a[f"p{k}"], b[f"p{k}"]
            out = F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(out)
        return out

    return df.groupBy(resolver(path).key().alias("key")).agg(F.transform(F.array_sort(rows, order), lambda r: r["item"]).alias("items"))


def group_aggregate(df: DataFrame, resolver: Resolver, path: str, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, name, ...): {"name": (field, operation)} for each group, summed up before the shuffle."""
    return df.groupBy(resolver(path).key().alias("key")).agg(*[aggregate_column(resolver, f, op).alias(name) for name, (f, op) in spec.items()])


def grouped_object(groups: DataFrame) -> dict[str, Any]:
    """{key: [items]} on the driver, keys sorted."""
    rows = sorted(groups.collect(), key=lambda r: r["key"])
    return {r["key"]: list(r["items"]) for r in rows}

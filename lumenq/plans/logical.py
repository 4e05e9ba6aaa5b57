"""The one plan that all query front ends build, and its translation to DataFrame calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.functions.fields import Resolver, TypedField


@dataclass
class LogicalQuery:
    """Clauses in the order in which they apply: where, order, skip, limit, projection."""

    where: Column | None = None
    order: tuple[str, bool] | None = None  # field, descending
    skip: int = 0
    limit: int | None = None
    select: list[str] | None = None
    drop: list[str] | None = None
    notes: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, resolver: Resolver, position: list[str]) -> DataFrame:
        if self.where is not None:
            df = df.filter(self.where)
        by = [F.col(f"`{p}`") for p in position]
        if self.order is not None:
            df = df.orderBy(*sort_keys(resolver, *self.order), *by)
        elif by and (self.skip or self.limit is not None):
            df = df.orderBy(*by)
        if self.skip:
            df = df.offset(self.skip)
        if self.limit is not None:
            df = df.limit(self.limit)
        return project(df, resolver, self.select, self.drop, position)


def sort_keys(resolver: Resolver, path: str, descending: bool) -> list[Column]:
    """Numbers and texts in their order; rows whose field is neither come last, in item order."""
    f = resolver(path)
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    if isinstance(f, TypedField):
        return [turn(f.value())]
    return [turn(f.number()), turn(f.string())]


def project(df: DataFrame, resolver: Resolver, select: list[str] | None, drop: list[str] | None, position: list[str]) -> DataFrame:
    """Select dot paths under their own names, or drop top-level fields; select wins over drop."""
    if select is not None:
        return df.select(*[resolver(p).value().alias(p) for p in select])
    if drop is None:
        return df
    if not resolver.variant:
        return df.drop(*drop)
    fields = F.try_variant_get(F.col("item"), "$", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(drop)) if drop else fields
    item = F.when(resolver("").kind() == "object", F.to_variant_object(kept)).otherwise(F.col("item"))
    return df.withColumn("item", item)


def position_columns(position: list[str] | str | None) -> list[str]:
    return [position] if isinstance(position, str) else list(position or [])

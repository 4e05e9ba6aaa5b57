"""JSONPath over a frame of variants.

A frame has a VARIANT column `v` and an array `ord` that says where each node stands; each segment turns it into the
frame of the next nodes. Only recursive descent needs more than one projection: a recursive query over variant_explode.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.functions.fields import VariantResolver, _quoted
from lumenq.functions.paths import Descend, Filter, Index, Key, Keys, Segment, Slice, Wildcard, json_path
from lumenq.operators.match import Compiler

MAX_DEPTH = 512


# A segment's expression refers to its node once: segments are nested into each other, so that more references would
# multiply. Casts of a variant to a kind that it is not are NULL.


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _children(df: DataFrame) -> DataFrame:
    """Elements, or values by key (the order in which a variant keeps them)."""
    found = df.select(*[c for c in df.columns if c != "v"], F.posexplode(F.coalesce(_list(F.col("v")), F.map_values(_map(F.col("v"))))).alias("at", "v"))
    return _placed(found, F.col("at").cast("bigint"))


def _placed(df: DataFrame, at: Column) -> DataFrame:
    return df.withColumn("ord", F.concat("ord", F.array(at))).drop("at")


def _slice(s: Slice, items: Column) -> Column:
    """Positions as Python's slice gives them, then the elements there."""
    n = F.size(items)

    def bound(value: int | None, default: Column, low: Column, high: Column) -> Column:
        if value is None:
            return default
        at = F.lit(value) if value >= 0 else n + value
        return F.greatest(low, F.least(high, at))

    zero = F.lit(0)
    if s.step > 0:
        a, b = bound(s.start, zero, zero, n), bound(s.end, n, zero, n)
        some = a < b
        span = F.sequence(a, F.greatest(a, b - 1), F.lit(s.step))
    else:
        a, b = bound(s.start, n - 1, F.lit(-1), n - 1), bound(s.end, F.lit(-1), F.lit(-1), n - 1)
        some = a > b
        span = F.sequence(a, F.least(a, b + 1), F.lit(s.step))
    return F.when(some, F.transform(span, lambda i: F.get(items, i)))


def _descend(df: DataFrame, segment: Descend) -> DataFrame:
    """In pre-order: what a node holds under the key, then what its children hold."""
    spark = df.sparkSession
    view = f"lumenq_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    rest = [c for c in df.columns if c not in ("v", "ord")]
    kept = "".join(f"t.`{c}`, " for c in rest)
    nodes = spark.sql(
        f"WITH RECURSIVE n({''.join(f'`{c}`, ' for c in rest)}`ord`, v, depth) MAX RECURSION LEVEL {MAX_DEPTH} AS ("
        f"SELECT {kept}t.`ord`, t.v, 0 FROM {view} t UNION ALL "
        f"SELECT {kept}concat(t.`ord`, array(CAST(e.pos AS BIGINT))), e.value, t.depth + 1 FROM n t, LATERAL variant_explode(t.v) e) "
        f"SELECT {''.join(f'`{c}`, ' for c in rest)}`ord`, v FROM n LIMIT ALL"  # lifts the row limit of recursion (a million)
    )
    if segment.name == "*":
        # a node's own values come before those of its children: rank -1 puts them first
        own = nodes.withColumn("ord", F.concat("ord", F.array(F.lit(-1).cast("bigint"))))
        return _children(own)
    hit = F.try_variant_get(F.col("v"), "$" + _quoted(segment.name), "variant")
    found = nodes.withColumn("v", hit).where(F.col("v").isNotNull())
    return _placed(found.withColumn("at", F.lit(-1).cast("bigint")), F.col("at"))


def step(df: DataFrame, segment: Segment) -> DataFrame:
    v = F.col("v")
    if isinstance(segment, Key):
        return df.withColumn("v", F.try_variant_get(v, "$" + _quoted(segment.name), "variant"))
    if isinstance(segment, Index):
        at = segment.at
        return df.withColumn("v", F.try_variant_get(v, f"$[{at}]", "variant") if at >= 0 else F.try_element_at(_list(v), F.lit(at)))
    if isinstance(segment, Wildcard):
        return _children(df)
    if isinstance(segment, Slice):
        found = df.select(*[c for c in df.columns if c != "v"], F.posexplode(F.transform(F.array(_list(v)), lambda items: _slice(segment, items))[0]).alias("at", "v"))
        return _placed(found, F.col("at").cast("bigint"))
    if isinstance(segment, Keys):
        picked = F.map_filter(_map(v), lambda k, _: k.isin(*segment.names))
        return df.withColumn("v", F.to_variant_object(picked))
    if isinstance(segment, Filter):
        path, op, value = segment.condition
        test = Compiler(VariantResolver("v")).operator(VariantResolver("v")(path), op, value)
        return _children(df).where(test)
    return _descend(df, segment)


def nodes(df: DataFrame, path: str | list[Segment], value: str = "v") -> DataFrame:
    """All nodes that the path reaches from each row of df: its other columns, `ord` and `v`; sort by them for the order."""
    segments = json_path(path) if isinstance(path, str) else path
    out = df.withColumnRenamed(value, "v") if value != "v" else df
    if "ord" not in out.columns:
        out = out.withColumn("ord", F.array().cast("array<bigint>"))
    for segment in segments:
        out = step(out, segment)
    return out.where(F.col("v").isNotNull())

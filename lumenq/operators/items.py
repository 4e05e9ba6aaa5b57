"""Collection methods: pluck, column, chunk, implode, search, keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions.fields import Resolver, VariantField, variant_kind


def pluck(df: DataFrame, resolver: Resolver, fields: list[str]) -> DataFrame:
    """The fields under their dot paths; missing ones NULL."""
    return df.select(*[resolver(p).value().alias(p) for p in fields])


def column(df: DataFrame, resolver: Resolver, name: str) -> DataFrame:
    """A top-level field of those items that have it."""
    if resolver.variant:
        from lumenq.functions.fields import _quoted

        value = F.try_variant_get(F.col("item"), "$" + _quoted(name), "variant")
    else:
        value = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
    return df.select(value.alias(name)).where(F.col(f"`{name}`").isNotNull())


def item_json(df: DataFrame, resolver: Resolver) -> Column:
    return F.to_json(F.col("item")) if resolver.variant else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def chunk(df: DataFrame, resolver: Resolver, size: int, position: Column | str, value: Column | None = None) -> DataFrame:
    """(chunk_id, n, members): runs of `size` items by their gapless position, members as JSON texts in order."""
    if size <= 0:
        raise ValueError("the size of a chunk must be positive")
    p = F.col(position) if isinstance(position, str) else position
    text = item_json(df, resolver) if value is None else value.cast("string")
    rows = df.select(F.floor(p / size).cast("bigint").alias("chunk_id"), p.alias("p"), text.alias("t"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda r: r["t"])
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), members.alias("members"))


def shown(field) -> Column:
    """A value as joined text: null as `null`, texts as they are, the rest as JSON; NULL if it is missing."""
    if isinstance(field, VariantField):
        return F.when(field.exists(), field.key())
    c = field.value()
    return F.to_json(c) if isinstance(field.type, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def implode(df: DataFrame, resolver: Resolver, name: str, separator: str, position: list[str]) -> DataFrame:
    """One row `joined`: the field's texts in item order."""
    text = shown(resolver(name)).alias("t")
    by = F.struct(*[F.col(f"`{p}`").alias(f"p{k}") for k, p in enumerate(position)]) if position else F.lit(0)
    rows = df.select(by.alias("p"), text).where(F.col("t").isNotNull())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda r: r["t"])
    return rows.agg(F.array_join(parts, separator).alias("joined"))


def _leaf_texts(value: Column, kind: T.DataType) -> list[Column]:
    """Lower-case texts of all leaves of a typed value."""
    if isinstance(kind, T.StructType):
        return [t for f in kind.fields for t in _leaf_texts(value.getField(f.name), f.dataType)]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        items = value if isinstance(kind, T.ArrayType) else F.map_values(value)
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        joined = F.transform(items, lambda x: F.concat_ws("\x00", *_leaf_texts(x, inner)))
        return [F.array_join(joined, "\x00")]
    return [F.coalesce(F.lower(value.cast("string")), F.lit("null"))]


#: Around the JSON text of a leaf: what precedes a value, but never a key, in compact JSON.
_LEAF = r'(?:(?<=[:\[,])|^)("(?:[^"\\]|\\.)*"(?!:)|-?\d[^,\]}]*|true|false|null)'


def search(df: DataFrame, resolver: Resolver, keyword: str) -> DataFrame:
    """Items that hold the keyword in any nested value, whatever the case; keys don't count."""
    word = keyword.lower()
    if not resolver.variant:
        tests = [F.contains(t, F.lit(word)) for f in df.schema.fields for t in _leaf_texts(F.col(f"`{f.name}`"), f.dataType)]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return df.where(out)
    leaves = F.regexp_extract_all(F.to_json(F.col("item")), F.lit(_LEAF), 1)

    def text(x: Column) -> Column:
        plain = F.from_json(F.concat(F.lit('{"a":'), x, F.lit("}")), "a string").getField("a")
        return F.lower(F.when(x.startswith('"'), plain).otherwise(x))

    return df.where(F.exists(leaves, lambda x: F.contains(text(x), F.lit(word))))


def keys(value: Column) -> Column:
    """The sorted keys of a variant object; empty for anything else."""
    names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.when(variant_kind(value) == "object", F.array_sort(names)).otherwise(F.array().cast("array<string>"))


def values(value: Column) -> Column:
    """The values of a variant object in the order of its keys; empty for anything else."""
    m = F.try_variant_get(value, "$", "map<string,variant>")
    return F.when(variant_kind(value) == "object", F.transform(F.array_sort(F.map_keys(m)), lambda k: m[k])).otherwise(F.array().cast("array<variant>"))


def count(value: Column) -> Column:
    """The length of a variant list or the size of a variant object, else 0."""
    kind = variant_kind(value)
    as_list, as_map = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    return F.when(kind == "array", F.size(as_list)).when(kind == "object", F.size(F.map_keys(as_map))).otherwise(0).cast("bigint")

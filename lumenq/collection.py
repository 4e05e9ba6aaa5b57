"""A collection: a frame of items and the operations on it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.errors import QueryError, UnsupportedSql
from lumenq.functions.fields import Resolver, TypedResolver, VariantResolver
from lumenq.operators import aggregate, fluent, indexes, items, jsonpath, schema, vector
from lumenq.operators.match import Compiler
from lumenq.plans import sqlfront
from lumenq.plans.logical import LogicalQuery, position_columns
from lumenq.streaming import pointer as streams


def python_value(value: Any) -> Any:
    """A result cell as plain Python: variants and rows as lists, dicts and scalars."""
    if hasattr(value, "toJson"):
        return json.loads(value.toJson())
    if hasattr(value, "asDict"):
        return {k: python_value(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [python_value(v) for v in value]
    return {k: python_value(v) for k, v in value.items()} if isinstance(value, dict) else value


@dataclass
class Collection:
    """Items of a typed table (rows) or of a document (column `item` of type VARIANT, place `_pos`).

    position: the columns that give items their order; without any, operations that need an order leave it open.
    """

    df: DataFrame
    resolver: Resolver
    position: list[str] = field(default_factory=list)
    name: str = ""
    lexicographic: bool = False
    strict: bool = False
    indexes: dict[tuple[str, ...], indexes.IndexInfo] = field(default_factory=dict)

    # ---- sources -------------------------------------------------------------------------------------------------

    @classmethod
    def of_table(cls, df: DataFrame, position: str | list[str] | None = None, name: str = "", **options) -> Collection:
        return cls(df, TypedResolver(df), position_columns(position), name, **options)

    @classmethod
    def of_document(cls, doc: DataFrame, path: str = "", **options) -> Collection:
        """The array at a dot path of a one-row frame with a VARIANT column `doc`; anything else is empty."""
        from lumenq.functions.fields import variant_at, variant_kind

        value = variant_at(F.col("doc"), path)
        elements = F.when(variant_kind(value) == "array", F.try_variant_get(value, "$", "array<variant>"))
        rows = doc.select(F.posexplode(elements).alias("_pos", "item")).withColumn("_pos", F.col("_pos").cast("bigint"))
        return cls(rows, VariantResolver("item"), ["_pos"], path, **options)

    @classmethod
    def of_values(cls, spark: SparkSession, values: list, **options) -> Collection:
        """A variant collection from Python values."""
        doc = spark.createDataFrame([(json.dumps(values),)], "t string").select(F.parse_json("t").alias("doc"))
        return cls.of_document(doc, **options)

    def on(self, df: DataFrame) -> Collection:
        resolver = self.resolver if self.resolver.variant else TypedResolver(df)
        return replace(self, df=df, resolver=resolver, position=[p for p in self.position if p in df.columns])

    # ---- queries -------------------------------------------------------------------------------------------------

    def _compiler(self) -> Compiler:
        return Compiler(self.resolver, self.lexicographic, self.strict)

    def condition(self, document: Any) -> Column:
        return self._compiler().match(document)

    def find(self, document: Any, ordered: bool | None = None) -> DataFrame:
        """Items that match, in item order where the collection is a document (or where asked for)."""
        out = self.df.filter(self._compiler().match(document, plain=True))
        ordered = self.resolver.variant if ordered is None else ordered
        return out.orderBy(*[F.col(f"`{p}`") for p in self.position]) if ordered and self.position else out

    def find_one(self, document: Any) -> DataFrame:
        """The first match."""
        return LogicalQuery(where=self._compiler().match(document, plain=True), limit=1).apply(self.df, self.resolver, self.position)

    def query(self, spec: Any) -> DataFrame:
        """A query specification."""
        return fluent.plan(self.resolver, spec, self.lexicographic, self.strict).apply(self.df, self.resolver, self.position)

    def sql(self, text: str, last_wins: bool = False) -> DataFrame:
        """A SELECT, or the collection as an INSERT, UPDATE or DELETE leaves it."""
        statement = sqlfront.parse(text)
        if isinstance(statement, sqlfront.Select):
            return self.query(statement.spec(last_wins))
        if isinstance(statement, sqlfront.Insert):
            return self.inserted(statement.row).df
        where = fluent.where_clause(self._compiler(), {"where": statement.where}) if statement.where else F.lit(True)
        where = F.coalesce(where, F.lit(False))
        if isinstance(statement, sqlfront.Update):
            return self.updated(statement.changes, where).df
        return self.df.filter(~where)

    # ---- changes, as new collections -----------------------------------------------------------------------------

    def inserted(self, row: dict[str, Any]) -> Collection:
        """One more item."""
        if self.resolver.variant:
            raise UnsupportedSql("documents are changed through their store")
        types = {f.name: f.dataType for f in self.df.schema.fields}
        if unknown := [k for k in row if k not in types]:
            raise QueryError(f"no column {unknown[0]!r}")
        one = self.df.sparkSession.range(1).select(*[F.lit(row.get(c)).cast(t).alias(c) for c, t in types.items()])
        return self.on(self.df.unionByName(one))

    def updated(self, changes: dict[str, Any], where: Column | dict) -> Collection:
        """Fields set where the condition holds; dot paths reach into structs."""
        if self.resolver.variant:
            raise UnsupportedSql("documents are changed through their store")
        where = self.condition(where) if isinstance(where, dict) else where
        out = self.df
        for path, value in changes.items():
            top, _, rest = path.partition(".")
            if path in out.columns:
                out = out.withColumn(path, F.when(where, F.lit(value)).otherwise(F.col(f"`{path}`")))
            elif rest and top in out.columns:
                out = out.withColumn(top, F.when(where, F.col(f"`{top}`").withField(rest, F.lit(value))).otherwise(F.col(f"`{top}`")))
            else:
                out = out.withColumn(path, F.when(where, F.lit(value)))
        return self.on(out)

    def deleted(self, where: Column | dict) -> Collection:
        where = self.condition(where) if isinstance(where, dict) else where
        return self.on(self.df.filter(~where))

    def incremented(self, path: str, amount: float = 1) -> Collection:
        """Numbers become floats; anything else stays."""
        return self.on(self.df.withColumn(path, F.col(f"`{path}`").cast("double") + F.lit(float(amount))))

    # ---- aggregates ----------------------------------------------------------------------------------------------

    def aggregate(self, path: str, operation: str) -> DataFrame:
        return aggregate.aggregate(self.df, self.resolver, path, operation)

    def aggregate_many(self, spec: dict[str, str]) -> DataFrame:
        return aggregate.aggregate_many(self.df, self.resolver, spec)

    def group_by(self, path: str) -> DataFrame:
        return aggregate.group_by(self.df, self.resolver, path, self.position)

    def group_sizes(self, path: str) -> DataFrame:
        return aggregate.group_sizes(self.df, self.resolver, path)

    def group_aggregate(self, path: str, spec: dict[str, tuple[str, str]]) -> DataFrame:
        return aggregate.group_aggregate(self.df, self.resolver, path, spec)

    # ---- collection methods --------------------------------------------------------------------------------------

    def pluck(self, fields: list[str]) -> DataFrame:
        return items.pluck(self.df, self.resolver, fields)

    def column(self, name: str) -> DataFrame:
        return items.column(self.df, self.resolver, name)

    def chunk(self, size: int, position: Column | str | None = None, value: Column | None = None) -> DataFrame:
        if position is None and len(self.position) != 1:
            raise ValueError("chunk needs a gapless position")
        return items.chunk(self.df, self.resolver, size, self.position[0] if position is None else position, value)

    def implode(self, name: str, separator: str) -> DataFrame:
        return items.implode(self.df, self.resolver, name, separator, self.position)

    def search(self, keyword: str) -> DataFrame:
        return items.search(self.df, self.resolver, keyword)

    def json_path(self, path: str) -> DataFrame:
        """Nodes that a JSONPath reaches from each item: position columns, `ord` and `v`."""
        value = F.col("item") if self.resolver.variant else F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in self.df.columns]))
        return jsonpath.nodes(self.df.select(*self.position, value.alias("v")), path)

    # ---- streams -------------------------------------------------------------------------------------------------

    def stream(self, condition: Any = None, limit: int | None = None, skip: int = 0, select: list[str] | None = None) -> DataFrame:
        return streams.stream(self.df, self.resolver, self.position, condition, limit, skip, select)

    def stream_count(self, condition: Any = None) -> DataFrame:
        return self.df.filter(streams.condition_column(self.resolver, condition)).agg(F.count(F.lit(1)).alias("n"))

    def stream_aggregate(self, operation: str, path: str, condition: Any = None) -> DataFrame:
        return aggregate.stream_aggregate(self.df.filter(streams.condition_column(self.resolver, condition)), self.resolver, operation, path)

    # ---- validation, indexes, vectors ----------------------------------------------------------------------------

    def validate(self, rules: Any, extended: bool = False) -> DataFrame:
        return schema.validate_collection(self.df, self.resolver, rules, extended)

    def invalid(self, rules: Any, extended: bool = False) -> DataFrame:
        return schema.invalid_items(self.df, self.resolver, rules, extended)

    def create_index(self, *fields: str) -> Collection:
        self.indexes[fields] = indexes.IndexInfo(self.name, "single" if len(fields) == 1 else "compound", fields)
        return self

    def list_indexes(self) -> DataFrame:
        return indexes.describe(self.df.sparkSession, [(i, self.df, self.resolver) for i in self.indexes.values()])

    def index_lookup(self, path: str, value: Any) -> DataFrame:
        return indexes.lookup(self.df, self.resolver, path, value)

    def vector_search(self, path: str, query: list[float], limit: int, metric: str | None = None, dimension: int | None = None) -> DataFrame:
        return vector.search(self.df, self.resolver, path, query, limit, metric, self.position, dimension)

    def create_vector_index(self, path: str, dimension: int | None = None, metric: str | None = None) -> vector.VectorIndex | None:
        return vector.VectorIndex.build(self.df, self.resolver, path, dimension, metric)

    # ---- results -------------------------------------------------------------------------------------------------

    def values(self, df: DataFrame, select: list[str] | None = None) -> list:
        """Result rows as Python values: items, or for one selected field scalars and for several objects without the missing."""
        rows = df.collect()
        if select is not None:
            cells = [[python_value(r[p]) for p in select] for r in rows]
            missing = [[r[p] is None for p in select] for r in rows]
            if len(select) == 1:
                return [c[0] for c in cells]
            return [{p: v for p, v, gone in zip(select, c, m) if not gone} for c, m in zip(cells, missing)]
        if self.resolver.variant and "item" in df.columns:
            return [python_value(r["item"]) for r in rows]
        return [python_value(r) for r in rows]

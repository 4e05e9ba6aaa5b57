"""Exact vector search: scores as expressions, the best k by TakeOrderedAndProject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions.fields import Resolver, TypedField

METRICS = {"cosine": "cosine", "l2": "l2", "euclidean": "l2", "dot": "dot", "inner_product": "dot"}


def metric_name(name: str | None) -> str:
    """An unknown metric is cosine."""
    return METRICS.get((name or "cosine").lower(), "cosine")


def _sum(terms: Column) -> Column:
    """In single precision, as the scores are defined."""
    return F.aggregate(terms, F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))


def dot_product(a: Column, b: Column) -> Column:
    s = _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("float")))
    return F.when(F.size(a) == F.size(b), s).otherwise(F.lit(0.0).cast("float"))


def euclidean_distance(a: Column, b: Column) -> Column:
    s = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("float")))).cast("float")
    return F.when(F.size(a) == F.size(b), s).otherwise(F.lit(float("inf")).cast("float"))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: (x * x).cast("float")))).cast("float")


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    norm_a, norm_b = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm_a != 0) & (norm_b != 0)
    return F.when(fits, dot_product(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0)).cast("float")


def score(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_similarity, "l2": euclidean_distance, "dot": dot_product}[metric](a, b)


def vector_column(resolver: Resolver, path: str) -> Column:
    """array<float>; NULL where the field is no list of numbers."""
    f = resolver(path)
    if isinstance(f, TypedField):
        numbers = isinstance(f.type, T.ArrayType) and isinstance(f.type.elementType, T.NumericType)
        return f.column.cast("array<float>") if numbers else F.lit(None).cast("array<float>")
    items = f.elements()
    floats = F.transform(items, lambda x: f.element(x).number().cast("float"))
    return F.when(F.forall(floats, lambda x: x.isNotNull()), floats)


def search(df: DataFrame, resolver: Resolver, path: str, vector: list[float], limit: int, metric: str | None = None, position: list[str] | None = None, dimension: int | None = None) -> DataFrame:
    """All columns and `score` of the k best items: least distance first for l2, else highest score first."""
    if dimension is not None and len(vector) != dimension:
        raise ValueError(f"the query has {len(vector)} dimensions, the index {dimension}")
    metric = metric_name(metric)
    query = F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")
    stored = vector_column(resolver, path)
    rows = df.withColumn("score", score(metric, stored, query)).where(stored.isNotNull())
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return rows.orderBy(best, *[F.col(f"`{p}`") for p in position or []]).limit(limit)


@dataclass
class VectorIndex:
    """Vectors and norms of a field, kept in executor memory."""

    rows: DataFrame
    field: str
    dimension: int | None
    metric: str

    @classmethod
    def build(cls, df: DataFrame, resolver: Resolver, path: str, dimension: int | None = None, metric: str | None = None) -> VectorIndex | None:
        """None if a vector has another dimension than the one that is asked for."""
        v = vector_column(resolver, path)
        rows = df.withColumn("_vector", v).where(F.col("_vector").isNotNull()).withColumn("_norm", norm(F.col("_vector")))
        if dimension is not None and rows.where(F.size("_vector") != dimension).limit(1).count():
            return None
        return cls(rows.cache(), path, dimension, metric_name(metric))

    def search(self, vector: list[float], limit: int, metric: str | None = None, position: list[str] | None = None) -> DataFrame:
        if self.dimension is not None and len(vector) != self.dimension:
            raise ValueError(f"the query has {len(vector)} dimensions, the index {self.dimension}")
        metric = metric_name(metric) if metric else self.metric
        query = F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")
        v = F.col("_vector")
        own = cosine_similarity(v, query, F.col("_norm")) if metric == "cosine" else score(metric, v, query)
        best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
        return self.rows.withColumn("score", own).orderBy(best, *[F.col(f"`{p}`") for p in position or []]).limit(limit).drop("_vector", "_norm")

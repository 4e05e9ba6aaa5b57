"""Fields of collection items as Spark columns.

Two kinds of collection share one compiler. In a typed collection an item is a row of a table and NULL stands for both a
missing and a null field. In a variant collection an item is a VARIANT: a missing field is SQL NULL, a null one a variant
null, and integers differ from floats. A field answers the questions that operators ask, as columns that stay within
whole-stage code generation.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions.paths import dot_segments, is_index



def false() -> Column:
    return F.lit(False)


def _quoted(key: str) -> str:
    if '"' in key:
        if "'" in key:
            return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        return f"['{key}']"
    return f'["{key}"]'


def variant_step(value: Column, step: str) -> Column:
    """The field or, on a list, the element of a variant; NULL if there is none."""
    by_key = F.try_variant_get(value, "$" + _quoted(step), "variant")
    return F.coalesce(by_key, F.try_variant_get(value, f"$[{int(step)}]", "variant")) if is_index(step) else by_key


def variant_at(value: Column, path: str) -> Column:
    """The value of a variant at a dot path."""
    steps = dot_segments(path)
    if steps and not any(map(is_index, steps)):
        return F.try_variant_get(value, "$" + "".join(map(_quoted, steps)), "variant")
    return reduce(variant_step, steps, value)


def variant_kind(value: Column) -> Column:
    """object, array, string, boolean, null, integer or float; NULL for a missing value."""
    s = F.schema_of_variant(value)
    huge = s.rlike(r"^DECIMAL\((2\d|3\d),0\)$")  # an integer beyond 64 bits
    return (
        F.when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when((s == "BIGINT") | huge, "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
    )


class Field:
    """What operators ask of a field. Answers are never NULL unless they say so."""

    def exists(self) -> Column:
        raise NotImplementedError

    def is_null(self) -> Column:
        """Explicit null."""
        raise NotImplementedError

    def missing_or_null(self) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        """The number, or NULL."""
        raise NotImplementedError

    def string(self) -> Column:
        """The text of a string, or NULL."""
        raise NotImplementedError

    def equals(self, value: Any) -> Column:
        raise NotImplementedError

    def key(self) -> Column:
        """The text that groups and indexes use; `null` for missing and null."""
        raise NotImplementedError

    def value(self) -> Column:
        """The field as it is."""
        raise NotImplementedError

    def elements(self) -> Column:
        """The elements of a list, or NULL."""
        raise NotImplementedError

    def element(self, value: Column) -> Field:
        """A field for one element, inside a lambda."""
        raise NotImplementedError

    def kind(self) -> Column:
        raise NotImplementedError


@dataclass
class TypedField(Field):
    column: Column
    type: T.DataType | None  # None: the table has no such column

    def exists(self) -> Column:
        return self.column.isNotNull() if self.type else false()

    def is_null(self) -> Column:
        return self.column.isNull() if self.type else false()

    def missing_or_null(self) -> Column:
        return self.column.isNull() if self.type else F.lit(True)

    def number(self) -> Column:
        return self.column if isinstance(self.type, T.NumericType) else F.lit(None).cast("double")

    def string(self) -> Column:
        return self.column if isinstance(self.type, T.StringType) else F.lit(None).cast("string")

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.is_null()
        if self.type is None:
            return false()
        if isinstance(value, bool):
            fits = isinstance(self.type, T.BooleanType)
        elif isinstance(value, (int, float)):
            fits = isinstance(self.type, T.NumericType) and not (isinstance(value, int) and not -(2**63) <= value < 2**63)
        elif isinstance(value, str):
            if isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                return self.column.cast("string").eqNullSafe(F.lit(value))
            fits = isinstance(self.type, T.StringType)
        else:
            fits = isinstance(self.type, (T.ArrayType, T.StructType, T.MapType))
            return F.to_json(self.column).eqNullSafe(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False))) if fits else false()
        return self.column.eqNullSafe(F.lit(value)) if fits else false()

    def key(self) -> Column:
        if isinstance(self.type, (T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.to_json(self.column), F.lit("null"))
        return F.coalesce(self.column.cast("string"), F.lit("null")) if self.type else F.lit("null")

    def value(self) -> Column:
        return self.column if self.type else F.lit(None).cast("string")

    def elements(self) -> Column:
        return self.column if isinstance(self.type, T.ArrayType) else F.lit(None).cast("array<string>")

    def element(self, value: Column) -> Field:
        return TypedField(value, self.type.elementType if isinstance(self.type, T.ArrayType) else T.StringType())

    def kind(self) -> Column:
        names = ((T.BooleanType, "boolean"), (T.StringType, "string"), (T.IntegralType, "integer"), (T.NumericType, "float"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"))
        name = next((n for t, n in names if isinstance(self.type, t)), "string")
        return F.when(self.column.isNull(), "null").otherwise(name) if self.type else F.lit("null")


def _canonical(value: Any) -> str:
    """Text that is the same for values that are equal and of the same types at all depths."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, (bool, int, str)) or value is None:
        return json.dumps(value)
    return f"f{float(value)!r}"


def _nested_text(value) -> str | None:
    return None if value is None else _canonical(value.toPython())


@dataclass
class VariantField(Field):
    column: Column

    def exists(self) -> Column:
        return self.column.isNotNull()

    def is_null(self) -> Column:
        return F.coalesce(F.is_variant_null(self.column), false())

    def missing_or_null(self) -> Column:
        return self.column.isNull() | self.is_null()

    def kind(self) -> Column:
        return variant_kind(self.column)

    def _as(self, kinds: tuple[str, ...], type_: str) -> Column:
        return F.when(self.kind().isin(*kinds), F.try_variant_get(self.column, "$", type_))

    def number(self) -> Column:
        return self._as(("integer", "float"), "double")

    def string(self) -> Column:
        return self._as(("string",), "string")

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.is_null()
        if isinstance(value, bool):
            own = self._as(("boolean",), "boolean") == value
        elif isinstance(value, int):
            own = self._as(("integer",), "decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)")
        elif isinstance(value, float):
            own = self._as(("float",), "double") == value
        elif isinstance(value, str):
            own = self.string() == value
        else:  # nested: kinds of inner numbers are not visible to built-in functions
            fits = self.kind() == ("array" if isinstance(value, list) else "object")
            own = fits & (F.udf(_nested_text, "string")(self.column) == _canonical(value))
        return F.coalesce(own, false())

    def key(self) -> Column:
        text = F.to_json(self.column)
        whole = (self.kind() == "float") & ~text.rlike("[.eE]")  # JSON text of a float shows that it is one
        return F.coalesce(F.when(self.kind() == "string", self.string()).when(whole, F.concat(text, F.lit(".0"))).otherwise(text), F.lit("null"))

    def value(self) -> Column:
        return self.column

    def elements(self) -> Column:
        return self._as(("array",), "array<variant>")

    def element(self, value: Column) -> Field:
        return VariantField(value)


class TypedResolver:
    """Fields of table rows, by dot path through structs, maps and arrays."""

    variant = False

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def __call__(self, path: str) -> Field:
        if not path:
            return TypedField(F.struct(*[F.col(f"`{n}`") for n in self.schema.names]), self.schema)
        if path in self.schema.names:
            return TypedField(F.col(f"`{path}`"), self.schema[path].dataType)
        column: Column | None = None
        kind: T.DataType = self.schema
        for step in dot_segments(path):
            if isinstance(kind, T.StructType) and step in kind.names:
                column = F.col(f"`{step}`") if column is None else column.getField(step)
                kind = kind[step].dataType
            elif isinstance(kind, T.ArrayType) and is_index(step):
                column, kind = F.get(column, F.lit(int(step))), kind.elementType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
            elif isinstance(kind, T.VariantType):
                return VariantField(variant_at(column, ".".join(dot_segments(path)[1:])))
            else:
                return TypedField(F.lit(None), None)
        return VariantField(column) if isinstance(kind, T.VariantType) else TypedField(column, kind)


class VariantResolver:
    """Fields of a VARIANT column."""

    variant = True

    def __init__(self, item: str | Column = "item"):
        self.item = F.col(item) if isinstance(item, str) else item

    def __call__(self, path: str) -> Field:
        return VariantField(variant_at(self.item, path))


Resolver = TypedResolver | VariantResolver

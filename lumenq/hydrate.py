"""Objects of dataclasses from JSON values, and back; and the Spark type that a dataclass stands for."""

from __future__ import annotations

import dataclasses
import re
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import HydrationError


class Coercion(Enum):
    STRICT = "strict"
    LENIENT = "lenient"


@dataclass(frozen=True)
class HydratorOptions:
    coercion: Coercion = Coercion.STRICT
    unknown: str = "ignore"  # or "raise"
    key: Callable[[str], str] | None = None


def camel_case(key: str) -> str:
    """first_name as firstName."""
    return re.sub(r"_+([a-z0-9])", lambda m: m[1].upper(), key)


def _optional(hint: Any) -> tuple[Any, bool]:
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        return (rest[0] if len(rest) == 1 else Any), len(rest) < len(typing.get_args(hint))
    return hint, hint is Any


def _lenient(value: Any, kind: type) -> Any:
    """As loose languages convert: the leading number of a text, 0 for none; "" and "0" are false."""
    if kind in (int, float):
        if isinstance(value, str):
            m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value)
            value = float(m[0]) if m else 0
        elif isinstance(value, (list, dict)):
            value = bool(value)
        return kind(value)
    if kind is bool:
        return value not in ("", "0") and bool(value)
    if isinstance(value, bool):
        return "1" if value else ""
    return str(value)


@dataclass
class Hydrator:
    options: HydratorOptions = HydratorOptions()

    def hydrate(self, data: dict, cls: type) -> Any:
        """An object of a dataclass. A field that is missing gets its default, None if it may be None, else an error."""
        if not dataclasses.is_dataclass(cls):
            raise HydrationError(f"{cls!r} is no dataclass")
        if not isinstance(data, dict):
            raise HydrationError(f"{cls.__name__} expects an object, got {type(data).__name__}")
        hints, fields = typing.get_type_hints(cls), {f.name: f for f in dataclasses.fields(cls)}
        found = {}
        for key, value in data.items():
            name = self.options.key(key) if self.options.key else key
            if name in fields:
                found[name] = self._value(value, hints[name], name)
            elif self.options.unknown == "raise":
                raise HydrationError(f"unknown property {key!r}")
        for name, f in fields.items():
            bare = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
            if name not in found and bare:
                if not _optional(hints[name])[1]:
                    raise HydrationError(f"property {name!r} is missing")
                found[name] = None
        return cls(**found)

    def hydrate_all(self, items: list, cls: type) -> list:
        return [self.hydrate(i, cls) for i in items]

    def _value(self, value: Any, hint: Any, name: str) -> Any:
        hint, may_be_none = _optional(hint)
        if value is None:
            if not may_be_none:
                raise HydrationError(f"property {name!r} can't be null")
            return None
        if hint is Any:
            return value
        origin = typing.get_origin(hint) or hint
        if origin in (list, dict, tuple):
            if not isinstance(value, (list, dict)):
                raise HydrationError(f"property {name!r} expects an array, got {type(value).__name__}")
            inner = typing.get_args(hint)
            if origin is list and inner and isinstance(value, list):
                return [self._value(v, inner[0], name) for v in value]
            return value
        if dataclasses.is_dataclass(hint):
            return self.hydrate(value, hint)
        if type(value) is hint:
            return value
        if self.options.coercion is Coercion.STRICT:
            raise HydrationError(f"property {name!r} expects {hint.__name__}, got {type(value).__name__}")
        return _lenient(value, hint) if hint in (int, float, bool, str) else value

    def dehydrate(self, value: Any, ignore: tuple[str, ...] = ()) -> Any:
        """Plain JSON values, without the fields named in ignore at any depth."""
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            return {f.name: self.dehydrate(getattr(value, f.name), ignore) for f in dataclasses.fields(value) if f.name not in ignore}
        if isinstance(value, dict):
            return {k: self.dehydrate(v, ignore) for k, v in value.items()}
        return [self.dehydrate(v, ignore) for v in value] if isinstance(value, list) else value


_SPARK = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def spark_type(hint: Any) -> T.DataType:
    """The Spark type of a dataclass or of a field's hint."""
    hint, _ = _optional(hint)
    if dataclasses.is_dataclass(hint):
        hints = typing.get_type_hints(hint)
        return T.StructType([T.StructField(f.name, spark_type(hints[f.name])) for f in dataclasses.fields(hint)])
    if typing.get_origin(hint) is list:
        return T.ArrayType(spark_type((*typing.get_args(hint), str)[0]))
    if typing.get_origin(hint) is dict:
        return T.MapType(T.StringType(), spark_type((*typing.get_args(hint), str, str)[1]))
    return _SPARK.get(hint, T.StringType())


def typed_items(items: DataFrame, cls: type, item: str | Column = "item") -> DataFrame:
    """Variant items as a struct column of the class's type, on the executors; fields that don't convert are NULL."""
    value = F.col(item) if isinstance(item, str) else item
    return items.withColumn("object", F.from_json(F.to_json(value), spark_type(cls)))


@dataclass
class HydratedStore:
    """A store whose results are objects."""

    store: Any
    hydrator: Hydrator = dataclasses.field(default_factory=Hydrator)

    def find_one_as(self, collection: str, condition: Any, cls: type) -> Any:
        found = self.store.find_one(collection, condition)
        return None if found is None else self.hydrator.hydrate(found, cls)

    def find_in_as(self, collection: str, condition: Any, cls: type) -> list:
        return self.hydrator.hydrate_all(self.store.find(collection, condition), cls)

    def stream_as(self, pointer: str, cls: type, condition: Any = None):
        for item in self.store.stream(pointer, condition):
            yield self.hydrator.hydrate(item, cls)

    def set_object(self, path: str, value: Any) -> bool:
        return self.store.set(path, self.hydrator.dehydrate(value))

    def push_object(self, path: str, value: Any) -> bool:
        return self.store.push(path, self.hydrator.dehydrate(value))

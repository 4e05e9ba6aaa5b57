"""JSON-Schema checks compiled to a column of errors.

A schema becomes one expression of type array<struct<path,error>>, empty for a valid item. Keywords that the store's own
validator knows come first; more keywords of the standard follow, switched on by `extended`.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.errors import SecurityError
from lumenq.functions.fields import Field, Resolver, TypedField, VariantField
from lumenq.functions.values import number

MAX_DEPTH = 100
ERRORS = "array<struct<path:string,error:string>>"

#: Formats of the extended keyword set, as Java patterns.
FORMATS = {
    "url": r"^https?://[^\s/?#]+\S*$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
    "ipv6": r"^(?=.*:.*:)[0-9A-Fa-f:.]{2,45}$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)?$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}


def _none() -> Column:
    return F.array().cast(ERRORS)


def _shown(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


class Checker:
    def __init__(self, extended: bool = False):
        self.extended = extended

    def errors(self, f: Field, schema: Any, path: Column | str, depth: int = 0) -> Column:
        """path: text where it is known, a column below the items of a list."""
        if not isinstance(schema, dict):
            return _none()
        parts = [*self._plain(f, schema, path), *self._nested(f, schema, path, depth)]
        if self.extended:
            parts += self._more(f, schema, path, depth)
        out = F.concat(_none(), *parts)
        wanted = schema.get("type")
        if isinstance(wanted, (str, list)):
            fits = self.of_type(f, wanted)
            if self.extended and schema.get("nullable") is True:
                fits = fits | self._null(f)
            text = wanted if isinstance(wanted, str) else " or ".join(map(str, wanted))
            # a wrong type ends the checks of this node
            out = F.when(fits, out).otherwise(F.array(self._error(path, F.concat(F.lit(f"Expected {text}, found "), self._kind(f)))))
        return out

    @staticmethod
    def _error(path: Column | str, text: Column | str) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_column(path).alias("path"), as_column(text).alias("error"))

    def _if(self, wrong: Column, path: Column | str, text: Column | str) -> Column:
        return F.when(wrong, F.array(self._error(path, text))).otherwise(_none())

    @staticmethod
    def _null(f: Field) -> Column:
        return f.missing_or_null()

    @staticmethod
    def _kind(f: Field) -> Column:
        return F.coalesce(f.kind(), F.lit("null"))

    def of_type(self, f: Field, wanted: str | list) -> Column:
        """A number without a fraction is an integer; a type that isn't known always fits."""
        if isinstance(wanted, list):
            out = F.lit(False)
            for w in wanted:
                out = out | self.of_type(f, w)
            return out
        kind = self._kind(f)
        if wanted == "number":
            return kind.isin("integer", "float")
        if wanted == "integer":
            n = f.number().cast("double")
            return (kind == "integer") | ((kind == "float") & F.coalesce(n == F.floor(n), F.lit(False)))
        return kind == wanted if wanted in ("string", "boolean", "array", "object", "null") else F.lit(True)

    def _plain(self, f: Field, schema: dict, path: Column | str) -> list[Column]:
        n, s, out = f.number().cast("double"), f.string(), []
        low = number(schema.get("min", schema.get("minimum")))
        high = number(schema.get("max", schema.get("maximum")))
        if low is not None:
            out.append(self._if(n < low, path, F.concat(F.lit("Value "), n.cast("string"), F.lit(f" < minimum {_shown(low)}"))))
        if high is not None:
            out.append(self._if(n > high, path, F.concat(F.lit("Value "), n.cast("string"), F.lit(f" > maximum {_shown(high)}"))))
        size = F.octet_length(s)
        if (least := number(schema.get("minLength"))) is not None:
            out.append(self._if(size < int(least), path, F.concat(F.lit("String length "), size.cast("string"), F.lit(f" < minLength {int(least)}"))))
        if (most := number(schema.get("maxLength"))) is not None:
            out.append(self._if(size > int(most), path, F.concat(F.lit("String length "), size.cast("string"), F.lit(f" > maxLength {int(most)}"))))
        if isinstance(part := schema.get("pattern"), str):
            out.append(self._if(~F.contains(s, F.lit(part)), path, F.concat(F.lit("Value '"), s, F.lit(f"' does not match pattern '{part}'"))))
        if schema.get("format") == "email":
            out.append(self._if(~(F.contains(s, F.lit("@")) & F.contains(s, F.lit("."))), path, "Invalid email format"))
        if isinstance(choices := schema.get("enum"), list):
            some = F.lit(False)
            for c in choices:
                some = some | (f.equals(c) if c is not None else self._null(f))
            out.append(self._if(~some, path, f"Value not in enum {json.dumps(choices)}"))
        return out

    @staticmethod
    def child(f: Field, name: str) -> Field:
        if isinstance(f, VariantField):
            from lumenq.functions.fields import _quoted

            return VariantField(F.try_variant_get(f.column, "$" + _quoted(name), "variant"))
        if isinstance(f.type, T.StructType) and name in f.type.names:
            return TypedField(f.column.getField(name), f.type[name].dataType)
        if isinstance(f.type, T.MapType):
            return TypedField(F.try_element_at(f.column, F.lit(name)), f.type.valueType)
        return TypedField(F.lit(None), None)

    def _nested(self, f: Field, schema: dict, path: Column | str, depth: int) -> list[Column]:
        out = []
        is_object = self._kind(f) == "object"
        if isinstance(names := schema.get("required"), list):
            for name in (n for n in names if isinstance(n, str)):
                out.append(self._if(is_object & ~self.child(f, name).exists(), path, f"Required field '{name}' missing"))
        if isinstance(properties := schema.get("properties"), dict):
            for name, inner in properties.items():
                below = F.concat(path, F.lit("." + name)) if isinstance(path, Column) else f"{path}.{name}" if path else name
                # a property that is missing is checked as null
                out.append(F.when(is_object, self.errors(self.child(f, name), inner, below, depth + 1)).otherwise(_none()))
        if "items" in schema:
            each = F.transform(f.elements(), lambda x, i: self.errors(f.element(x), schema["items"], F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("."), i.cast("string")), depth + 1))
            out.append(F.coalesce(F.flatten(each), _none()))
        return out

    def _more(self, f: Field, schema: dict, path: Column | str, depth: int) -> list[Column]:
        """Keywords beyond the store's own validator, in their standard meaning."""
        out, n, s, items = [], f.number().cast("double"), f.string(), f.elements()

        def valid(inner: Any) -> Column:
            return F.size(self.errors(f, inner, path, depth + 1)) == 0

        if (m := number(schema.get("multipleOf"))) and m > 0:
            out.append(self._if(F.abs(n / m - F.round(n / m)) > 1e-9, path, f"Value is not a multiple of {_shown(m)}"))
        if (x := number(schema.get("exclusiveMinimum"))) is not None:
            out.append(self._if(n <= x, path, f"Value must be above {_shown(x)}"))
        if (x := number(schema.get("exclusiveMaximum"))) is not None:
            out.append(self._if(n >= x, path, f"Value must be below {_shown(x)}"))
        if (x := number(schema.get("minItems"))) is not None:
            out.append(self._if(F.size(items) < int(x), path, f"Fewer than {int(x)} items"))
        if (x := number(schema.get("maxItems"))) is not None:
            out.append(self._if(F.size(items) > int(x), path, f"More than {int(x)} items"))
        if schema.get("uniqueItems") is True:
            texts = F.transform(items, lambda x: F.concat(F.coalesce(f.element(x).kind(), F.lit("null")), F.lit(":"), f.element(x).key()))
            out.append(self._if(F.size(F.array_distinct(texts)) < F.size(texts), path, "Items are not unique"))
        if "const" in schema:
            out.append(self._if(~f.equals(schema["const"]), path, f"Value is not {json.dumps(schema['const'])}"))
        if (pattern := FORMATS.get(schema.get("format"))) is not None:
            out.append(self._if(~s.rlike(pattern), path, f"Invalid {schema['format']} format"))
        if schema.get("additionalProperties") is False and isinstance(schema.get("properties"), dict):
            known = list(schema["properties"])
            if isinstance(f, VariantField):
                names = F.map_keys(F.try_variant_get(f.column, "$", "map<string,variant>"))
                extra = F.filter(names, lambda k: ~k.isin(known)) if known else names
            else:
                extra = F.array(*[F.lit(x) for x in getattr(f.type, "names", []) if x not in known]).cast("array<string>")
            out.append(self._if((self._kind(f) == "object") & (F.size(extra) > 0), path, F.concat(F.lit("Unexpected properties: "), F.array_join(extra, ", "))))
        for word, test in (("allOf", lambda c, k: c == k), ("anyOf", lambda c, k: c > 0), ("oneOf", lambda c, k: c == 1)):
            if isinstance(options := schema.get(word), list) and options:
                hits = F.lit(0)
                for inner in options:
                    hits = hits + valid(inner).cast("int")
                out.append(self._if(~test(hits, len(options)), path, f"Value does not satisfy {word}"))
        if "not" in schema:
            out.append(self._if(valid(schema["not"]), path, "Value satisfies a schema that it must not"))
        if "if" in schema:
            then = self.errors(f, schema.get("then", {}), path, depth + 1)
            other = self.errors(f, schema.get("else", {}), path, depth + 1)
            out.append(F.when(valid(schema["if"]), then).otherwise(other))
        return out


def schema_depth(schema: Any) -> int:
    """Levels of nesting, over all keywords that hold schemas."""
    if isinstance(schema, list):
        return max(map(schema_depth, schema), default=0)
    if not isinstance(schema, dict):
        return 0
    inner = [*schema["properties"].values()] if isinstance(schema.get("properties"), dict) else []
    inner += [schema[k] for k in ("items", "allOf", "anyOf", "oneOf", "not", "if", "then", "else") if k in schema]
    return 1 + max(map(schema_depth, inner), default=-1)


def errors_column(resolver: Resolver, schema: Any, path: str = "", extended: bool = False) -> Column:
    """The errors of each item; the schema's root is the whole item."""
    if schema_depth(schema) > MAX_DEPTH:
        raise SecurityError(f"a schema may be {MAX_DEPTH} levels deep")
    return Checker(extended).errors(resolver(""), schema, path)


def validate_collection(df: DataFrame, resolver: Resolver, schema: Any, extended: bool = False) -> DataFrame:
    """One row: total_items, valid_items, invalid_items, valid."""
    bad = df.select((F.size(errors_column(resolver, schema, extended=extended)) > 0).alias("bad"))
    counts = bad.agg(F.count(F.lit(1)).alias("total_items"), F.count_if(~F.col("bad")).alias("valid_items"), F.count_if("bad").alias("invalid_items"))
    return counts.withColumn("valid", F.col("invalid_items") == 0)


def invalid_items(df: DataFrame, resolver: Resolver, schema: Any, extended: bool = False) -> DataFrame:
    """The items that fail, with `errors`."""
    return df.withColumn("errors", errors_column(resolver, schema, extended=extended)).where(F.size("errors") > 0)


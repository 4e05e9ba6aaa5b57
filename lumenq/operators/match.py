"""Conditions as columns: Mongo-style match documents and the operators that all front ends share.

A compiled condition is two-valued wherever it is negated. Where it isn't, a predicate may be left as plain `field > x`,
which a filter treats alike and which reaches the scan.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lumenq.functions.fields import Field, Resolver, TypedField, false

REGEX_BYTES = 100 * 1024

MATCH_OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$contains", "$startsWith", "$endsWith")
#: Documented elsewhere as operators, built to their documented meaning.
EXTENDED_OPERATORS = ("$size", "$all", "$elemMatch", "$type")
LOGICAL_OPERATORS = ("$or", "$and", "$nor", "$not")


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def within(value: Any) -> Any:
    """The number, as a float if 64 bits can't hold it."""
    return float(value) if isinstance(value, int) and not -(2**63) <= value < 2**63 else value


class Compiler:
    """lexicographic: order comparisons with a string compare texts instead of following the numeric rule."""

    def __init__(self, resolver: Resolver, lexicographic: bool = False, strict: bool = False):
        self.field, self.lexicographic, self.strict = resolver, lexicographic, strict

    # ---- operators -----------------------------------------------------------------------------------------------

    def ordered(self, f: Field, op: str, value: Any, plain: bool = False) -> Column:
        """>, >=, < and <=. A field without a number stands before all numbers, so `<` and `<=` hold for it."""
        n = f.number()
        if not _is_number(value):
            if self.lexicographic and isinstance(value, str):
                s = f.value().cast("string") if isinstance(f, TypedField) else f.string()
                return F.coalesce({">": s > value, ">=": s >= value, "<": s < value, "<=": s <= value}[op], false())
            warnings.warn(f"`{op} {value!r}` compares with no number; it does not order texts", stacklevel=4)
            return {">": n.isNotNull(), ">=": F.lit(True), "<": false(), "<=": n.isNull()}[op]
        value = within(value)
        if op in (">", ">="):
            test = n > value if op == ">" else n >= value
            return test if plain else F.coalesce(test, false())
        return n.isNull() | (n < value if op == "<" else n <= value)

    def among(self, f: Field, values: Any) -> Column:
        """Membership; a missing field is looked up as null."""
        if not isinstance(values, list):
            return false()
        return reduce(lambda a, b: a | b, self._members(f, values), false())

    @staticmethod
    def _members(f: Field, values: list) -> list[Column]:
        out = [f.missing_or_null()] if any(v is None for v in values) else []
        rest = [v for v in values if v is not None]
        texts = [v for v in rest if isinstance(v, str)]
        if len(texts) > 1:
            out.append(F.coalesce(f.string().isin(texts), false()))
            rest = [v for v in rest if not isinstance(v, str)]
        numbers = [within(v) for v in rest if _is_number(v)]
        if len(numbers) > 1 and isinstance(f, TypedField):
            out.append(F.coalesce(f.number().isin(numbers), false()))
            rest = [v for v in rest if not _is_number(v)]
        return out + [f.equals(v) for v in rest]

    @staticmethod
    def text_test(f: Field, test: str, value: Any) -> Column:
        """contains, startswith or endswith on strings; a pattern that is no string is the empty one."""
        s, pattern = f.string(), F.lit(value if isinstance(value, str) else "")
        return F.coalesce(getattr(F, test)(s, pattern), false())

    @staticmethod
    def regex(f: Field, pattern: Any) -> Column:
        java = java_pattern(pattern if isinstance(pattern, str) else "")
        s = f.string()
        return false() if java is None else F.coalesce((F.octet_length(s) <= REGEX_BYTES) & s.rlike(java), false())

    def between(self, f: Field, bounds: Any) -> Column:
        """Inclusive; fields and bounds without a number count as zero."""
        if not isinstance(bounds, list) or len(bounds) != 2:
            return false()
        low, high = (float(b) if _is_number(b) else 0.0 for b in bounds)
        return F.coalesce(f.number().cast("double"), F.lit(0.0)).between(low, high)

    def operator(self, f: Field, op: str, value: Any, plain: bool = False) -> Column:
        if op == "$eq":
            return f.equals(value)
        if op == "$ne":
            return ~f.equals(value)
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return self.ordered(f, {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}[op], value, plain)
        if op == "$in":
            return self.among(f, value)
        if op == "$nin":
            return ~self.among(f, value) if isinstance(value, list) else false()
        if op == "$exists":
            return (f.exists() if value else ~f.exists()) if isinstance(value, bool) else false()
        if op == "$regex":
            return self.regex(f, value)
        if op in ("$contains", "$startsWith", "$endsWith"):
            return self.text_test(f, op[1:].lower(), value)
        if op in EXTENDED_OPERATORS:
            return self._extended(f, op, value)
        return self.unknown(op)

    def _extended(self, f: Field, op: str, value: Any) -> Column:
        items = f.elements()
        if op == "$size":
            return F.coalesce(F.size(items) == value, false()) if _is_number(value) else false()
        if op == "$all":
            if not isinstance(value, list):
                return false()

            def holds(v: Any) -> Column:
                return F.exists(items, lambda x: f.element(x).equals(v))

            tests = [holds(v) for v in value]
            return F.coalesce(reduce(lambda a, b: a & b, tests, items.isNotNull()), false())
        if op == "$elemMatch":
            if not isinstance(value, dict):
                return false()

            def fits(x: Column) -> Column:
                e = f.element(x)
                if any(k.startswith("$") for k in value):
                    return reduce(lambda a, b: a & b, [self.operator(e, k, v) for k, v in value.items()], F.lit(True))
                return Compiler(ElementResolver(e), self.lexicographic, self.strict).match(value)

            return F.coalesce(F.exists(items, fits), false())
        kinds = {"number": ("integer", "float"), "double": ("float",), "int": ("integer",), "bool": ("boolean",)}.get(value, (value,))
        return F.coalesce(f.kind().isin(*kinds), false()) & f.exists()

    def unknown(self, op: str, known: tuple[str, ...] = (*MATCH_OPERATORS, *EXTENDED_OPERATORS, *LOGICAL_OPERATORS)) -> Column:
        near = suggestion(op, known)
        said = f"unknown operator {op!r} matches nothing" + (f"; did you mean {near!r}?" if near else "")
        if self.strict:
            from lumenq.errors import QueryError

            raise QueryError(said)
        warnings.warn(said, stacklevel=4)
        return false()

    # ---- documents -----------------------------------------------------------------------------------------------

    def match(self, condition: Any, plain: bool = False) -> Column:
        """A match document; `{}` holds for every item and anything but a document for none."""
        if not isinstance(condition, dict):
            return false()
        tests = [self._logical(k, v) if k.startswith("$") else self._of_field(k, v, plain) for k, v in condition.items()]
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    def _of_field(self, path: str, test: Any, plain: bool) -> Column:
        f = self.field(path)
        if not isinstance(test, dict):
            return f.equals(test)
        tests = [self.operator(f, op, v, plain) for op, v in test.items()]
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    def _logical(self, op: str, value: Any) -> Column:
        if op == "$not":
            return ~self.match(value) if isinstance(value, dict) else F.lit(True)
        if op not in LOGICAL_OPERATORS:
            return self.unknown(op)
        if not isinstance(value, list):
            return false()
        tests = [self.match(c) for c in value]
        if op == "$and":
            return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        some = reduce(lambda a, b: a | b, tests) if tests else false()
        return some if op == "$or" else ~some


class ElementResolver:
    """Fields of one element inside a lambda."""

    def __init__(self, element: Field):
        self.element = element

    def __call__(self, path: str) -> Field:
        from pyspark.sql import types as T

        from lumenq.functions.fields import VariantField, variant_at
        from lumenq.functions.paths import dot_segments

        if isinstance(self.element, VariantField):
            return VariantField(variant_at(self.element.column, path))
        column, kind = self.element.column, self.element.type
        for step in dot_segments(path):
            if not isinstance(kind, T.StructType) or step not in kind.names:
                return TypedField(F.lit(None), None)
            column, kind = column.getField(step), kind[step].dataType
        return TypedField(column, kind)


def java_pattern(pattern: str) -> str | None:
    """The pattern in Java's notation, with Unicode classes; None if it isn't valid."""
    java = "(?U)" + re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern)
    java = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\\k<{m[1].replace('_', 'U')}>", java)
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
        else:
            re.compile(pattern)
    except Exception:
        return None
    return java


def suggestion(word: str, known: tuple[str, ...], most: int = 2) -> str | None:
    """The known word within `most` edits that is nearest."""
    near = [(d, k) for k in known if (d := edits(word, k)) <= most]
    return min(near)[1] if near else None


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


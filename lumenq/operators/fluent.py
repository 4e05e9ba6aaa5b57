"""Query specifications: {"where": [...], "order_by": ..., "skip": ..., "limit": ..., "select" or "except": [...]}."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column

from lumenq.functions.fields import Resolver, false
from lumenq.functions.values import whole_number
from lumenq.operators.match import Compiler
from lumenq.plans.logical import LogicalQuery

#: Names of comparison operators; those on the right are documented synonyms.
SYNONYMS = {
    "eq": "=", "==": "=", "ne": "!=", "<>": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=",
    "starts_with": "startsWith", "ends_with": "endsWith", "nin": "not in", "not_in": "not in", "like": "like",
}
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "contains", "startsWith", "endsWith", "between", "eq", "ne", "gt", "gte", "lt", "lte")


def condition(compiler: Compiler, spec: Any, plain: bool = False) -> Column:
    """One {"field", "op", "value"}; the operator is `=`, the value null and the field the whole item by default."""
    spec = spec if isinstance(spec, dict) else {}
    path, op, value = spec.get("field", ""), spec.get("op", "="), spec.get("value")
    f = compiler.field(path if isinstance(path, str) else "")
    op = SYNONYMS.get(op, op)
    if op == "=":
        return f.equals(value)
    if op == "!=":
        return ~f.equals(value)
    if op in (">", ">=", "<", "<="):
        return compiler.ordered(f, op, value, plain)
    if op == "in":
        return compiler.among(f, value)
    if op == "not in":
        return ~compiler.among(f, value) if isinstance(value, list) else false()
    if op in ("contains", "startsWith", "endsWith"):
        return compiler.text_test(f, op.lower(), value)
    if op == "between":
        return compiler.between(f, value)
    return compiler.unknown(op, OPERATORS)


def where_clause(compiler: Compiler, spec: dict) -> Column | None:
    """All of `where`; or any of `orWhere` instead, where it is given."""
    conditions, others = spec.get("where"), spec.get("orWhere")
    every = [condition(compiler, c, plain=not others) for c in conditions] if isinstance(conditions, list) else []
    out = reduce(lambda a, b: a & b, every) if every else None
    if isinstance(others, list) and others:
        some = reduce(lambda a, b: a | b, [condition(compiler, c) for c in others])
        out = some if out is None else out | some
    return out


def plan(resolver: Resolver, spec: Any, lexicographic: bool = False, strict: bool = False) -> LogicalQuery:
    """The logical plan of a specification; clauses of a wrong shape are left out."""
    spec = spec if isinstance(spec, dict) else {}
    query = LogicalQuery(where=where_clause(Compiler(resolver, lexicographic, strict), spec))
    order = spec.get("order_by", spec.get("sort"))
    if isinstance(order, dict) and isinstance(order.get("field"), str):
        query.order = (order["field"], order.get("direction") == "desc" or order.get("desc") is True)
    query.skip = whole_number(spec.get("skip", spec.get("offset"))) or 0
    query.limit = whole_number(spec.get("limit"))
    if isinstance(spec.get("select"), list):
        query.select = [p for p in spec["select"] if isinstance(p, str)]
    elif isinstance(spec.get("except"), list):
        query.drop = [p for p in spec["except"] if isinstance(p, str)]
    return query

"""The SQL dialect: SELECT, INSERT, UPDATE and DELETE over one collection.

A tokenizer that knows quotes and a small grammar; clauses behind FROM may stand in any order. Statements become the same
logical plan as query specifications; nothing is handed to Spark's own parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from lumenq.errors import QueryError, UnsupportedSql
from lumenq.plans.literals import literal

_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<op><=|>=|!=|<>|=|<|>)|(?P<mark>[(),*;])|(?P<word>[^\s'\"<>=!(),;]+))")
_CLAUSES = ("FROM", "WHERE", "ORDER", "LIMIT", "OFFSET", "SET", "VALUES", "INTO")
_REFUSED = {"OR", "NOT", "BETWEEN", "IS", "JOIN", "GROUP", "HAVING", "UNION", "DISTINCT"}


@dataclass
class Token:
    kind: str
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    sql = sql.rstrip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m or m.end() == at:
            raise QueryError("this can't be read", at, sql, "close the quotes")
        kind = m.lastgroup or ""
        out.append(Token(kind, m[kind], m.start(kind)))
        at = m.end()
    while out and out[-1].text == ";":
        out.pop()
    return out


@dataclass
class Select:
    fields: list[str] | None
    collection: str
    where: list[dict] = field(default_factory=list)
    order: tuple[str, bool] | None = None
    limit: int | None = None
    offset: int = 0

    def spec(self, last_wins: bool = False) -> dict:
        """The query specification. last_wins: of several conditions on a field only the last one counts."""
        where = list({c["field"]: c for c in self.where}.values()) if last_wins else self.where
        out: dict[str, Any] = {"where": where, "skip": self.offset}
        if self.order:
            out["order_by"] = {"field": self.order[0], "desc": self.order[1]}
        if self.limit is not None:
            out["limit"] = self.limit
        if self.fields is not None:
            out["select"] = self.fields
        return out


@dataclass
class Insert:
    collection: str
    row: dict[str, Any]


@dataclass
class Update:
    collection: str
    changes: dict[str, Any]
    where: list[dict]


@dataclass
class Delete:
    collection: str
    where: list[dict]


Statement = Select | Insert | Update | Delete


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i = sql, tokens(sql), 0

    def fail(self, message: str, suggestion: str = "", kind: type[QueryError] = QueryError) -> QueryError:
        at = self.tokens[self.i].at if self.i < len(self.tokens) else len(self.sql)
        return kind(message, at, self.sql, suggestion)

    def peek(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def next(self, what: str) -> Token:
        if self.i >= len(self.tokens):
            raise self.fail(f"{what} is missing")
        self.i += 1
        return self.tokens[self.i - 1]

    def word(self, *words: str) -> bool:
        t = self.peek()
        if t and t.word in words:
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        t = self.peek()
        if not t or (t.word or t.text) != text:
            raise self.fail(f"{text} is missing")
        self.i += 1

    def name(self, what: str) -> str:
        t = self.next(what)
        if t.kind not in ("word", "text"):
            self.i -= 1
            raise self.fail(f"{what} is missing")
        return t.text.strip("'\"") if t.kind == "text" else t.text

    def value(self) -> Any:
        """Bare words run on to the next clause, AND, comma or bracket."""
        t = self.next("a value")
        if t.kind == "text":
            return t.text[1:-1]
        if t.kind != "word":
            self.i -= 1
            raise self.fail("a value is missing")
        words = [t.text]
        while (n := self.peek()) and n.kind == "word" and n.word not in (*_CLAUSES, "AND", *_REFUSED):
            words.append(self.next("a value").text)
        return literal(" ".join(words))

    # ---- statements ----------------------------------------------------------------------------------------------

    def statement(self) -> Statement:
        if self.word("SELECT"):
            return self.select()
        if self.word("INSERT"):
            return self.insert()
        if self.word("UPDATE"):
            return self.update()
        if self.word("DELETE"):
            return self.delete()
        raise self.fail("the statement is not supported", "begin with SELECT, INSERT, UPDATE or DELETE", UnsupportedSql)

    def select(self) -> Select:
        fields: list[str] | None = []
        while (t := self.peek()) and t.word != "FROM":
            if t.word in _REFUSED:
                raise self.fail(f"{t.word} is not supported", kind=UnsupportedSql)
            if t.text == "*":
                fields, _ = None, self.next("*")
            else:
                name = self.name("a field")
                if (n := self.peek()) and n.text == "(":
                    raise self.fail("functions are not supported", "use aggregate()", UnsupportedSql)
                if fields is not None:
                    fields.append(name)
            if (n := self.peek()) and n.text == ",":
                self.next(",")
        if not self.word("FROM"):
            raise self.fail("FROM is missing", "write SELECT fields FROM collection")
        collection = self.name("a collection") if (t := self.peek()) and t.word not in _CLAUSES else ""
        out = Select(fields or None, collection)
        while t := self.peek():
            if self.word("WHERE"):
                out.where = self.conditions()
            elif self.word("ORDER"):
                self.expect("BY")
                key = self.name("a field")
                out.order = (key, False)
                if self.word("DESC"):
                    out.order = (key, True)
                else:
                    self.word("ASC")
                while (n := self.peek()) and n.text == ",":  # further keys are read over
                    self.next(",")
                    self.name("a field")
                    self.word("ASC", "DESC")
            elif self.word("LIMIT"):
                out.limit = self.count()
            elif self.word("OFFSET"):
                out.offset = self.count()
            else:
                raise self.fail(f"{t.text} is not supported here", kind=UnsupportedSql)
        return out

    def count(self) -> int:
        t = self.next("a number")
        if not t.text.isdigit():
            self.i -= 1
            raise self.fail("a whole number is missing")
        return int(t.text)

    def conditions(self) -> list[dict]:
        out = [self.condition()]
        while self.word("AND"):
            out.append(self.condition())
        if (t := self.peek()) and t.word in _REFUSED:
            raise self.fail(f"{t.word} is not supported", "conditions can be joined by AND only", UnsupportedSql)
        return out

    def condition(self) -> dict:
        if (t := self.peek()) and (t.text == "(" or t.word == "NOT"):
            raise self.fail(f"{t.text} is not supported in WHERE", kind=UnsupportedSql)
        name = self.name("a field")
        t = self.next("an operator")
        if t.kind == "op":
            return {"field": name, "op": {"<>": "!="}.get(t.text, t.text), "value": self.value()}
        if t.word == "LIKE":
            return self.like(name, self.value())
        if t.word == "IN":
            return {"field": name, "op": "in", "value": self.listed()}
        self.i -= 1
        raise self.fail(f"{t.text} is not an operator here", kind=UnsupportedSql if t.word in _REFUSED else QueryError)

    @staticmethod
    def like(name: str, pattern: Any) -> dict:
        """% at either end only; inside, % and _ are themselves."""
        p = pattern if isinstance(pattern, str) else str(pattern)
        head, tail = p.startswith("%"), p.endswith("%") and len(p) > 1
        op = {(True, True): "contains", (True, False): "endsWith", (False, True): "startsWith", (False, False): "="}[head, tail]
        return {"field": name, "op": op, "value": p[head : len(p) - tail] if op != "=" else pattern}

    def listed(self) -> list:
        self.expect("(")
        out = []
        while (t := self.peek()) and t.text != ")":
            out.append(self.value())
            if (n := self.peek()) and n.text == ",":
                self.next(",")
        self.expect(")")
        return out

    def insert(self) -> Insert:
        if not self.word("INTO"):
            raise self.fail("INTO is missing")
        collection = self.name("a collection")
        self.expect("(")
        names = []
        while (t := self.peek()) and t.text != ")":
            names.append(self.name("a column"))
            if (n := self.peek()) and n.text == ",":
                self.next(",")
        self.expect(")")
        if not self.word("VALUES"):
            raise self.fail("VALUES is missing")
        values = self.listed()
        if len(names) != len(values):
            raise self.fail(f"{len(names)} columns but {len(values)} values")
        return Insert(collection, dict(zip(names, values)))

    def update(self) -> Update:
        collection = self.name("a collection")
        if not self.word("SET"):
            raise self.fail("SET is missing")
        changes = {}
        while True:
            name = self.name("a field")
            self.expect("=")
            changes[name] = self.value()
            if not ((n := self.peek()) and n.text == ","):
                break
            self.next(",")
        return Update(collection, changes, self.rest())

    def delete(self) -> Delete:
        if not self.word("FROM"):
            raise self.fail("FROM is missing")
        return Delete(self.name("a collection"), self.rest())

    def rest(self) -> list[dict]:
        where = self.conditions() if self.word("WHERE") else []
        if t := self.peek():
            raise self.fail(f"{t.text} is not supported here", kind=UnsupportedSql)
        return where


def parse(sql: str) -> Statement:
    return Parser(sql).statement()

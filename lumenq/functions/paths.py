"""Readers for the three path notations: dot paths, JSONPath and JSON Pointer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lumenq.errors import PointerError, QueryError, SecurityError

MAX_PATH_DEPTH = 50


def dot_segments(path: str) -> list[str]:
    """`a.b.0` as ["a", "b", "0"]; the empty path is the root."""
    return path.split(".") if path else []


def is_index(segment: str) -> bool:
    return segment.isascii() and segment.isdigit()


def path_depth(path: str) -> int:
    return len(dot_segments(path))


def parent_and_key(path: str) -> tuple[str, str]:
    """`a.b.c` as ("a.b", "c")."""
    parent, _, key = path.rpartition(".")
    return parent, key


def check_depth(path: str, most: int = MAX_PATH_DEPTH) -> str:
    """The path, if it has at most `most` segments."""
    if path_depth(path) > most:
        raise SecurityError(f"path has {path_depth(path)} segments; at most {most} are allowed")
    return path


def is_json_path(path: str) -> bool:
    """Whether a `get` path is JSONPath rather than a dot path."""
    return any(mark in path for mark in ("..", "*", "["))


# ---- JSONPath ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Descend:
    """All values under `name` at any depth; `*` for every value."""

    name: str


@dataclass(frozen=True)
class Slice:
    start: int | None
    end: int | None
    step: int


@dataclass(frozen=True)
class Keys:
    """One object with those of the names that are there."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    """`[?(@.field op literal)]`: elements that fulfil a condition of the match language."""

    condition: tuple  # of (field, operator, value)


Segment = Key | Index | Wildcard | Descend | Slice | Keys | Filter
_PART = re.compile(r"(?P<descend>\.\.)(?P<deep>[^.\[]*)|\.(?P<dotted>[^.\[]*)|\[(?P<inside>[^\]]*)(?P<close>\]?)|(?P<bare>[^.\[]+)")
_TEST = re.compile(r"^\?\(\s*@\.(?P<field>[\w.$-]+)\s*(?P<op>==|!=|>=|<=|>|<)\s*(?P<value>.+?)\s*\)$", re.S)
_OPERATORS = {"==": "$eq", "!=": "$ne", ">=": "$gte", "<=": "$lte", ">": "$gt", "<": "$lt"}


def _integer(text: str) -> int | None:
    text = text.strip()
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else None


def _slice(text: str, at: int, source: str) -> Slice:
    parts = text.split(":")
    if len(parts) > 3:
        raise QueryError("a slice has at most two colons", at, source, "write [start:end:step]")
    start, end, step = (_integer(p) for p in (*parts, "", "")[:3])
    if step == 0:
        raise QueryError("the step of a slice can't be 0", at, source, "write [start:end:step]")
    return Slice(start, end, 1 if step is None else step)


def _bracket(text: str, at: int, source: str) -> Segment:
    if test := _TEST.match(text.strip()):
        from lumenq.plans.literals import literal

        return Filter((test["field"], _OPERATORS[test["op"]], literal(test["value"])))
    if text == "*":
        return Wildcard()
    if ":" in text:
        return _slice(text, at, source)
    if any(c in text for c in ",\"'"):
        names = tuple(p.strip().strip("\"'") for p in text.split(","))
        return Keys(tuple(n for n in names if n))
    number = _integer(text)
    return Key(text.strip()) if number is None else Index(number)


def json_path(text: str) -> list[Segment]:
    """`$.a[0]..b[1:5]['x','y']` as segments; a leading `$` stands for the root."""
    out: list[Segment] = []
    at = 0
    while at < len(text):
        m = _PART.match(text, at)
        if m["inside"] is not None:
            if not m["close"]:
                raise QueryError("bracket is not closed", at, text, "add ']' behind the index, slice or key")
            out.append(_bracket(m["inside"], at, text))
        elif m["descend"]:
            out.append(Descend(m["deep"]))
        else:
            name = m["dotted"] if m["dotted"] is not None else m["bare"]
            if name == "*":
                out.append(Wildcard())
            elif name and not (name == "$" and at == 0):
                out.append(Key(name))
        at = m.end()
    return out


def many_results(segments: list[Segment]) -> bool:
    """Whether a path gives a list (wildcard, descent, slice, filter) rather than its first hit."""
    return any(isinstance(s, (Wildcard, Descend, Slice, Filter)) for s in segments)


def slice_bounds(s: Slice, length: int) -> range:
    """The positions that a slice takes from a list of that length, as Python does."""
    return range(length)[slice(s.start, s.end, s.step)]


# ---- JSON Pointer ------------------------------------------------------------------------------------------------


def pointer_tokens(pointer: str) -> list[str]:
    """RFC 6901: `/a~1b/0` as ["a/b", "0"]; the empty pointer is the root."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise PointerError(f"a JSON pointer begins with '/': {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]

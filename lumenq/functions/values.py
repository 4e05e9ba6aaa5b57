"""JSON values on the driver: reading, editing and merging documents, and the keys that groups and indexes use."""

from __future__ import annotations

import json
from typing import Any

from lumenq.functions.paths import dot_segments, is_index

MISSING = object()


def compact(value: Any) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def value_key(value: Any) -> str:
    """The text that groups and indexes know a value by; a missing value and null share one."""
    if value is MISSING or value is None:
        return "null"
    return value if isinstance(value, str) else compact(value)


def same(a: Any, b: Any) -> bool:
    """Typed equality: 1, 1.0, "1" and true all differ; missing equals nothing."""
    if a is MISSING or b is MISSING or type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def number(value: Any) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def read(value: Any, path: str) -> Any:
    """The value at a dot path, or MISSING."""
    for step in dot_segments(path):
        if isinstance(value, dict):
            value = value.get(step, MISSING)
        elif isinstance(value, list) and is_index(step) and int(step) < len(value):
            value = value[int(step)]
        else:
            return MISSING
        if value is MISSING:
            return MISSING
    return value


def write(root: Any, path: str, value: Any) -> Any:
    """The document with value at path. Containers on the way are made; scalars on the way leave it as it is."""
    steps = dot_segments(path)
    if not steps:
        return value
    here = root
    for step, following in zip(steps, [*steps[1:], None]):
        fresh = [] if following is not None and is_index(following) else {}
        if isinstance(here, dict):
            if following is None:
                here[step] = value
            else:
                here = here.setdefault(step, fresh)
        elif isinstance(here, list) and is_index(step):
            at = int(step)
            if following is None:
                here.extend([None] * (at - len(here)))
                here[at : at + 1] = [value]
            else:
                here.extend({} for _ in range(at + 1 - len(here)))
                here = here[at]
        else:
            break
    return root


def remove(root: Any, path: str) -> bool:
    """Take out the key or the list element at path; whether there was one."""
    parent, _, last = path.rpartition(".")
    holder = read(root, parent)
    if isinstance(holder, dict) and last in holder:
        del holder[last]
        return True
    if isinstance(holder, list) and is_index(last) and int(last) < len(holder):
        del holder[int(last)]
        return True
    return False


def merged(base: Any, new: Any) -> Any:
    """Objects key by key, lists one behind the other, else the new value."""
    if isinstance(base, dict) and isinstance(new, dict):
        return {**base, **{k: merged(base[k], v) if k in base else v for k, v in new.items()}}
    if isinstance(base, list) and isinstance(new, list):
        return base + new
    return new


def holds_text(value: Any, keyword: str) -> bool:
    """Whether any leaf's text holds the lower-case keyword; keys don't count."""
    if isinstance(value, dict):
        return any(holds_text(v, keyword) for v in value.values())
    if isinstance(value, list):
        return any(holds_text(v, keyword) for v in value)
    return keyword in (value if isinstance(value, str) else json.dumps(value)).lower()


def all_keys(value: Any) -> list[str]:
    """Every object key at any depth, repeats included."""
    if isinstance(value, dict):
        return [*value, *(k for v in value.values() for k in all_keys(v))]
    return [k for v in value for k in all_keys(v)] if isinstance(value, list) else []


def whole_number(value: Any) -> int | None:
    """A count from a number: fractions cut off, negatives zero; else None."""
    n = number(value)
    return None if n is None else max(0, int(n))


def readable_size(size: int) -> str:
    if size < 1 << 10:
        return f"{size} B"
    return f"{size / 1024:.2f} KB" if size < 1 << 20 else f"{size / (1 << 20):.2f} MB"

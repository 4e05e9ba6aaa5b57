"""The match language on plain Python values, written from its rules; tests compare the compiled columns with it."""

import re

from lumenq.functions.values import MISSING, number, read, same


def _less(a, b):
    """None stands before all numbers."""
    return b is not None and (a is None or a < b)


def operator(value, op, expected):
    n, e = (None if value is MISSING else number(value)), number(expected)
    text = value if isinstance(value, str) else None
    part = expected if isinstance(expected, str) else ""
    if op == "$eq":
        return same(value, expected)
    if op == "$ne":
        return not same(value, expected)
    if op == "$gt":
        return _less(e, n)
    if op == "$gte":
        return _less(e, n) or e == n
    if op == "$lt":
        return _less(n, e)
    if op == "$lte":
        return _less(n, e) or e == n
    if op in ("$in", "$nin"):
        if not isinstance(expected, list):
            return False
        held = any(same(None if value is MISSING else value, x) for x in expected)
        return held == (op == "$in")
    if op == "$exists":
        return isinstance(expected, bool) and expected == (value is not MISSING)
    if op == "$regex":
        try:
            return text is not None and len(text.encode()) <= 102400 and re.search(part, text) is not None
        except re.error:
            return False
    if op == "$contains":
        return text is not None and part in text
    if op == "$startsWith":
        return text is not None and text.startswith(part)
    if op == "$endsWith":
        return text is not None and text.endswith(part)
    return False


def matches(item, condition):
    if not isinstance(condition, dict):
        return False
    for key, test in condition.items():
        if key == "$or":
            ok = isinstance(test, list) and any(matches(item, c) for c in test)
        elif key == "$and":
            ok = isinstance(test, list) and all(matches(item, c) for c in test)
        elif key == "$nor":
            ok = isinstance(test, list) and not any(matches(item, c) for c in test)
        elif key == "$not":
            ok = not matches(item, test)
        elif key.startswith("$"):
            ok = False
        else:
            value = read(item, key)
            ok = all(operator(value, op, x) for op, x in test.items()) if isinstance(test, dict) else same(value, test)
        if not ok:
            return False
    return True

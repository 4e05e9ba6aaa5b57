"""Literals as they stand in query texts."""

from __future__ import annotations

import re

_WORDS = {"true": True, "false": False, "null": None}


def literal(text: str):
    """Quoted text, true, false, null, an integer, a float, or else the bare word."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return text

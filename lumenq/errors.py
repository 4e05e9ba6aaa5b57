"""Exceptions."""

from __future__ import annotations


class LumenqError(Exception):
    """Base of all errors that the library raises."""


class QueryError(LumenqError, ValueError):
    """A query text or path that can't be read; says where and what may help."""

    def __init__(self, message: str, position: int = 0, source: str = "", suggestion: str = ""):
        self.message, self.position, self.source, self.suggestion = message, position, source, suggestion
        super().__init__(str(self))

    @property
    def context(self) -> str:
        """The source around the position, with a mark below it."""
        if not self.source:
            return ""
        a = max(0, self.position - 20)
        return f"{self.source[a : self.position + 20]}\n{' ' * (self.position - a)}^"

    def __str__(self) -> str:
        parts = [f"{self.message} at position {self.position}", self.context, self.suggestion and f"Suggestion: {self.suggestion}"]
        return "\n".join(p for p in parts if p)


class UnsupportedSql(QueryError):
    """SQL beyond the dialect."""


class SecurityError(LumenqError):
    """A path, size or depth that the configuration forbids."""


class PointerError(LumenqError, LookupError):
    """A JSON pointer that leads nowhere."""


class TransactionError(LumenqError):
    """A transaction call out of order."""


class HydrationError(LumenqError, TypeError):
    """An object that does not fit its class."""


class ValidationError(LumenqError):
    """A document that its schema rejects, where the store enforces one."""

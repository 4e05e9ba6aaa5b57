"""Limits that hold for all stores of a process."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from lumenq.errors import SecurityError

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


@dataclass
class Config:
    max_file_size: int = 100 << 20
    allowed_extensions: list[str] = field(default_factory=lambda: ["json", "jsonl", "db"])
    base_path: str | None = None
    max_path_depth: int = 50
    max_validation_depth: int = 100

    def check_path(self, path: str) -> Path:
        """The path, if it stays inside the base path, has no `..` and an extension that is allowed."""
        p = Path(path)
        if ".." in p.parts:
            raise SecurityError("'..' is not allowed in a path")
        if p.suffix.lstrip(".").lower() not in self.allowed_extensions:
            raise SecurityError(f"extension {p.suffix!r} is not allowed")
        if self.base_path is not None and not p.resolve().is_relative_to(Path(self.base_path).resolve()):
            raise SecurityError(f"{path} is outside of {self.base_path}")
        return p

    def check_size(self, size: int) -> None:
        if size > self.max_file_size:
            raise SecurityError(f"{size} bytes; at most {self.max_file_size} are allowed")


config = Config()


def parse_size(text: str) -> int:
    """`100M` and the like as bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([BKMG]?)\s*", text.upper())
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def get_config() -> dict:
    return asdict(config)


def set_max_file_size(size: str | int) -> int:
    config.max_file_size = parse_size(size) if isinstance(size, str) else int(size)
    return config.max_file_size


def set_allowed_extensions(text: str) -> list[str]:
    config.allowed_extensions = [e.strip().lower() for e in text.split(",") if e.strip()]
    return config.allowed_extensions


def set_base_path(path: str) -> None:
    config.base_path = path


def clear_base_path() -> None:
    config.base_path = None

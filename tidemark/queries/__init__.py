"""Registered queries of the library's own operators, with the same results in DuckDB's SQL."""

from __future__ import annotations

from . import aggregates, alignment, scalars, selection, sources, strings, times, windows
from .base import FOUND, Query

__all__ = ["aggregates", "alignment", "scalars", "selection", "sources", "strings", "times", "windows"]


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}

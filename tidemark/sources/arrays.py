"""Literal arrays of a stated type, with a validity mask."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import SparkSession

from ..frame import Frame

_UNITS = {"second": 1_000_000, "millisecond": 1_000, "microsecond": 1}


@dataclass(frozen=True)
class Array:
    values: Sequence[Any]
    kind: str


def typed(values: Sequence[Any], kind: str, valid: Sequence[bool] | None = None) -> Array:
    """Values of a Spark type; those that aren't valid are null."""
    if valid is not None and len(valid) != len(values):
        raise ValueError("the mask and the values differ in length")
    return Array([v if ok else None for v, ok in zip(values, valid or [True] * len(values))], kind)


def dates(days: Sequence[int], valid: Sequence[bool] | None = None) -> Array:
    """Dates from days since 1970."""
    return typed([date(1970, 1, 1) + timedelta(days=d) for d in days], "date", valid)


def times(ticks: Sequence[int], unit: str = "microsecond", valid: Sequence[bool] | None = None) -> Array:
    """Timestamps without a zone from seconds, milliseconds or microseconds since 1970."""
    return typed([datetime(1970, 1, 1) + timedelta(microseconds=t * _UNITS[unit]) for t in ticks], "timestamp_ntz", valid)


def constant(value: Any, n: int, kind: str) -> Array:
    """One value n times."""
    return Array([value] * n, kind)


def frame(spark: SparkSession, arrays: Mapping[str, Array], index: Sequence[Any] | None = None) -> Frame:
    """Arrays of one length as columns."""
    schema = ", ".join(f"`{c}` {a.kind}" for c, a in arrays.items())
    return Frame.from_columns(spark, {c: a.values for c, a in arrays.items()}, index, schema)

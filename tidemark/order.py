"""Total orders cut into ranges.

``Ranges`` cuts the rows of a table at a sample of its whole order key: every
part of the key counts, of whatever type and direction, so neither strings nor
a value that a third of all rows share end up in one task.  Sample and range
sizes are collected, some thousand values whatever the input, and become
literals: every plan that uses them sees the same ranges, and a task that is
run again finds the same rows.  Both jobs read the key columns only.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PART = "__part"
#: Sampled rows per range, and ranges at most.
DRAWN, MOST = 16, 4096
#: Characters of a string that a bound keeps; any text is a valid bound.
PREFIX = 64


@dataclass(frozen=True)
class Key:
    """One part of an order."""

    value: Column
    ascending: bool = True
    nulls_first: bool = True

    @property
    def sort(self) -> Column:
        if self.ascending:
            return self.value.asc_nulls_first() if self.nulls_first else self.value.asc_nulls_last()
        return self.value.desc_nulls_first() if self.nulls_first else self.value.desc_nulls_last()


@dataclass(frozen=True)
class _Leaf:
    """A value without nulls that literals can be compared with."""

    value: Column
    ascending: bool
    kind: T.DataType


_NUMBERS = {T.TimestampNTZType: lambda c: F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), c), T.TimestampType: F.unix_micros, T.DateType: lambda c: F.unix_date(c).cast("long")}
_PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType)


def _leaves(key: Key, kind: T.DataType) -> list[_Leaf] | None:
    """What a key is compared by, one after the other; None where its type has no literals."""
    flag = _Leaf(key.value.isNull().cast("int"), not key.nulls_first, T.IntegerType())
    if isinstance(kind, T.StructType):
        out = [flag]
        for f in kind.fields:
            # inside a struct, nulls are the smallest
            inner = _leaves(Key(key.value[f.name], key.ascending, key.ascending), f.dataType)
            if inner is None:
                return None
            out += inner
        return out
    if type(kind) in _NUMBERS:
        return [flag, _Leaf(F.coalesce(_NUMBERS[type(kind)](key.value), F.lit(0)).cast("long"), key.ascending, T.LongType())]
    if isinstance(kind, _PLAIN):
        blank = F.lit(b"" if isinstance(kind, T.BinaryType) else "" if isinstance(kind, T.StringType) else False if isinstance(kind, T.BooleanType) else 0)
        return [flag, _Leaf(F.coalesce(key.value, blank.cast(kind)), key.ascending, kind)]
    return None


def _written(value: object) -> object:
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, float) and not isfinite(value):
        return {"inf": "Infinity", "-inf": "-Infinity"}.get(str(value), "NaN")
    return value if isinstance(value, (bool, int, float, str)) or value is None else str(value)


def _search(array: Column, n: int, after: Callable[[Column], Column]) -> Column:
    """How many of the first elements hold ``after``, which none does once one doesn't; by halving."""
    powers = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    if not n:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda low, step: F.when(after(F.get(array, low + step - 1)), low + step).otherwise(low))


class Ranges:
    """The ranges of one table under one order."""

    def __init__(self, keys: Sequence[Key], leaves: Sequence[_Leaf], bounds: Sequence[Sequence[object]]) -> None:
        self.keys, self.leaves, self.bounds = list(keys), list(leaves), list(bounds)
        self.starts: list[int] | None = None
        self.total = 0

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[Key], parts: int | None = None) -> Ranges:
        """Draws the sample: one pass over the key columns."""
        spark = df.sparkSession
        parts = parts or min(MOST, 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        leaves: list[_Leaf] = []
        kinds = df.select(*[k.value.alias(f"k{i}") for i, k in enumerate(keys)]).schema
        for key, field in zip(keys, kinds):
            own = _leaves(key, field.dataType)
            if own is None:
                break  # later keys still order rows inside a range
            leaves += own
        names = [f"l{i}" for i in range(len(leaves))]
        short = [F.substring(x.value, 1, PREFIX) if isinstance(x.kind, (T.StringType, T.BinaryType)) else x.value for x in leaves]
        drawn = df.select(*[c.alias(n) for c, n in zip(short, names)]).orderBy(F.rand(7)).limit(DRAWN * parts)
        rows = drawn.orderBy(*[F.col(n).asc() if x.ascending else F.col(n).desc() for n, x in zip(names, leaves)]).collect() if leaves and parts > 1 else []
        picked = [tuple(map(_written, rows[len(rows) * k // parts])) for k in range(1, parts)] if rows else []
        return cls(keys, leaves, list(dict.fromkeys(picked)))

    def part(self) -> Column:
        """The number of a row's range."""
        schema = T.ArrayType(T.StructType([T.StructField(f"l{i}", x.kind) for i, x in enumerate(self.leaves)]))
        rows = [{f"l{i}": v for i, v in enumerate(b)} for b in self.bounds]
        array = F.from_json(F.lit(json.dumps(rows)), schema) if rows else F.array()

        def after(bound: Column) -> Column:
            """Whether the row comes after a bound."""
            pairs = [(x.value, bound[f"l{i}"], x.ascending) for i, x in enumerate(self.leaves)]
            return reduce(lambda rest, p: F.when(p[0] == p[1], rest).otherwise((p[0] > p[1]) if p[2] else (p[0] < p[1])), reversed(pairs), F.lit(False))

        return _search(array, len(rows), after).cast("int")

    def mark(self, df: DataFrame) -> DataFrame:
        """``df`` with ``PART``; ranges are in order, and no row is in two."""
        return df.withColumn(PART, self.part())

    def sizes(self, df: DataFrame) -> list[int]:
        """The first position of each range; one pass over the key columns, once."""
        if self.starts is None:
            counted = {r[0]: r[1] for r in self.mark(df).groupBy(PART).count().collect()}
            self.starts = [0, *accumulate(counted.get(p, 0) for p in range(len(self.bounds)))]
            self.total = sum(counted.values())
        return self.starts

    def number(self, df: DataFrame, name: str, holding: Sequence[int] | None = None) -> DataFrame:
        """``df`` with the dense position and ``PART``: rows are numbered inside their range, after the ranges before.

        With ``holding``, only the ranges that hold these positions.
        """
        starts = F.from_json(F.lit(json.dumps(self.sizes(df))), "array<bigint>")
        local = F.row_number().over(Window.partitionBy(PART).orderBy(*[k.sort for k in self.keys]))
        marked = self.mark(df)
        if holding is not None:
            marked = marked.where(F.col(PART).isin([bisect_right(self.starts, p) - 1 for p in holding]))
        return marked.withColumn(name, (local - 1 + F.get(starts, F.col(PART))).cast("long"))

    def holding(self, position: Column) -> Column:
        """The range that holds a position; the last one for positions beyond the end."""
        starts = F.from_json(F.lit(json.dumps(self.starts[1:])), "array<bigint>")
        return _search(starts, len(self.starts) - 1, lambda start: start <= position).cast("int")


def with_position(df: DataFrame, order: Sequence[str | Column | Key], name: str = "__row", parts: int | None = None) -> DataFrame:
    """``df`` with each row's dense position in a total order."""
    keys = [o if isinstance(o, Key) else Key(F.col(o) if isinstance(o, str) else o) for o in order]
    return Ranges.of(df, keys, parts).number(df, name).drop(PART)

"""Date ranges, number ranges and random columns, made on the executors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import offset
from ..plans.freq import Rule, parse


def _start(start: date | datetime) -> datetime:
    return start if isinstance(start, datetime) else datetime(start.year, start.month, start.day)


def _nth(start: datetime, rule: Rule, k: Column) -> Column:
    first = F.lit(start).cast("timestamp_ntz")
    if rule.months is None:
        return F.timestamp_add("MICROSECOND", k * rule.micros, first)
    # steps count from the start, so a month's end isn't lost on the way
    months = (k * rule.months).cast("int")
    if rule.unit.endswith("S"):
        time = start - datetime(start.year, start.month, start.day)
        day = F.add_months(F.lit(start.date()), months).cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.lit(time // timedelta(microseconds=1)), day)
    base = start.month - 1 - (start.month - 1) % {"M": 1, "Q": 3, "Y": 12}[rule.unit] + {"M": 0, "Q": 2, "Y": 11}[rule.unit]
    return F.last_day(F.add_months(F.lit(date(start.year, base + 1, 1)), months)).cast("timestamp_ntz")


def date_range(spark: SparkSession, start: date | datetime, end: date | datetime | None = None, periods: int | None = None, freq: str | timedelta = "1D", tz: str | None = None) -> DataFrame:
    """(pos, ts): from start by steps to an inclusive end, or so many of them; the zone only names the times."""
    rule = parse(freq)
    first = _start(start)
    if (end is None) == (periods is None):
        raise ValueError("give an end or a number of periods")
    if periods is not None:
        if periods < 0:
            raise ValueError("periods can't be negative")
        return spark.range(periods).select(F.col("id").alias("pos"), _nth(first, rule, F.col("id")).alias("ts"))
    last = _start(end)
    if not first < last:
        raise ValueError("the start must come before the end")
    if rule.micros:
        most = (last - first) // timedelta(microseconds=rule.micros) + 1
    else:
        most = ((last.year - first.year) * 12 + last.month - first.month) // rule.months + 1
    steps = spark.range(most).select(F.col("id").alias("pos"), _nth(first, rule, F.col("id")).alias("ts"))
    return steps.where(F.col("ts") <= F.lit(last).cast("timestamp_ntz"))


def any_date_range(spark: SparkSession, start: date | datetime, periods: int, freq: str | None = None, tz: str | None = None) -> DataFrame:
    """By days from a date, by minutes from a time, unless told otherwise."""
    return date_range(spark, start, periods=periods, freq=freq or ("1T" if isinstance(start, datetime) else "1D"), tz=tz)


def number_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """start .. end-1."""
    return spark.range(start, end).select(F.col("id").alias("value"))


class RandomState:
    """Seeded random columns."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def rand(self, low: float = 0.0, high: float = 1.0) -> Column:
        return F.rand(self.seed) * (high - low) + low

    def randn(self, mean: float = 0.0, std: float = 1.0) -> Column:
        return F.randn(self.seed) * std + mean

    def randint(self, low: int, high: int) -> Column:
        """Both ends included."""
        return (F.floor(F.rand(self.seed) * (high - low + 1)) + low).cast("long")

    def choice(self, values: Sequence) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(self.seed) * len(values)) + 1).cast("int"))

    def frame(self, spark: SparkSession, size: int, **columns: Column) -> DataFrame:
        return spark.range(size).select(F.col("id").alias("pos"), *[c.alias(n) for n, c in columns.items()])


def shift_dates(ts: Column, rule: str, count: int = 1) -> Column:
    """A date plus (or minus) so many calendar offsets."""
    return offset(ts, rule, count)

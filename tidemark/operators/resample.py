"""Time buckets: fixed widths from an anchor, calendar periods, and downsampling to labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import IDX, POS, Frame
from ..functions import dates
from ..plans.freq import Rule, calendar_unit, parse
from .aggregate import Grouped

EPOCH = datetime(1970, 1, 1)


def _bounds(frame: Frame) -> tuple[datetime, datetime]:
    """First and last label: two values."""
    low, high = frame.df.agg(F.min(IDX), F.max(IDX)).first()
    return low, high


def anchor(frame: Frame, origin: str | datetime, offset: timedelta = timedelta(0)) -> datetime:
    """Where buckets are counted from: epoch, start, start_day, end, end_day or a time."""
    if isinstance(origin, datetime):
        return origin + offset
    if origin == "epoch":
        return EPOCH + offset
    low, high = _bounds(frame)
    if low is None:
        return EPOCH + offset
    midnight = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    return {"start": low, "start_day": midnight(low), "end": high, "end_day": midnight(high)}[origin] + offset


def bucket(ts: Column, rule: Rule, start: datetime, closed_right: bool = False, label_right: bool = False) -> Column:
    """The label of the bucket of fixed width that a time falls in; integer arithmetic only."""
    width = rule.micros
    o = (start - EPOCH) // timedelta(microseconds=1)
    t = dates.micros(ts) - o
    left = t + F.pmod(-t, F.lit(width)) - width if closed_right else t - F.pmod(t, F.lit(width))
    return dates.from_micros(left + o + (width if label_right else 0))


def calendar_bucket(ts: Column, rule: Rule, label_right: bool = True) -> Column:
    """The period of months that a time falls in: its last day, or its first."""
    unit, multiple = {1: ("month", rule.months), 3: ("quarter", rule.months // 3), 12: ("year", rule.months // 12)}[1 if rule.months % 3 else 3 if rule.months % 12 else 12]
    low = dates.floor(ts, multiple, unit)
    if not label_right:
        return low
    return F.timestamp_add("DAY", F.lit(-1), dates.ceil(ts, multiple, unit))


class Resampler(Grouped):
    """A frame grouped by bucket; only buckets with rows appear."""

    def __init__(self, frame: Frame, label: Column) -> None:
        super().__init__(Frame(frame.df.withColumn("__bucket", label)), "__bucket")
        self.columns = frame.columns

    def all_columns(self, how: str) -> DataFrame:
        return self.agg({c: (c, how) for c in self.columns})

    def ohlc(self, price: str, volume: str | None = None) -> DataFrame:
        """Bars: open, high, low, close, and the sum of volume; one shuffle."""
        out = {"open": (price, "first"), "high": (price, "max"), "low": (price, "min"), "close": (price, "last"), "n": (price, "count")}
        return self.agg(out | ({"volume": (volume, "sum")} if volume else {}))


def resample(frame: Frame, rule: str | timedelta, closed_right: bool = False, label_right: bool = False, origin: str | datetime = "start_day", offset: timedelta = timedelta(0), tz: str | None = None) -> Resampler:
    """Buckets of a rule; with a zone, buckets follow its wall clock and labels are wall clock times."""
    step = parse(rule)
    if tz:
        frame = Frame(frame.df.withColumn(IDX, F.from_utc_timestamp(F.col(IDX).cast("timestamp_ntz"), tz).cast("timestamp_ntz")))
    if step.months:
        return Resampler(frame, calendar_bucket(F.col(IDX), step, label_right or closed_right))
    return Resampler(frame, bucket(F.col(IDX), step, anchor(frame, origin, offset), closed_right, label_right))


def downsample_label(ts: Column, rule: str, closed_right: bool = True, week_starts_monday: bool = True, start_epoch: bool = True) -> Column:
    """The time rounded up (or down) to units; period ends are labelled by their last day."""
    n, unit = calendar_unit(rule)
    if unit == "week" and not week_starts_monday:
        ts = F.timestamp_add("DAY", F.lit(1), ts)
    calendar = start_epoch and unit not in ("week", "month", "quarter", "year")
    out = (dates.ceil if closed_right else dates.floor)(ts, n, unit, calendar_origin=calendar)
    if unit == "week" and not week_starts_monday:
        out = F.timestamp_add("DAY", F.lit(-1), out)
    ends = rule.endswith("E") or unit in ("week", "month", "quarter", "year")
    return F.timestamp_add("DAY", F.lit(-1), out) if ends else out


def downsample(frame: Frame, rule: str, closed_right: bool = True, week_starts_monday: bool = True, start_epoch: bool = True) -> Resampler:
    return Resampler(frame, downsample_label(F.col(IDX), rule, closed_right, week_starts_monday, start_epoch))


def upsample(frame: Frame, rule: str, columns: Sequence[str] | None = None) -> Frame:
    """A row for every step between the first and the last label; steps without a row are null."""
    step = parse(rule)
    low, high = _bounds(frame)
    spark = frame.df.sparkSession
    if low is None:
        return frame
    n = (high - low) // timedelta(microseconds=step.micros) + 1
    grid = spark.range(n).select(F.timestamp_add("MICROSECOND", F.col("id") * step.micros, F.lit(low).cast("timestamp_ntz")).alias("__label"))
    from .align import reindex

    return reindex(Frame(frame.df.select(IDX, POS, *(columns or frame.columns))), grid, "__label")


def bars(df: DataFrame, ts: str, value: str, order: Sequence[str], rule: str = "1H", names: Mapping[str, str] | None = None) -> DataFrame:
    """Event bars: per bucket first, largest, smallest, last, sum and count of a value."""
    frame = Frame.of(df, ts, order, keep=True)
    out = resample(frame, rule).agg({"open": (value, "first"), "high": (value, "max"), "low": (value, "min"), "close": (value, "last"), "total": (value, "sum"), "n": (value, "count")})
    return out.withColumnsRenamed({"key": "bucket"} | dict(names or {}))

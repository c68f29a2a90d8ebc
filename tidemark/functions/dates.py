"""Date and time functions on timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.freq import MONTHS as STEPS
from ..plans.freq import date_pattern

EPOCH = "timestamp_ntz'1970-01-01'"
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}
_LARGER = {"microsecond": "millisecond", "millisecond": "second", "second": "minute", "minute": "hour", "hour": "day", "day": "month"}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts.cast("timestamp_ntz"))


def from_micros(t: Column) -> Column:
    return F.timestamp_add("MICROSECOND", t, F.expr(EPOCH))


def _part(unit: str):
    return lambda ts: F.extract(F.lit(unit), ts).cast("long")


def year(ts: Column) -> Column:
    return F.year(ts).cast("long")


def quarter(ts: Column) -> Column:
    return F.quarter(ts).cast("long")


def month(ts: Column) -> Column:
    return F.month(ts).cast("long")


def day(ts: Column) -> Column:
    return F.dayofmonth(ts).cast("long")


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts).cast("long")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts).cast("long")


def hour(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def minute(ts: Column) -> Column:
    return F.minute(ts).cast("long")


def second(ts: Column) -> Column:
    return F.second(ts).cast("long")


def millisecond(ts: Column) -> Column:
    return F.floor(F.pmod(micros(ts), F.lit(1_000_000)) / 1000).cast("long")


def microsecond(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(1000)).cast("long")


def nanosecond(ts: Column) -> Column:
    """Timestamps hold microseconds."""
    return F.when(ts.isNotNull(), F.lit(0).cast("long"))


def subsecond(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(1_000_000)) / F.lit(1_000_000.0)


def iso_year(ts: Column) -> Column:
    return _part("YEAROFWEEK")(ts)


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts).cast("long")


def iso_day_of_week(ts: Column) -> Column:
    """Monday is 1."""
    return (F.weekday(ts) + 1).cast("long")


def _wednesday(ts: Column) -> Column:
    return F.date_add(ts, 4 - F.dayofweek(ts))


def us_year(ts: Column) -> Column:
    """Year of the Sunday-based epidemiological week."""
    return F.year(_wednesday(ts)).cast("long")


def us_week(ts: Column) -> Column:
    return (F.floor((F.dayofyear(_wednesday(ts)) - 1) / 7) + 1).cast("long")


def week(ts: Column, monday: bool = True, from_zero: bool = False, first_full: bool = False) -> Column:
    """Week number.

    Weeks begin on Monday or Sunday.  The first week is the first whole one, or
    the one that holds the year's fourth day.  Counted from zero, days before it
    are in week 0; else they are in the last week of the year before.
    """
    first_day = F.weekday(ts) if monday else F.dayofweek(ts) - 1
    start = F.date_sub(ts, first_day)  # of the own week
    decides = start if first_full else F.date_add(start, 3)
    own = F.floor((F.dayofyear(decides) - 1) / 7) + 1
    return (F.when(F.year(decides) < F.year(ts), F.lit(0)).otherwise(own) if from_zero else own).cast("long")


def is_leap_year(ts: Column) -> Column:
    y = F.year(ts)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def is_dst(ts: Column, zone: str | None) -> Column:
    """Whether the zone is off its standard offset at a wall clock time; a zone is needed."""
    if not zone:
        raise ValueError("is_dst needs a time zone")
    offset = lambda t: F.timestamp_diff("SECOND", F.to_utc_timestamp(t.cast("timestamp_ntz"), zone).cast("timestamp_ntz"), t.cast("timestamp_ntz"))
    standard = F.least(offset(F.make_timestamp_ntz(F.year(ts), F.lit(1), F.lit(1), F.lit(12), F.lit(0), F.lit(0))), offset(F.make_timestamp_ntz(F.year(ts), F.lit(7), F.lit(1), F.lit(12), F.lit(0), F.lit(0))))
    return offset(ts) != standard


# ------------------------------------------------------- boundaries crossed


def years_between(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)).cast("long")


def quarters_between(a: Column, b: Column) -> Column:
    number = lambda t: F.year(t) * 4 + F.quarter(t)
    return (number(b) - number(a)).cast("long")


def months_between(a: Column, b: Column) -> Column:
    number = lambda t: F.year(t) * 12 + F.month(t)
    return (number(b) - number(a)).cast("long")


def weeks_between(a: Column, b: Column) -> Column:
    return F.floor(F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("long")


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a).cast("long")


def units_between(a: Column, b: Column, unit: str) -> Column:
    """Boundaries of hours and smaller units; nanoseconds are microseconds times 1000."""
    if unit == "nanosecond":
        return (micros(b) - micros(a)) * 1000
    whole = lambda t: (micros(t) - F.pmod(micros(t), F.lit(UNITS[unit]))) / UNITS[unit]
    return F.round(whole(b) - whole(a)).cast("long")


def month_interval_between(a: Column, b: Column) -> Column:
    return F.make_ym_interval(F.lit(0), months_between(a, b).cast("int"))


def day_time_interval_between(a: Column, b: Column) -> Column:
    return b.cast("timestamp_ntz") - a.cast("timestamp_ntz")


def month_day_nano_interval_between(a: Column, b: Column) -> Column:
    """A struct of the differences of months, days of the month and time of day."""
    of_day = lambda t: F.pmod(micros(t), F.lit(UNITS["day"]))
    return F.struct(months_between(a, b).alias("months"), (F.dayofmonth(b) - F.dayofmonth(a)).cast("long").alias("days"), ((of_day(b) - of_day(a)) * 1000).alias("nanos"))


# ------------------------------------------------------------- round to units


def _month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def _of_month_number(n: Column) -> Column:
    return F.make_timestamp_ntz(F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def floor(ts: Column, multiple: int = 1, unit: str = "day", calendar_origin: bool = False) -> Column:
    """The last multiple of a unit: from the epoch, or from the next larger unit's start."""
    if unit in MONTHS:
        step = MONTHS[unit] * multiple
        n = _month_number(ts)
        origin = F.year(ts) * 12 if calendar_origin and unit != "year" else F.lit(1970 * 12)
        return _of_month_number(n - F.pmod(n - origin, F.lit(step)))
    if unit == "week":
        start = F.lit(-3 * UNITS["day"])  # the Monday before the epoch
        return from_micros(micros(ts) - F.pmod(micros(ts) - start, F.lit(UNITS["week"] * multiple)))
    f = UNITS[unit] * multiple
    if calendar_origin:
        base = micros(F.date_trunc(_LARGER[unit], ts).cast("timestamp_ntz"))
        t = micros(ts) - base
        return from_micros(base + t - F.pmod(t, F.lit(f)))
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(f)))


def ceil(ts: Column, multiple: int = 1, unit: str = "day", strictly: bool = False, calendar_origin: bool = False) -> Column:
    """The next multiple; an exact boundary stays, but for months and longer, which always move up."""
    low = floor(ts, multiple, unit, calendar_origin)
    if unit in MONTHS:
        return _of_month_number(_month_number(low) + MONTHS[unit] * multiple)
    up = from_micros(micros(low) + UNITS[unit] * multiple)
    return up if strictly else F.when(low == ts.cast("timestamp_ntz"), low).otherwise(up)


def round(ts: Column, multiple: int = 1, unit: str = "day", calendar_origin: bool = False) -> Column:  # noqa: A001
    """The nearer multiple; ties go up."""
    low, high = floor(ts, multiple, unit, calendar_origin), ceil(ts, multiple, unit, True, calendar_origin)
    return F.when(micros(ts) - micros(low) >= micros(high) - micros(ts), high).otherwise(low)


def strftime(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, date_pattern(pattern))


def strptime(x: Column, pattern: str, error_is_null: bool = False) -> Column:
    spark_pattern = F.lit(date_pattern(pattern))
    return (F.try_to_timestamp(x, spark_pattern) if error_is_null else F.to_timestamp_ntz(x, spark_pattern)).cast("timestamp_ntz")


def to_datetime(x: Column, pattern: str | None = None) -> Column:
    return x.cast("timestamp_ntz") if pattern is None else strptime(x, pattern)


def offset(ts: Column, rule: str, count: int = 1) -> Column:
    """A date moved by calendar steps: D, W; MS, QS, YS keep the day; M, Q, Y land on the period's last day."""
    if rule in ("D", "W", "WS"):
        return F.timestamp_add("DAY", F.lit(count * (1 if rule == "D" else 7)), ts.cast("timestamp_ntz"))
    moved = F.add_months(ts.cast("date"), count * STEPS[rule])
    if rule.endswith("S"):
        return moved.cast("timestamp_ntz")
    months = STEPS[rule]
    last_month = _month_number(moved) - F.pmod(_month_number(moved), F.lit(months)) + months - 1
    return F.last_day(_of_month_number(last_month)).cast("timestamp_ntz")


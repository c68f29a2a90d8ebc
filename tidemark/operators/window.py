"""Functions of the rows before: rolling, expanding, cumulative, shifted, weighted.

``by`` names entity columns; each entity is a sequence of its own.  Without it
the whole frame is one sequence, which is cut into the frame's ranges: a range
is scanned by one task, carries from range to range are one row per range, and
windows of bounded length take the rows just before a range as a halo.
``block`` sets about how many rows a range has; by default there are as many
ranges as the session has tasks for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..frame import IDX, POS, ROW, Frame
from ..functions import nulls
from ..order import PART

#: Rows that a shift sends along with a range; a longer shift is a join of positions.
HALO = 100_000

_RUNNING: dict[str, tuple[Callable, Callable]] = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least), "prod": (F.product, lambda a, b: a * b)}


def running(frame: Frame, specs: Mapping[str, tuple[Column, str]], by: Sequence[str], block: int | None = None) -> DataFrame:
    """The frame's DataFrame with name -> running aggregate of an expression, all in one pass; ``__row`` too."""
    specs = {**specs, ROW: (F.lit(1).cast("long"), "sum")}
    plain = frame.df.drop(ROW)
    if by:
        w = Window.partitionBy(*by).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
        out = plain.select("*", *[_RUNNING[how][0](x).over(w).alias(n) for n, (x, how) in specs.items()])
        return out.withColumn(ROW, F.col(ROW) - 1)
    rows = frame.parted(block).drop(ROW)
    totals = rows.groupBy(F.col(PART).alias("__b")).agg(*[_RUNNING[how][0](x).alias(f"__t{k}") for k, (x, how) in enumerate(specs.values())])
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carry = totals.select("__b", *[_RUNNING[how][0](f"__t{k}").over(upto).alias(f"__c{k}") for k, (_, how) in enumerate(specs.values())])
    w = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[_RUNNING[how][0](x).over(w).alias(f"__o{k}") for k, (x, how) in enumerate(specs.values())])
    joined = local.join(F.broadcast(carry), F.col(PART) == F.col("__b"))  # some thousand ranges at most
    out = []
    for k, (name, (_, how)) in enumerate(specs.items()):
        before, own = F.col(f"__c{k}"), F.col(f"__o{k}")
        out.append(F.when(before.isNull(), own).when(own.isNull(), before).otherwise(_RUNNING[how][1](before, own)).alias(name))
    return joined.select(*plain.columns, *out).withColumn(ROW, F.col(ROW) - 1)


def cumulative(frame: Frame, column: str, how: str, name: str | None = None, *, start: float | None = None, skip_nulls: bool = True, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """Running sum, product, max or min, after ``start``; a null stays null and, unless skipped, so does all after it."""
    name, x = name or column, F.col(f"`{column}`")
    rows = running(frame, {"__run": (x, how), "__broken": (x.isNull().cast("int"), "max")}, by, block)
    out = F.col("__run") if start is None else _RUNNING[how][1](F.lit(start), F.col("__run"))
    out = F.when(x.isNotNull() if skip_nulls else F.col("__broken") == 0, out)
    return Frame(rows.select(IDX, POS, *[c for c in frame.columns if c != name], out.alias(name)))


def ordered(frame: Frame, columns: Mapping[str, str], forward: bool, block: int | None = None) -> Frame:
    """Forward or backward fill of a whole frame.

    Backward fills scan in the opposite order: a frame that ends at the last
    row would be computed anew for every row.
    """
    rows = frame.parted(block)
    turn = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    w = Window.partitionBy(PART).orderBy(turn(POS)).rowsBetween(Window.unboundedPreceding, 0)
    v = Window.orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max_by if forward else F.min_by
    ends = rows.groupBy(F.col(PART).alias("__b")).agg(*[edge(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(POS))).alias(f"__e{k}") for k, c in enumerate(columns)])
    carry = ends.select("__b", *[F.last(f"__e{k}", True).over(v).alias(f"__c{k}") for k in range(len(columns))])
    filled = rows.select("*", *[F.last(f"`{c}`", True).over(w).alias(f"__f{k}") for k, c in enumerate(columns)]).join(F.broadcast(carry), F.col(PART) == F.col("__b"))
    return Frame(filled.select(IDX, POS, *[F.coalesce(f"__f{k}", f"__c{k}").alias(n) for k, n in enumerate(columns.values())]))


def _halo(frame: Frame, before: int, after: int, block: int | None) -> DataFrame:
    """The frame's rows at ``__home``, their own range, and again at every range whose windows reach them; with ``__row``."""
    ranges = frame.ranges(block)
    rows = ranges.number(frame.df.drop(ROW), ROW)
    first, last = (F.col(PART) if not n else ranges.holding(F.col(ROW) + m) for n, m in ((after, -after), (before, before)))
    return rows.withColumn("__home", F.explode(F.sequence(F.least(first, PART), F.greatest(last, PART))))


def _windowed(frame: Frame, expressions: Callable[[Window], Mapping[str, Column]], before: int, after: int, by: Sequence[str], block: int | None) -> DataFrame:
    """The frame with window expressions that look at most ``before`` rows back and ``after`` ahead; __n is the row's number from 1."""
    if by:
        w = Window.partitionBy(*by).orderBy(POS)
        rows = frame.df.withColumn("__n", F.row_number().over(w))
        return rows.select("*", *[e.alias(n) for n, e in expressions(w).items()])
    w = Window.partitionBy("__home").orderBy(ROW)
    out = _halo(frame, before, after, block).withColumn("__n", F.col(ROW) + 1).select("*", *[e.alias(n) for n, e in expressions(w).items()])
    return out.where(F.col("__home") == F.col(PART))


#: Aggregates that Spark computes over a frame of rows.
FAST = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "first": F.first, "last": F.last}


def rolling(frame: Frame, window: int, aggregates: Mapping[str, tuple[str, str]], *, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """name -> (column, aggregate) over the last ``window`` rows; the first full window is the first row."""

    def expressions(w) -> dict[str, Column]:
        span = w.rowsBetween(-(window - 1), 0)
        out = {}
        for name, (column, how) in aggregates.items():
            x = F.col(f"`{column}`")
            if how == "median":
                values = F.sort_array(F.collect_list(x).over(span))
                n = F.size(values)
                out[name] = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
            else:
                out[name] = FAST[how](x).over(span)
        return out

    rows = _windowed(frame, expressions, window - 1, 0, by, block)
    return Frame(rows.where(F.col("__n") >= window).select(IDX, POS, *by, *aggregates))


def rolling_apply(frame: Frame, window: int, function: Callable[[pd.DataFrame], float], name: str = "value", *, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """Any function of the last ``window`` rows of all columns, in Python, a block or entity at a time."""
    columns = [c for c in frame.columns if c not in by]
    if by:
        rows, keys = frame.df.withColumn(ROW, F.row_number().over(Window.partitionBy(*by).orderBy(POS))).withColumn("__own", F.lit(True)), list(by)
    else:
        rows, keys = _halo(frame, window - 1, 0, block).withColumn("__own", F.col("__home") == F.col(PART)), ["__home"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        pdf = table.select(columns).to_pandas()
        own = table["__own"].to_numpy()
        ends = [k for k in range(window - 1, len(pdf)) if own[k]]
        values = [float(function(pdf.iloc[k - window + 1 : k + 1])) for k in ends]
        return _with_value(table, kept, ends, name, values)

    kept = [IDX, POS, *by]
    return Frame(rows.groupBy(*keys).applyInArrow(run, _fields(frame, kept, name)))


def _fields(frame: Frame, kept: Sequence[str], name: str) -> T.StructType:
    """The frame's fields of these names, and a double."""
    return T.StructType([frame.df.schema[c] for c in kept] + [T.StructField(name, T.DoubleType())])


def _with_value(table: pa.Table, kept: Sequence[str], rows: Sequence[int] | None, name: str, values: object) -> pa.Table:
    """Columns of some rows, or all, with a new one; NaN is null."""
    some = table.select(list(kept))
    some = some if rows is None else some.take(pa.array(rows, pa.int64()))
    return some.append_column(name, pa.array(np.asarray(values, dtype=float), pa.float64(), from_pandas=True))


def expanding(frame: Frame, least: int, aggregates: Mapping[str, tuple[str, str]], *, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """name -> (column, aggregate) of all rows so far, from the ``least``-th row on; sum, mean, min, max and count."""
    specs: dict[str, tuple[Column, str]] = {}
    parts: dict[str, Column] = {}
    for name, (column, how) in aggregates.items():
        x = F.col(f"`{column}`")
        if how in ("mean", "count"):
            specs[f"__k_{name}"] = x.isNotNull().cast("long"), "sum"
        if how != "count":
            specs[f"__r_{name}"] = x, "sum" if how == "mean" else how
        parts[name] = F.col(f"__k_{name}") if how == "count" else F.try_divide(F.col(f"__r_{name}"), F.col(f"__k_{name}")) if how == "mean" else F.col(f"__r_{name}")
    rows = running(frame, specs, by, block)
    return Frame(rows.where(F.col(ROW) >= least - 1).select(IDX, POS, *by, *[e.alias(n) for n, e in parts.items()]))


def shift(frame: Frame, columns: Mapping[str, str], periods: int = 1, fill: object = None, *, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """column -> name: the value so many rows before (after, if negative)."""
    names = list(columns.values())
    kept = [c for c in frame.columns if c not in names]
    renamed = Frame(frame.df.withColumnsRenamed({n: f"__old_{n}" for n in names if n in frame.columns}))
    mapped = {(f"__old_{c}" if c in names and c in frame.columns else c): n for c, n in columns.items()}

    def moved(w) -> dict[str, Column]:
        move = F.lag if periods >= 0 else F.lead
        return {n: move(f"`{c}`", abs(periods), fill).over(w) for c, n in mapped.items()}

    if not by and abs(periods) > HALO:
        # a position meets the one so many rows before it
        rows = renamed.dense()
        there = rows.select((F.col(ROW) + periods).alias("__to"), F.lit(True).alias("__hit"), *[F.col(f"`{c}`").alias(f"__moved_{n}") for c, n in mapped.items()])
        joined = rows.join(there, F.col(ROW) == F.col("__to"), "left")
        values = [F.when(F.col("__hit"), F.col(f"__moved_{n}")).otherwise(F.lit(fill)).alias(n) for n in names]
        return Frame(joined.select(IDX, POS, *kept, *values))
    rows = _windowed(renamed, moved, max(periods, 0), max(-periods, 0), by, block)
    return Frame(rows.select(IDX, POS, *kept, *names))


def pct_change(frame: Frame, column: str, periods: int = 1, name: str = "pct_change", *, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """The relative change over so many rows, in IEEE arithmetic: after a zero it is infinite, or NaN for another zero."""
    moved = shift(frame, {column: "__before"}, periods, by=by, block=block)
    x, before = F.col(f"`{column}`").cast("double"), F.col("__before").cast("double")
    return Frame(moved.df.withColumn(name, nulls.divide(x, before) - 1).drop("__before"))


def ewm_alpha(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    """The smoothing factor, of exactly one of four forms."""
    if sum(v is not None for v in (com, span, halflife, alpha)) != 1:
        raise ValueError("give one of com, span, halflife and alpha")
    if com is not None and com >= 0:
        return 1 / (1 + com)
    if span is not None and span >= 1:
        return 2 / (span + 1)
    if halflife is not None and halflife > 0:
        return 1 - 0.5 ** (1 / halflife)
    if alpha is not None and 0 < alpha <= 1:
        return alpha
    raise ValueError("out of range")


class Weighted:
    """The exponentially weighted recursion over the values of a sequence, as affine steps.

    A value v after g rows (or values, if nulls are ignored) since the last one
    turns a weighted sum y into f y + c v.  Adjusted, f is the decay to the
    power g and c is 1; else the two are normalised to add up to 1.  Products of
    f and sums of c are computed by numpy in runs over which f's product stays
    a normal number; the variance and ``pairs`` add up terms of one sign, so
    nothing cancels.  A state is (weight, mean, variance, pairs, rows since the
    last value, values seen); pairs are the squared weight less the squares of
    the values' weights.
    """

    EMPTY = (0.0, 0.0, 0.0, 0.0, 0, 0)

    def __init__(self, alpha: float, adjust: bool, ignore_na: bool) -> None:
        self.alpha, self.adjust, self.ignore_na = alpha, adjust, ignore_na
        self.log = np.log(max(1 - alpha, 1e-300))

    def _steps(self, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log f, c) of each value."""
        log = self.log * gaps
        if self.adjust:
            return log, np.ones(len(gaps))
        total = np.logaddexp(log, np.log(self.alpha))
        return log - total, self.alpha / np.exp(total)

    def _values(self, x: np.ndarray, since: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places of values, rows since the last value of each, rows after the last)."""
        at = np.flatnonzero(~np.isnan(x))
        if self.ignore_na:
            return at, np.ones(len(at)), 0
        return at, np.diff(at, prepend=-1 - since).astype(float), int(len(x) - 1 - at[-1]) if len(at) else since + len(x)

    def _start(self, state: tuple, v: float, gap: float) -> tuple[float, float, float, float]:
        """(weight, mean, variance, pairs) after one more value."""
        weight, mean, var, pairs, _, seen = state
        if not seen:
            return 1.0, v, 0.0, 0.0
        log, c = self._steps(np.array([gap]))
        f, c = float(np.exp(log[0])), float(c[0])
        old = weight * f if self.adjust else f
        total = old + c
        return total if self.adjust else 1.0, mean + c / total * (v - mean), (old * var + old * c / total * (v - mean) ** 2) / total, pairs * f * f + 2 * old * c

    def scan(self, x: np.ndarray, state: tuple = EMPTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mean, biased variance, unbiasing factor, values seen) after each row; NaN before the first value."""
        at, gaps, _ = self._values(x, state[4])
        k, n = 0, len(at)
        means, variances, factors = np.empty(n), np.empty(n), np.empty(n)
        weight, mean, var, pairs = state[:4]

        def put(m: int, w: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> None:
            means[k : k + m], variances[k : k + m] = a, b
            with np.errstate(divide="ignore", invalid="ignore"):
                factors[k : k + m] = np.where(p > 0, w * w / p, np.nan)

        if n:
            weight, mean, var, pairs = self._start(state, float(x[at[0]]), float(gaps[0]))
            put(1, *(np.array([z]) for z in (weight, mean, var, pairs)))
            k = 1
        log, c = self._steps(gaps)
        while k < n:
            reach = np.cumsum(log[k : k + 4096])
            m = int(np.searchsorted(-reach, 200.0))  # exp(-200) and its square are normal numbers
            if not m:
                weight, mean, var, pairs = self._start((weight, mean, var, pairs, 0, 1), float(x[at[k]]), float(gaps[k]))
                put(1, *(np.array([z]) for z in (weight, mean, var, pairs)))
                k += 1
                continue
            f, step, own, v = np.exp(reach[:m]), np.exp(log[k : k + m]), c[k : k + m], x[at[k : k + m]] - mean
            w = f * (weight + np.cumsum(own / f)) if self.adjust else np.ones(m)
            shifted = f * np.cumsum(own * v / f) / w
            old = step * np.concatenate([[weight], w[:-1]])
            spread = old * own / w * (v - np.concatenate([[0.0], shifted[:-1]])) ** 2
            b = f * (weight * var + np.cumsum(spread / f)) / w
            p = f * f * (pairs + np.cumsum(2 * old * own / (f * f)))
            put(m, w, mean + shifted, b, p)
            weight, mean, var, pairs = float(w[-1]), float(mean + shifted[-1]), float(b[-1]), float(p[-1])
            k += m
        number = np.cumsum(~np.isnan(x)) - 1
        held = (state[1], state[2], state[0] * state[0] / state[3] if state[3] > 0 else np.nan) if state[5] else (np.nan,) * 3
        return *(np.concatenate([[h], z])[number + 1] for h, z in zip(held, (means, variances, factors))), number + 1 + state[5]

    def summary(self, x: np.ndarray) -> tuple:
        """What a range does to any state: (rows, values, rows up to the first value, that value, product of f,
        weight, mean, variance and pairs of the values after it, rows after the last)."""
        at, gaps, after = self._values(x, 0)
        if not len(at):
            return len(x), 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, after
        v = x[at[1:]]
        log, c = self._steps(gaps[1:])
        total = np.cumsum(log)
        end = total[-1] if len(v) else 0.0
        w = c * np.exp(end - total)
        weight = w.sum()
        mean = (w * v).sum() / weight if len(v) else 0.0
        var = (w * (v - mean) ** 2).sum() / weight if len(v) else 0.0
        pairs = 2 * (w[1:] * np.cumsum(w)[:-1]).sum()
        return len(x), len(at), float(gaps[0]), float(x[at[0]]), float(np.exp(end)), weight, mean, var, pairs, after

    def after(self, state: tuple, summary: tuple) -> tuple:
        """The state behind a range."""
        rows, values, gap, first, f, w, mean, var, pairs, after = summary
        if not values:
            return (*state[:4], 0 if self.ignore_na else state[4] + int(rows), state[5])
        a, m, s, p = self._start(state, first, gap + (0 if self.ignore_na else state[4]))
        a, p = a * f, p * f * f
        total = a + w
        mixed = (a * m + w * mean) / total
        spread = (a * s + w * var + a * w / total * (m - mean) ** 2) / total
        return total if self.adjust else 1.0, mixed, spread, p + pairs + 2 * a * w, int(after), state[5] + int(values)


def ewm_mean(x: np.ndarray, alpha: float, adjust: bool, ignore_na: bool, min_periods: int) -> np.ndarray:
    """The exponentially weighted mean of one sequence; NaN stands for null."""
    mean, _, _, seen = Weighted(alpha, adjust, ignore_na).scan(x)
    return np.where(seen >= max(min_periods, 1), mean, np.nan)


def ewm_var(x: np.ndarray, alpha: float, adjust: bool, ignore_na: bool, min_periods: int, bias: bool) -> np.ndarray:
    """The exponentially weighted variance of one sequence."""
    _, var, factor, seen = Weighted(alpha, adjust, ignore_na).scan(x)
    return np.where(seen >= max(min_periods, 1), var if bias else var * factor, np.nan)


def ewm(frame: Frame, column: str, how: str = "mean", name: str = "ewm", *, com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None, adjust: bool = True, ignore_na: bool = False, min_periods: int = 0, bias: bool = False, by: Sequence[str] = (), block: int | None = None) -> Frame:
    """Exponentially weighted mean, var or std, in Arrow batches.

    The recursion is a chain of affine steps, so ranges of a sequence compose:
    each is summed up, the summaries (a row per range) are chained, and each is
    then scanned from the state before it.  With ``by`` an entity is one scan.
    """
    scan = Weighted(ewm_alpha(com, span, halflife, alpha), adjust, ignore_na)
    kept = [IDX, POS, *by]

    def values(x: np.ndarray, state: tuple) -> np.ndarray:
        mean, var, factor, seen = scan.scan(x, state)
        out = mean if how == "mean" else var if bias else var * factor
        return np.where(seen >= max(min_periods, 1), np.sqrt(out) if how == "std" else out, np.nan)

    def numbers(table: pa.Table) -> np.ndarray:
        return table["__x"].to_numpy().astype(float)

    source = frame.parted(block) if not by else frame.df
    source = source.select(*kept, *([] if by else [PART]), F.col(f"`{column}`").cast("double").alias("__x"))
    fields = _fields(frame, kept, name)
    if by:
        # Arrow doesn't order by structs, so rows are numbered first
        numbered = source.withColumn(ROW, F.row_number().over(Window.partitionBy(*by).orderBy(POS)))

        def entity(table: pa.Table) -> pa.Table:
            table = table.sort_by(ROW)
            return _with_value(table, kept, None, name, values(numbers(table), Weighted.EMPTY))

        return Frame(numbered.groupBy(*by).applyInArrow(entity, fields))
    numbered = source.withColumn(ROW, F.row_number().over(Window.partitionBy(PART).orderBy(POS)))

    def sum_up(table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        return pa.table({PART: table[PART][:1], "s": pa.array([list(map(float, scan.summary(numbers(table))))], pa.list_(pa.float64()))})

    def chain(table: pa.Table) -> pa.Table:
        table, state, states = table.sort_by(PART), Weighted.EMPTY, []
        for s in table["s"].to_pylist():
            states.append(list(map(float, state)))
            state = scan.after(state, tuple(s))
        return pa.table({PART: table[PART], "state": pa.array(states, pa.list_(pa.float64()))})

    sums = numbered.groupBy(PART).applyInArrow(sum_up, f"{PART} int, s array<double>")
    states = sums.groupBy(F.lit(0).alias("one")).applyInArrow(chain, f"{PART} int, state array<double>")  # a row per range

    def part(table: pa.Table, before: pa.Table) -> pa.Table:
        table, state = table.sort_by(ROW), before["state"][0].as_py()
        return _with_value(table, kept, None, name, values(numbers(table), (*state[:4], int(state[4]), int(state[5]))))

    return Frame(numbered.groupBy(PART).cogroup(states.groupBy(PART)).applyInArrow(part, fields))


def visit(frame: Frame, visitor: Callable[[], object], columns: Sequence[str], *, by: Sequence[str], name: str = "value", reverse: bool = False) -> Frame:
    """A stateful visitor (pre, step(label, *values), post) along each entity; step's results are the column."""
    order = Window.partitionBy(*by).orderBy(F.col(POS).desc() if reverse else F.col(POS).asc())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        state = visitor()
        state.pre()
        out = [state.step(*row) for row in table.select([IDX, *columns]).to_pandas().itertuples(index=False)]
        state.post()
        return _with_value(table, kept, None, name, out)

    kept = [IDX, POS, *by]
    numbered = frame.df.withColumn(ROW, F.row_number().over(order))
    return Frame(numbered.groupBy(*by).applyInArrow(run, _fields(frame, kept, name)))

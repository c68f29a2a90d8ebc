"""Rolling, expanding, cumulative, shifted and weighted windows (survey rows W)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..frame import IDX, Frame
from ..operators import window as w
from .base import EV, event_frame, query
from .base import rounded as near

c = F.col


def numbered(spark, sf_dir, *columns: str) -> Frame:
    return event_frame(spark, sf_dir, *columns, index="event_id")


def _over(rows: str, by: str = "") -> str:
    return f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY event_id ROWS BETWEEN {rows})"


FIVE = "4 PRECEDING AND CURRENT ROW"
AGGS = {"total": ("v", "sum"), "mean": ("v", "mean"), "high": ("v", "max"), "low": ("v", "min"), "n": ("v", "count"), "std": ("v", "std")}
ROUND = {"total": 4, "mean": 6, "std": 5}


def rounded(f: Frame, *keep: str):
    return f.df.select(c(IDX).alias("index"), *keep, *[F.round(k, ROUND[k]).alias(k) if k in ROUND else c(k) for k in AGGS])


def _sql(over: str, number: str, extra: str = "") -> str:
    return f"SELECT event_id AS \"index\"{extra}, round(total, 4) AS total, round(mean, 6) AS mean, high, low, n, round(std, 5) AS std FROM (SELECT *, sum(v) {over} AS total, avg(v) {over} AS mean, max(v) {over} AS high, min(v) {over} AS low, count(v) {over} AS n, stddev_samp(v) {over} AS std, {number} AS r FROM {EV}) WHERE r >= 5"


@query("w01_rolling", _sql(_over(FIVE), "row_number() OVER (ORDER BY event_id)"))
def w01(spark, sf_dir):
    return rounded(w.rolling(numbered(spark, sf_dir, "v"), 5, AGGS, block=2000))


@query("w01_rolling_by_entity", _sql(_over(FIVE, "user_id"), "row_number() OVER (PARTITION BY user_id ORDER BY event_id)", ", user_id"))
def w01_by(spark, sf_dir):
    return rounded(w.rolling(numbered(spark, sf_dir, "v", "user_id"), 5, AGGS, by=["user_id"]), "user_id")


@query("w01_rolling_median", f"SELECT event_id AS \"index\", m FROM (SELECT event_id, round(median(value) {_over(FIVE)}, 6) AS m, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r >= 5")
def w01_median(spark, sf_dir):
    out = w.rolling(numbered(spark, sf_dir, "value"), 5, {"m": ("value", "median")}, block=3000)
    return out.df.select(c(IDX).alias("index"), F.round("m", 6).alias("m"))


@query("w01_rolling_function", f"SELECT event_id AS \"index\", y FROM (SELECT event_id, round(max(value) {_over(FIVE)} - min(value) {_over(FIVE)} + sum(user_id) {_over(FIVE)}, 4) AS y, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r >= 5")
def w01_function(spark, sf_dir):
    out = w.rolling_apply(numbered(spark, sf_dir, "value", "user_id"), 5, lambda p: np.ptp(p["value"].to_numpy()) + p["user_id"].sum(), "y", block=1500)
    return out.df.select(c(IDX).alias("index"), F.round("y", 4).alias("y"))


@query("w02_expanding", "SELECT event_id AS \"index\", round(total, 3) AS total, round(mean, 8) AS mean, high, n FROM (SELECT event_id, sum(v) OVER w AS total, avg(v) OVER w AS mean, max(v) OVER w AS high, count(v) OVER w AS n, row_number() OVER (ORDER BY event_id) AS r FROM " + EV + " WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE r >= 3")
def w02(spark, sf_dir):
    out = w.expanding(numbered(spark, sf_dir, "v"), 3, {"total": ("v", "sum"), "mean": ("v", "mean"), "high": ("v", "max"), "n": ("v", "count")}, block=2500)
    return out.df.select(c(IDX).alias("index"), F.round("total", 3).alias("total"), F.round("mean", 8).alias("mean"), "high", "n")


PRIOR = "UNBOUNDED PRECEDING AND CURRENT ROW"


@query("w03_cumsum", f"SELECT event_id AS \"index\", CASE WHEN v IS NOT NULL THEN round(100 + sum(v) {_over(PRIOR)}, 3) END AS v, CASE WHEN count(*) {_over(PRIOR)} = count(v) {_over(PRIOR)} THEN v END AS strict FROM {EV}")
def w03(spark, sf_dir):
    f = numbered(spark, sf_dir, "v")
    strict = w.cumulative(f, "v", "sum", "strict", skip_nulls=False, block=4000)
    out = w.cumulative(f, "v", "sum", start=100.0, block=3000)
    joined = out.df.join(strict.df.select(IDX, c("strict").isNotNull().alias("s"), c("v").alias("x")), IDX)
    return joined.select(c(IDX).alias("index"), F.round("v", 3).alias("v"), F.when(c("s"), c("x")).alias("strict"))


@query("w04_cumprod", f"SELECT event_id AS \"index\", round(p, 8) AS p FROM (SELECT event_id, product(1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * user_id / 100000.0) {_over(PRIOR)} AS p FROM events)")
def w04(spark, sf_dir):
    f = numbered(spark, sf_dir, "user_id").add_column("x", F.expr(f"1 + CASE WHEN {IDX} % 2 = 0 THEN 1 ELSE -1 END * user_id / 100000.0D"))
    return w.cumulative(f, "x", "prod", "p", block=2000).df.select(c(IDX).alias("index"), F.round("p", 8).alias("p"))


@query("w05_cummax_cummin", f"SELECT event_id AS \"index\", CASE WHEN v IS NOT NULL THEN greatest(50.0, max(v) {_over(PRIOR)}) END AS high, CASE WHEN v IS NOT NULL THEN min(v) {_over(PRIOR)} END AS low FROM {EV}")
def w05(spark, sf_dir):
    f = numbered(spark, sf_dir, "v")
    high = w.cumulative(f, "v", "max", "high", start=50.0, block=2000)
    low = w.cumulative(f, "v", "min", "low", block=2000)
    return high.df.join(low.df.select(IDX, "low"), IDX).select(c(IDX).alias("index"), "high", "low")


@query("w03_cumsum_by_entity", f"SELECT event_id AS \"index\", user_id, CASE WHEN v IS NOT NULL THEN round(sum(v) {_over(PRIOR, 'user_id')}, 3) END AS v FROM {EV}")
def w03_by(spark, sf_dir):
    out = w.cumulative(numbered(spark, sf_dir, "v", "user_id"), "v", "sum", by=["user_id"])
    return out.df.select(c(IDX).alias("index"), "user_id", F.round("v", 3).alias("v"))


@query("w06_shift", f"SELECT event_id AS \"index\", lag(v, 3) OVER (ORDER BY event_id) AS a, lead(v, 2, -1.0) OVER (ORDER BY event_id) AS b FROM {EV}")
def w06(spark, sf_dir):
    f = numbered(spark, sf_dir, "v")
    a = w.shift(f, {"v": "a"}, 3, block=1000)
    b = w.shift(f, {"v": "b"}, -2, -1.0, block=1000)
    return a.df.join(b.df.select(IDX, "b"), IDX).select(c(IDX).alias("index"), "a", "b")


@query("w07_pct_change", "SELECT event_id AS \"index\", round(value / lag(value, 2) OVER (ORDER BY event_id) - 1, 8) AS y FROM events")
def w07(spark, sf_dir):
    out = w.pct_change(numbered(spark, sf_dir, "value"), "value", 2, "y", block=1000)
    return out.df.select(c(IDX).alias("index"), near("y", 8).alias("y"))


# the adjusted mean is a ratio of weighted sums, so SQL has it in closed form per entity
_W = "SELECT a.event_id, a.user_id, sum(b.value * pow(0.75, a.r - b.r)) / sum(pow(0.75, a.r - b.r)) AS y FROM r a JOIN r b ON a.user_id = b.user_id AND b.r <= a.r GROUP BY 1, 2"


@query("w08_w09_ewm_mean", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT event_id AS \"index\", user_id, round(y, 6) AS y FROM ({_W})")
def w08(spark, sf_dir):
    out = w.ewm(numbered(spark, sf_dir, "value", "user_id"), "value", "mean", "y", com=3.0, by=["user_id"])
    return out.df.select(c(IDX).alias("index"), "user_id", F.round("y", 6).alias("y"))


_VAR = "SELECT a.event_id, a.user_id, sum(pow(0.5, a.r - b.r)) AS s, sum(pow(0.25, a.r - b.r)) AS s2, sum(b.value * pow(0.5, a.r - b.r)) AS x, sum(b.value * b.value * pow(0.5, a.r - b.r)) AS xx FROM r a JOIN r b ON a.user_id = b.user_id AND b.r <= a.r GROUP BY 1, 2"


@query("w10_ewm_var_std", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), t AS ({_VAR}), v AS (SELECT event_id, user_id, CASE WHEN s * s - s2 > 1e-9 THEN s * s / (s * s - s2) * (xx / s - (x / s) * (x / s)) END AS y FROM t) SELECT event_id AS \"index\", user_id, round(y, 5) AS var, round(sqrt(y), 5) AS std FROM v")
def w10(spark, sf_dir):
    f = numbered(spark, sf_dir, "value", "user_id")
    var = w.ewm(f, "value", "var", "var", alpha=0.5, by=["user_id"])
    std = w.ewm(f, "value", "std", "std", span=3.0, by=["user_id"])
    return var.df.join(std.df.select(IDX, "std"), IDX).select(c(IDX).alias("index"), "user_id", near("var", 5).alias("var"), near("std", 5).alias("std"))


class Streak:
    """Counts rows since the value last fell."""

    def pre(self) -> None:
        self.last, self.n = None, 0

    def step(self, label: object, value: float) -> float:
        self.n = self.n + 1 if self.last is not None and value >= self.last else 0
        self.last = value
        return float(self.n)

    def post(self) -> None:
        self.last = None


@query("w11_w12_visitors", "WITH r AS (SELECT *, CASE WHEN value >= lag(value) OVER u THEN 0 ELSE 1 END AS f, row_number() OVER u AS r FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id AS \"index\", user_id, CAST(r - max(CASE WHEN f = 1 THEN r END) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS value FROM r")
def w11(spark, sf_dir):
    return w.visit(numbered(spark, sf_dir, "value", "user_id"), Streak, ["value"], by=["user_id"]).df.select(c(IDX).alias("index"), "user_id", "value")

"""Date ranges, resampling and bars (survey rows S21-S28, R)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ..frame import IDX, Frame
from ..operators import resample as r
from ..session import scratch
from ..sources import ranges as g
from ..streaming.bars import run_once, streaming_bars
from .base import EV, event_frame, query, table

c = F.col
BARS = "arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, round(sum(value), 4) AS total, count(value) AS n"


@query("bars_hourly", f"SELECT time_bucket(INTERVAL 1 HOUR, ts, (SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP) AS bucket, {BARS} FROM events GROUP BY 1")
def bars_hourly(spark, sf_dir):
    return r.bars(table(spark, sf_dir, "events"), "ts", "value", ["ts", "event_id"]).withColumn("total", F.round("total", 4))


@query("r10_ohlc", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS key, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(value) AS n, CAST(sum(user_id) AS BIGINT) AS volume FROM events GROUP BY 1")
def r10_ohlc(spark, sf_dir):
    return r.resample(event_frame(spark, sf_dir, "value", "user_id"), timedelta(days=1)).ohlc("value", "user_id")


EDGE = "2024-01-01"
for _closed in (False, True):
    for _label in (False, True):
        _t, _w = "epoch_us(ts)", 900_000_000
        _left = f"(({_t} - 1) // {_w}) * {_w}" if _closed else f"({_t} // {_w}) * {_w}"

        @query(f"r02_closed_{'right' if _closed else 'left'}_label_{'right' if _label else 'left'}", f"SELECT make_timestamp({_left} + {_w if _label else 0}) AS key, round(sum(v), 4) AS total, count(*) AS n FROM (SELECT date_trunc('minute', ts) AS ts, v, user_id FROM {EV}) GROUP BY 1")
        def r02(spark, sf_dir, closed=_closed, label=_label):
            f = event_frame(spark, sf_dir, "v", "user_id")
            f = Frame(f.df.withColumn(IDX, F.date_trunc("minute", IDX).cast("timestamp_ntz")))
            return r.resample(f, "15T", closed, label).agg({"total": ("v", "sum"), "n": ("user_id", "count")}).withColumn("total", F.round("total", 4))


for _origin, _sql in {"start": "(SELECT min(ts) FROM events)", "end": "(SELECT max(ts) FROM events)", "end_day": "(SELECT date_trunc('day', max(ts)) FROM events)::TIMESTAMP", "epoch": "TIMESTAMP '1970-01-01'"}.items():

    @query(f"r04_origin_{_origin}", f"SELECT make_timestamp(epoch_us({_sql}) + CAST(floor((epoch_us(ts) - epoch_us({_sql})) / 25200000000.0) AS BIGINT) * 25200000000) AS key, count(*) AS n FROM events GROUP BY 1")
    def r04(spark, sf_dir, origin=_origin):
        return r.resample(event_frame(spark, sf_dir, "value"), "7H", origin=origin).agg({"n": ("value", "count")})


@query("r04_origin_custom_with_offset", "SELECT make_timestamp(1704074400000000 + CAST(floor((epoch_us(ts) - 1704074400000000) / 25200000000.0) AS BIGINT) * 25200000000) AS key, count(*) AS n FROM events GROUP BY 1")
def r04_custom(spark, sf_dir):
    return r.resample(event_frame(spark, sf_dir, "value"), "7H", origin=datetime(2024, 1, 1), offset=timedelta(hours=2)).agg({"n": ("value", "count")})


@query("r04_zone", "SELECT time_bucket(INTERVAL 1 DAY, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS key, count(*) AS n FROM events GROUP BY 1")
def r04_zone(spark, sf_dir):
    return r.resample(event_frame(spark, sf_dir, "value"), "1D", tz="America/New_York").agg({"n": ("value", "count")})


@query("r03_r06_calendar_months", "SELECT CAST(last_day(o_orderdate) AS TIMESTAMP) AS key, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def r03(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), "o_orderdate", ["o_orderkey"])
    return r.resample(f, "M", closed_right=True).agg({"total": ("o_totalprice", "sum")}).withColumn("total", F.round("total", 2))


@query("r07_upsample", "SELECT g.ts AS \"index\", total FROM (SELECT unnest(generate_series((SELECT min(CAST(date_trunc('hour', ts) AS TIMESTAMP)) FROM events), (SELECT max(CAST(date_trunc('hour', ts) AS TIMESTAMP)) FROM events), INTERVAL 30 MINUTE)) AS ts) g LEFT JOIN (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, round(sum(value), 4) AS total FROM events GROUP BY 1) USING (ts)")
def r07(spark, sf_dir):
    hourly = r.resample(event_frame(spark, sf_dir, "value"), "1H").agg({"total": ("value", "sum")}).withColumn("total", F.round("total", 4))
    return r.upsample(Frame.of(hourly, "key"), "30T").to_df()


O = "o_orderdate"
for _rule, _sql in {"M": f"CAST(last_day({O}) AS TIMESTAMP)", "Q": f"CAST(date_trunc('quarter', {O}) AS TIMESTAMP) + INTERVAL 3 MONTH - INTERVAL 1 DAY", "Y": f"CAST(date_trunc('year', {O}) AS TIMESTAMP) + INTERVAL 12 MONTH - INTERVAL 1 DAY", "W": f"CASE WHEN isodow({O}) = 1 THEN {O} ELSE CAST(date_trunc('week', {O}) AS TIMESTAMP) + INTERVAL 7 DAY END - INTERVAL 1 DAY", "D": O}.items():

    @query(f"r09_downsample_{_rule}", f"SELECT {_sql} AS key, round(avg(o_totalprice), 6) AS mean, count(*) AS n FROM orders GROUP BY 1")
    def r09(spark, sf_dir, rule=_rule):
        f = Frame.of(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), "o_orderdate", ["o_orderkey"])
        out = r.downsample(f, rule).agg({"mean": ("o_totalprice", "mean"), "n": ("o_totalprice", "count")})
        return out.withColumn("mean", F.round("mean", 6))


@query("r09_downsample_hours", "SELECT CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS key, count(*) AS n FROM events GROUP BY 1")
def r09_hours(spark, sf_dir):
    return r.downsample(event_frame(spark, sf_dir, "value"), "1H").agg({"n": ("value", "count")})


@query("r10_all_aggregates", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS key, round(avg(v), 4) AS mean, round(median(v), 4) AS median, count(v) AS count, count(DISTINCT user_id) AS users, max(v) AS high, min(v) AS low, round(sum(v), 2) AS total, round(stddev_pop(v), 4) AS std, round(var_pop(v), 2) AS var, bool_or(v > 480) AS any, bool_and(user_id > 0) AS every FROM {EV} GROUP BY 1")
def r10(spark, sf_dir):
    f = event_frame(spark, sf_dir, "v", "user_id")
    f = Frame(f.df.withColumn("big", c("v") > 480).withColumn("pos", c("user_id") > 0))
    out = r.resample(f, "1D").agg({"mean": ("v", "mean"), "median": ("v", "median"), "count": ("v", "count"), "users": ("user_id", "nunique"), "high": ("v", "max"), "low": ("v", "min"), "total": ("v", "sum"), "std": ("v", "std"), "var": ("v", "var"), "any": ("big", "any"), "every": ("pos", "all")})
    return out.withColumns({k: F.round(k, n) for k, n in (("mean", 4), ("median", 4), ("total", 2), ("std", 4), ("var", 2))})


@query("r11_apply", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS key, round(sum(v) + 5, 2) AS value FROM {EV} GROUP BY 1")
def r11(spark, sf_dir):
    return r.resample(event_frame(spark, sf_dir, "v"), "1D").apply_scalar(lambda p: float(p["v"].sum() + 5)).select("key", F.round("value", 2).alias("value"))


# ------------------------------------------------------------------- ranges


@query("s21_date_range", "SELECT i AS pos, TIMESTAMP '2022-01-01' + INTERVAL (i) DAY AS ts FROM range(0, 59) t(i)")
def s21(spark, sf_dir):
    return g.date_range(spark, date(2022, 1, 1), date(2022, 2, 28))


@query("s22_date_range_periods", "SELECT i AS pos, DATE '2022-01-31' + INTERVAL (i) MONTH AS ms, CAST(last_day(DATE '2022-01-31' + INTERVAL (i) MONTH) AS TIMESTAMP) AS m, TIMESTAMP '2022-01-31' + INTERVAL (7 * i) DAY AS w, DATE '2022-01-31' + INTERVAL (3 * i) MONTH AS qs, CAST(last_day(DATE '2022-03-01' + INTERVAL (3 * i) MONTH) AS TIMESTAMP) AS q, make_timestamp(2022 + i, 12, 31, 0, 0, 0.0) AS y FROM range(0, 20) t(i)")
def s22(spark, sf_dir):
    out = None
    for name, freq in (("ms", "MS"), ("m", "M"), ("w", "WS"), ("qs", "QS"), ("q", "Q"), ("y", "Y")):
        part = g.date_range(spark, date(2022, 1, 31), periods=20, freq=freq).withColumnRenamed("ts", name)
        out = part if out is None else out.join(part, "pos")
    return out


@query("s23_time_range", "SELECT i AS pos, TIMESTAMP '2022-01-01 10:00:00' + INTERVAL (90 * i) MINUTE AS ts FROM range(0, 9) t(i)")
def s23(spark, sf_dir):
    return g.date_range(spark, datetime(2022, 1, 1, 10), datetime(2022, 1, 1, 22, 29), freq="90T", tz="UTC")


@query("s24_s25_time_range_periods", "SELECT i AS pos, TIMESTAMP '2022-01-01 10:00:00' + INTERVAL (i) MINUTE AS ts FROM range(0, 500) t(i) UNION ALL SELECT i, TIMESTAMP '2022-01-01' + INTERVAL (i) DAY FROM range(0, 3) t(i)")
def s25(spark, sf_dir):
    return g.any_date_range(spark, datetime(2022, 1, 1, 10), 500).union(g.any_date_range(spark, date(2022, 1, 1), 3))


@query("s26_s27_number_ranges", "SELECT i AS value FROM range(5, 60) t(i)")
def s26(spark, sf_dir):
    return g.number_range(spark, 5, 60)


@query("s28_random", "SELECT true AS inside, true AS centred, true AS whole, true AS chosen, CAST(20000 AS BIGINT) AS n")
def s28(spark, sf_dir):
    k = g.RandomState(7)
    f = k.frame(spark, 20000, u=k.rand(2, 5), z=k.randn(10, 2), i=k.randint(1, 6), w=k.choice(["a", "b"]))
    return f.agg(((F.min("u") >= 2) & (F.max("u") < 5)).alias("inside"), ((F.abs(F.avg("z") - 10) < 0.2) & (F.abs(F.stddev("z") - 2) < 0.2)).alias("centred"), ((F.min("i") == 1) & (F.max("i") == 6)).alias("whole"), (F.count_distinct("w") == 2).alias("chosen"), F.count("*").alias("n"))


@query("streaming_bars", f"SELECT bucket, event_type, open, high, low, close, total, n FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, {BARS} FROM events GROUP BY 1, 2) WHERE bucket + INTERVAL 1 HOUR <= (SELECT make_timestamp((epoch_us(max(ts)) // 1000 - 600000) * 1000) FROM events)")
def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    out = streaming_bars(source, "ts", "value", ["ts", "event_id"], by=["event_type"])
    name = "tidemark_bars"
    spark.catalog.dropTempView(name)
    found = run_once(out, name, scratch(spark, "stream"))
    return found.withColumn("total", F.round("total", 4)).withColumn("bucket", c("bucket").cast("timestamp_ntz"))

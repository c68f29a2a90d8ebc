"""Arithmetic, logic, comparison and dates (survey rows M, F19-F27, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import dates as d
from ..functions import maths as m
from ..functions import nulls as n
from .base import query, scalar, table

c = F.col
L = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
INF, NAN = "CAST('inf' AS DOUBLE)", "CAST('nan' AS DOUBLE)"
Q, E, D = "l_quantity", "l_extendedprice", "l_discount"


def r(x, digits: int = 6):
    return F.round(x, digits)


scalar("m01_add", "lineitem", L, {"y": (lambda: r(c(E) + c(Q)), f"round({E} + {Q}, 6)"), "w": (lambda: m.add(m.add(c("l_partkey"), 9223372036854770000, wrapping=True), c("l_partkey"), wrapping=True), "CASE WHEN 2 * l_partkey + 9223372036854770000::HUGEINT > 9223372036854775807::HUGEINT THEN (2 * l_partkey + 9223372036854770000::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE (2 * l_partkey + 9223372036854770000::HUGEINT)::BIGINT END")})
scalar("m02_subtract", "lineitem", L, {"y": (lambda: r(m.subtract(c(E), c(Q))), f"round({E} - {Q}, 6)"), "z": (lambda: m.subtract(c("l_partkey"), 5000), "l_partkey - 5000")})
scalar("m03_multiply", "lineitem", L, {"y": (lambda: r(m.multiply(c(E), 1 - c(D))), f"round({E} * (1 - {D}), 6)")})
scalar("m04_divide", "lineitem", L, {"f": (lambda: n.divide(c(Q) - 25, c(D)), f"CASE WHEN {D} = 0 THEN CASE WHEN {Q} > 25 THEN {INF} WHEN {Q} < 25 THEN -{INF} ELSE {NAN} END ELSE ({Q} - 25) / {D} END"), "i": (lambda: n.divide(c("l_partkey") - 1000, 7, integral=True), "CAST(trunc((l_partkey - 1000) / 7.0) AS BIGINT)")})
scalar("m05_negate", "lineitem", L, {"y": (lambda: m.negate(c(E)), f"-{E}")})
scalar("m06_bitwise", "lineitem", L, {"a": (lambda: m.bit_and(c("l_partkey"), c("l_suppkey")), "l_partkey & l_suppkey"), "o": (lambda: m.bit_or(c("l_partkey"), c("l_suppkey")), "l_partkey | l_suppkey"), "x": (lambda: m.bit_xor(c("l_partkey"), c("l_suppkey")), "xor(l_partkey, l_suppkey)")})
scalar("m07_shifts", "lineitem", L, {"l": (lambda: m.shift_left(c("l_partkey"), 3), "l_partkey << 3"), "r": (lambda: m.shift_right(c("l_partkey"), 2), "l_partkey >> 2"), "big": (lambda: m.shift_left(c("l_partkey"), 64), "l_partkey")})
scalar("m08_bitwise_not", "lineitem", L, {"y": (lambda: m.bit_not(c("l_partkey")), "~l_partkey")})
scalar("m09_abs", "lineitem", L, {"y": (lambda: F.abs(c(Q) - 25), f"abs({Q} - 25)")})
scalar("m10_exp", "lineitem", L, {"y": (lambda: r(F.exp(c(D))), f"round(exp({D}), 6)")})
scalar("m11_sqrt", "lineitem", L, {"y": (lambda: m.sqrt(c(Q) - 25), f"CASE WHEN {Q} < 25 THEN {NAN} ELSE sqrt({Q} - 25) END")})
scalar("m12_sign", "lineitem", L, {"y": (lambda: m.sign(c(Q) - 25), f"CAST(sign({Q} - 25) AS DOUBLE)"), "i": (lambda: m.sign(c("l_partkey") - 1000, integral=True), "CAST(sign(l_partkey - 1000) AS BIGINT)")})
scalar("m13_pow", "lineitem", L, {"y": (lambda: r(F.pow(c(D), F.lit(2.5))), f"round(pow({D}, 2.5), 6)")})
scalar("m14_logs", "lineitem", L, {k: (lambda f=f, o=o: F.when(c(Q) > 25, r(f(c(Q) - 25))).otherwise(f(c(Q) - 25)), f"CASE WHEN {Q} - 25 = {z} THEN -{INF} WHEN {Q} - 25 < {z} THEN {NAN} ELSE round({s}, 6) END") for k, f, o, z, s in (("ln", m.ln, 0, 0, f"ln({Q} - 25)"), ("log10", m.log10, 0, 0, f"log10({Q} - 25)"), ("log2", m.log2, 0, 0, f"log2({Q} - 25)"), ("log1p", m.log1p, 1, -1, f"ln({Q} - 24)"))})
scalar("m15_logb", "lineitem", L, {"y": (lambda: r(m.logb(c(Q), 3)), f"round(ln({Q}) / ln(3), 6)")})
scalar("m16_trigonometry", "lineitem", L, {"s": (lambda: r(F.sin(c(Q))), f"round(sin({Q}), 6)"), "k": (lambda: r(F.cos(c(Q))), f"round(cos({Q}), 6)"), "t": (lambda: r(F.tan(c(D))), f"round(tan({D}), 6)")})
scalar("m17_ceil_floor", "lineitem", L, {"u": (lambda: m.ceil(c(E) / 7), f"ceil({E} / 7)"), "d": (lambda: m.floor(-c(E) / 7), f"floor(-{E} / 7)")})
scalar("m18_round_half_even", "lineitem", L, {"y": (lambda: m.round_half_even(c(Q) / 2), f"CASE WHEN {Q} / 2 - floor({Q} / 2) = 0.5 THEN 2 * round({Q} / 4) ELSE round({Q} / 2) END")})
scalar("m19_trunc", "lineitem", L, {"y": (lambda: m.trunc((c(Q) - 25) / 4), f"trunc(({Q} - 25) / 4)")})
scalar("m20_round_to_multiple", "lineitem", L, {k: (lambda k=k: m.round_to_multiple(c(Q) - 25, 4.0, k), f"({s}) * 4") for k, s in (("down", f"floor(({Q} - 25) / 4)"), ("up", f"ceil(({Q} - 25) / 4)"), ("towards_zero", f"trunc(({Q} - 25) / 4)"), ("towards_infinity", f"sign({Q} - 25) * ceil(abs({Q} - 25) / 4)"), ("half_up", f"floor(({Q} - 25) / 4 + 0.5)"), ("half_down", f"ceil(({Q} - 25) / 4 - 0.5)"), ("half_towards_zero", f"sign({Q} - 25) * ceil(abs({Q} - 25) / 4 - 0.5)"), ("half_towards_infinity", f"sign({Q} - 25) * floor(abs({Q} - 25) / 4 + 0.5)"), ("half_to_even", f"CASE WHEN ({Q} - 25) / 4 - floor(({Q} - 25) / 4) = 0.5 THEN 2 * round(floor(({Q} - 25) / 4) / 2 + 0.25) ELSE round(({Q} - 25) / 4) END"), ("half_to_odd", f"CASE WHEN ({Q} - 25) / 4 - floor(({Q} - 25) / 4) = 0.5 THEN CASE WHEN floor(({Q} - 25) / 4) % 2 = 0 THEN ceil(({Q} - 25) / 4) ELSE floor(({Q} - 25) / 4) END ELSE round(({Q} - 25) / 4) END"))})
scalar("m21_clip", "events", ["event_id"], {"y": (lambda: m.clip(c("v"), 50.0, 200.0), "CASE WHEN v IS NULL THEN NULL ELSE greatest(least(v, 200.0), 50.0) END"), "s": (lambda: m.clip(c("v"), 50.0, 200.0, skip_null=True), "CASE WHEN v IS NULL THEN 200.0 ELSE greatest(least(v, 200.0), 50.0) END")})

# ------------------------------------------------------------------- logic

A, B = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 100 END", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id > 50 END"
X = f"CASE WHEN event_id % 4 = 0 THEN {NAN} WHEN event_id % 9 = 0 THEN {INF} ELSE v END"


def x():
    return F.when(c("event_id") % 4 == 0, F.lit(float("nan"))).when(c("event_id") % 9 == 0, F.lit(float("inf"))).otherwise(c("v"))


scalar("f19_f20_null_predicates", "events", ["event_id"], {"is_null": (lambda: x().isNull(), f"({X}) IS NULL"), "is_valid": (lambda: x().isNotNull(), f"({X}) IS NOT NULL"), "is_nan": (lambda: F.when(x().isNotNull(), F.isnan(x())), f"isnan({X})"), "is_finite": (lambda: F.when(x().isNotNull(), n.is_finite(x())), f"isfinite({X})"), "is_infinite": (lambda: n.is_infinite(x()), f"isinf({X})"), "true_unless_null": (lambda: n.true_unless_null(x()), f"CASE WHEN ({X}) IS NOT NULL THEN true END")})
scalar("f26_comparisons", "events", ["event_id"], {k: (lambda o=o: n.compare(x(), o, F.when(c("event_id") % 8 == 0, F.lit(float("nan"))).otherwise(F.lit(100.0)), True), f"CASE WHEN v IS NULL AND event_id % 4 <> 0 AND event_id % 9 <> 0 THEN NULL WHEN event_id % 4 = 0 THEN {'true' if o == '!=' else 'false'} ELSE ({X}) {'=' if o == '==' else o} 100.0 END") for k, o in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))})
scalar("f27_logic", "events", ["event_id"], {"both": (lambda: n.and_(F.expr(A), F.expr(B)), f"CASE WHEN ({A}) IS NULL OR ({B}) IS NULL THEN NULL ELSE ({A}) AND ({B}) END"), "either": (lambda: n.or_(F.expr(A), F.expr(B)), f"CASE WHEN ({A}) IS NULL OR ({B}) IS NULL THEN NULL ELSE ({A}) OR ({B}) END"), "neither": (lambda: ~F.expr(A), f"NOT ({A})")})
scalar("f07_if_else", "events", ["event_id"], {"y": (lambda: n.if_else(F.expr(A), c("v"), -1.0), f"CASE WHEN ({A}) IS NULL THEN NULL WHEN ({A}) THEN v ELSE -1.0 END")})
scalar("p22_cast", "lineitem", L, {"i": (lambda: c(Q).cast("long"), f"CAST({Q} AS BIGINT)"), "s": (lambda: c("l_partkey").cast("string"), "CAST(l_partkey AS VARCHAR)"), "t": (lambda: F.expr("try_cast(l_returnflag AS int)"), "try_cast(l_returnflag AS INTEGER)"), "b": (lambda: c(D).cast("boolean"), f"CAST({D} AS BOOLEAN)")})


@query("c01_scalar_operators", "SELECT (3 + 4) * 2 AS a, 7 // 2 AS b, 7 / 2.0 AS f, 6 & 3 AS d, 6 | 3 AS e, 1 << 4 AS g, 5 > 3 AS h, NOT (2 = 2) AS i")
def c01(spark, sf_dir):
    one = spark.range(1)
    return one.select(((F.lit(3) + 4) * 2).alias("a"), n.divide(F.lit(7), 2, True).cast("int").alias("b"), n.divide(F.lit(7.0), 2.0).alias("f"), m.bit_and(F.lit(6), F.lit(3)).alias("d"), m.bit_or(F.lit(6), F.lit(3)).alias("e"), m.shift_left(F.lit(1), 4).alias("g"), (F.lit(5) > 3).alias("h"), (~(F.lit(2) == 2)).alias("i"))


@query("c03_scalar_with_series_and_frame", "SELECT p_partkey AS \"index\", 10 - p_size AS a, round(2 * p_retailprice, 4) AS b FROM part")
def c03(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return f.add_column("a", 10 - f["p_size"]).add_column("b", (2 * f["p_retailprice"]).map_expr(lambda y: F.round(y, 4)))[["a", "b"]].to_df()


@query("df_arithmetic", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((q + q) * q) / q, 4) AS q, round(((e + e) * e) / e, 4) AS e FROM (SELECT *, {Q} AS q, {E} AS e FROM lineitem)")
def df_arithmetic(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "lineitem").select(F.struct(*L).alias("k"), c(Q).alias("q"), c(E).alias("e")), "k")
    out = ((f + f) * f) / f
    return out.unary(lambda y: F.round(y, 4)).to_df("k").select("k.*", "q", "e")


# ------------------------------------------------------------------- dates

T = "ts"
scalar("d02_calendar_fields", "events", ["event_id"], {k: (lambda k=k: getattr(d, k)(c(T)), f"CAST({s} AS BIGINT)") for k, s in (("year", "year(ts)"), ("quarter", "quarter(ts)"), ("month", "month(ts)"), ("day", "day(ts)"), ("day_of_year", "dayofyear(ts)"))})
scalar("d03_day_of_week", "orders", ["o_orderkey"], {"y": (lambda: d.day_of_week(c("o_orderdate")), "CAST(isodow(o_orderdate) - 1 AS BIGINT)")})
scalar("d04_clock_fields", "events", ["event_id"], {k: (lambda k=k: getattr(d, k)(c(T)), f"CAST({k}(ts) AS BIGINT)") for k in ("hour", "minute", "second")})
scalar("d05_subseconds", "events", ["event_id"], {"millisecond": (lambda: d.millisecond(c(T)), "(epoch_us(ts) % 1000000) // 1000"), "microsecond": (lambda: d.microsecond(c(T)), "epoch_us(ts) % 1000"), "nanosecond": (lambda: d.nanosecond(c(T)), "CAST(0 AS BIGINT)"), "subsecond": (lambda: d.subsecond(c(T)), "(epoch_us(ts) % 1000000) / 1000000.0")})
scalar("d06_iso_year_week", "orders", ["o_orderkey"], {"iso_year": (lambda: d.iso_year(c("o_orderdate")), "CAST(isoyear(o_orderdate) AS BIGINT)"), "iso_week": (lambda: d.iso_week(c("o_orderdate")), "CAST(weekofyear(o_orderdate) AS BIGINT)")})
scalar("d07_iso_calendar", "orders", ["o_orderkey"], {"iso_year": (lambda: d.iso_year(c("o_orderdate")), "CAST(isoyear(o_orderdate) AS BIGINT)"), "iso_week": (lambda: d.iso_week(c("o_orderdate")), "CAST(weekofyear(o_orderdate) AS BIGINT)"), "iso_day_of_week": (lambda: d.iso_day_of_week(c("o_orderdate")), "CAST(isodow(o_orderdate) AS BIGINT)")})
scalar("d08_year_month_day", "orders", ["o_orderkey"], {k: (lambda k=k: getattr(d, k)(c("o_orderdate")), f"CAST({k}(o_orderdate) AS BIGINT)") for k in ("year", "month", "day")})
WED = "(CAST(o_orderdate AS DATE) + CAST(3 - dayofweek(o_orderdate) AS INTEGER))"
scalar("d09_us_week", "orders", ["o_orderkey"], {"us_year": (lambda: d.us_year(c("o_orderdate")), f"CAST(year({WED}) AS BIGINT)"), "us_week": (lambda: d.us_week(c("o_orderdate")), f"CAST((dayofyear({WED}) - 1) // 7 + 1 AS BIGINT)")})
scalar("d10_week_options", "orders", ["o_orderkey"], {"iso": (lambda: d.week(c("o_orderdate")), "CAST(weekofyear(o_orderdate) AS BIGINT)"), "full_from_zero": (lambda: d.week(c("o_orderdate"), True, True, True), "CAST((dayofyear(o_orderdate) + 6 - (isodow(o_orderdate) - 1)) // 7 AS BIGINT)"), "us": (lambda: d.week(c("o_orderdate"), monday=False), f"CAST((dayofyear({WED}) - 1) // 7 + 1 AS BIGINT)")})
scalar("d11_leap_year", "orders", ["o_orderkey"], {"leap": (lambda: d.is_leap_year(c("o_orderdate")), "(year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0))")})
scalar("d11_is_dst", "orders", ["o_orderkey"], {"dst": (lambda: d.is_dst(F.timestamp_add("HOUR", F.lit(12), c("o_orderdate")), "Europe/Berlin"), "((o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE 'Europe/Berlin') <> ((o_orderdate + INTERVAL 11 HOUR) AT TIME ZONE 'UTC')")})
U = "ts + INTERVAL (event_id) MINUTE"


def u():
    return F.timestamp_add("MINUTE", c("event_id"), c(T))


scalar("d12_boundaries_of_days_and_longer", "events", ["event_id"], {"years": (lambda: d.years_between(c(T), u()), f"date_diff('year', ts, {U})"), "quarters": (lambda: d.quarters_between(c(T), u()), f"date_diff('quarter', ts, {U})"), "weeks": (lambda: d.weeks_between(c(T), u()), f"date_diff('day', date_trunc('week', ts), date_trunc('week', {U})) // 7"), "days": (lambda: d.days_between(c(T), u()), f"date_diff('day', ts, {U})")})
scalar("d13_boundaries_of_hours_and_shorter", "events", ["event_id"], {f"{k}s": (lambda k=k: d.units_between(c(T), u(), k), f"date_diff('{k}', ts, {U})") for k in ("hour", "minute", "second", "millisecond", "microsecond")} | {"nanoseconds": (lambda: d.units_between(c(T), u(), "nanosecond"), f"date_diff('microsecond', ts, {U}) * 1000")})
scalar("d14_intervals", "events", ["event_id"], {"months": (lambda: d.month_day_nano_interval_between(c(T), u())["months"], f"date_diff('month', ts, {U})"), "days": (lambda: d.month_day_nano_interval_between(c(T), u())["days"], f"CAST(day({U}) - day(ts) AS BIGINT)"), "nanos": (lambda: d.month_day_nano_interval_between(c(T), u())["nanos"], f"(epoch_us({U}) % 86400000000 - epoch_us(ts) % 86400000000) * 1000"), "ym": (lambda: F.extract(F.lit("MONTH"), d.month_interval_between(c(T), u())).cast("long"), f"date_diff('month', ts, {U}) % 12"), "dt": (lambda: F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + d.day_time_interval_between(c(T), u())) - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp")), f"epoch_us({U}) - epoch_us(ts)")})
scalar("d15_strftime", "events", ["event_id"], {"y": (lambda: d.strftime(c(T), "%Y-%m-%d %H:%M at %d/%m/%y"), "strftime(ts, '%Y-%m-%d %H:%M at %d/%m/%y')")})
scalar("d16_strptime", "events", ["event_id"], {"y": (lambda: d.strptime(F.date_format(c(T), "yyyy/MM/dd HH:mm:ss"), "%Y/%m/%d %H:%M:%S"), "date_trunc('second', ts)"), "bad": (lambda: d.strptime(F.col("event_type"), "%Y", error_is_null=True), "CAST(NULL AS TIMESTAMP)")})
scalar("d17_to_datetime", "events", ["event_id"], {"y": (lambda: d.to_datetime(F.col("ts").cast("string")), "ts")})
FLOORS = {"second": "second", "minute": "minute", "hour": "hour", "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}
scalar("d01_floor", "events", ["event_id"], {k: (lambda k=k: d.floor(c(T), 1, k), f"CAST(date_trunc('{k}', ts) AS TIMESTAMP)") for k in FLOORS} | {"m7": (lambda: d.floor(c(T), 7, "minute"), "make_timestamp(epoch_us(ts) // 420000000 * 420000000)"), "m7_calendar": (lambda: d.floor(c(T), 7, "minute", calendar_origin=True), "date_trunc('hour', ts) + INTERVAL (minute(ts) // 7 * 7) MINUTE"), "h5_calendar": (lambda: d.floor(c(T), 5, "hour", calendar_origin=True), "date_trunc('day', ts) + INTERVAL (hour(ts) // 5 * 5) HOUR")})
scalar("d01_ceil", "orders", ["o_orderkey"], {"day": (lambda: d.ceil(c("o_orderdate"), 1, "day"), "o_orderdate"), "strictly": (lambda: d.ceil(c("o_orderdate"), 1, "day", strictly=True), "o_orderdate + INTERVAL 1 DAY"), "week": (lambda: d.ceil(c("o_orderdate"), 1, "week"), "CASE WHEN isodow(o_orderdate) = 1 THEN o_orderdate ELSE CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) + INTERVAL 7 DAY END"), "month": (lambda: d.ceil(c("o_orderdate"), 1, "month"), "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 MONTH"), "quarter": (lambda: d.ceil(c("o_orderdate"), 1, "quarter"), "CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) + INTERVAL 3 MONTH"), "year": (lambda: d.ceil(c("o_orderdate"), 1, "year"), "CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) + INTERVAL 12 MONTH")})
scalar("d01_round", "events", ["event_id"], {"day": (lambda: d.round(c(T), 1, "day"), "CAST(date_trunc('day', ts + INTERVAL 12 HOUR) AS TIMESTAMP)"), "hour": (lambda: d.round(c(T), 1, "hour"), "CAST(date_trunc('hour', ts + INTERVAL 30 MINUTE) AS TIMESTAMP)"), "month": (lambda: d.round(c(T), 1, "month"), "CASE WHEN epoch_us(ts) - epoch_us(date_trunc('month', ts)::TIMESTAMP) >= epoch_us(date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH) - epoch_us(ts) THEN date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH ELSE date_trunc('month', ts)::TIMESTAMP END")})
O = "o_orderdate"
scalar("d18_offsets", "orders", ["o_orderkey"], {"d": (lambda: d.offset(c(O), "D", 3), f"{O} + INTERVAL 3 DAY"), "w": (lambda: d.offset(c(O), "W", -2), f"{O} - INTERVAL 14 DAY"), "ms": (lambda: d.offset(c(O), "MS", 2), f"{O} + INTERVAL 2 MONTH"), "me": (lambda: d.offset(c(O), "M", 1), f"CAST(last_day({O} + INTERVAL 1 MONTH) AS TIMESTAMP)"), "qe": (lambda: d.offset(c(O), "Q", 0), f"CAST(date_trunc('quarter', {O}) AS TIMESTAMP) + INTERVAL 3 MONTH - INTERVAL 1 DAY"), "ye": (lambda: d.offset(c(O), "Y", -1), f"make_timestamp(CAST(year({O}) - 1 AS BIGINT), 12, 31, 0, 0, 0.0)"), "ys": (lambda: d.offset(c(O), "YS", 1), f"{O} + INTERVAL 1 YEAR")})


@query("c04_scalar_values", "SELECT CAST(count(*) AS DOUBLE) AS n, true AS missing, true AS refused, min(p_name) AS first, CAST(year(DATE '2022-03-04') AS BIGINT) AS y, true AS valid FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def c04(spark, sf_dir):
    from datetime import date

    from ..frame import as_value
    from ..operators.select import at

    f = Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"), F.lit(date(2022, 3, 4)).alias("d")), "p_partkey")
    try:
        refused = as_value(at(f, 0, "none"), "bigint") is None
    except ValueError:
        refused = True
    missing = as_value(at(f, 0, "none"), "double")
    row = (as_value(at(f, 0, "one"), "double"), missing != missing, refused, as_value(at(f, 0, "p_name"), "string"), at(f, 0, "d").year, at(f, 0, "one") is not None)
    return spark.createDataFrame([row], "n double, missing boolean, refused boolean, first string, y long, valid boolean")


@query("d19_time_spans", "SELECT * FROM (VALUES ('3T', CAST(180000000 AS BIGINT), CAST(NULL AS BIGINT), CAST(3 AS BIGINT)), ('2D', 172800000000, NULL, 2), ('QS', NULL, 3, 1), ('10L', 10000, NULL, 10), ('2W', 1209600000000, NULL, 2), ('YS', NULL, 12, 1)) t(rule, micros, months, steps)")
def d19(spark, sf_dir):
    from ..plans import freq

    rules = [(r, freq.parse(r).micros, freq.parse(r).months, freq.parse(r).count) for r in ("3T", "2D", "QS", "10L", "2W", "YS")]
    return spark.createDataFrame(rules, "rule string, micros long, months long, steps long")

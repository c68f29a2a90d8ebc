"""Literal goldens, null rules against plain Python, and edge cases."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.frame import IDX, POS, Frame, with_position
from tidemark.functions import dates, maths, nulls, strings
from tidemark.operators import aggregate, align, resample, select, sort, window
from tidemark.plans import freq


def values(frame, column):
    return [r[0] for r in frame.df.orderBy(POS).select(column).collect()]


def minute9(spark):
    start = datetime(2000, 1, 1)
    return Frame.from_columns(spark, {"v": list(range(9))}, [start + timedelta(minutes=k) for k in range(9)])


@pytest.mark.parametrize("closed,label,want", [(False, False, {0: 3, 3: 12, 6: 21}), (False, True, {3: 3, 6: 12, 9: 21}), (True, True, {0: 0, 3: 6, 6: 15, 9: 15})])
def test_resample_goldens(spark, closed, label, want):
    got = resample.resample(minute9(spark), "3T", closed, label).agg({"v": ("v", "sum")}).collect()
    assert {r.key.minute: r.v for r in got} == want


def test_resample_apply_and_downsample(spark):
    got = resample.resample(minute9(spark), "3T").apply_scalar(lambda p: float(p["v"].sum() + 5)).collect()
    assert sorted(r.value for r in got) == [8, 17, 26]
    weeks = [datetime(2018, 1, 7) + timedelta(weeks=k) for k in range(8)]
    f = Frame.from_columns(spark, {"price": [10, 11, 9, 13, 14, 18, 17, 19]}, weeks)
    got = resample.downsample(f, "M").agg({"p": ("price", "mean")}).collect()
    assert {(r.key.month, r.key.day): r.p for r in got} == {(1, 31): 10.75, (2, 28): 17}


@pytest.mark.parametrize("options,x,want", [({"adjust": True}, [1, 2, 3, 4, 5], [1, 1.75, 2.615, 3.55, 4.53]), ({"adjust": False}, [1, 2, 3, 4, 5], [1, 1.6667, 2.5556, 3.5185, 4.5062]), ({"adjust": False, "ignore_na": True}, [2, 3, None, 5, 6], [2, 2.6667, 2.6667, 4.2222, 5.4074]), ({"adjust": True, "ignore_na": True}, [2, 3, None, 5, 6], [2, 2.75, 2.75, 4.3077, 5.45])])
def test_ewm_goldens(spark, options, x, want):
    f = Frame.from_columns(spark, {"v": [None if v is None else float(v) for v in x]})
    assert values(window.ewm(f, "v", com=0.5, **options), "ewm") == pytest.approx(want, rel=0.01)


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_na", [True, False])
@pytest.mark.parametrize("bias", [True, False])
def test_ewm_against_pandas(adjust, ignore_na, bias):
    import pandas as pd

    x = np.array([np.nan, 2.0, 3.0, np.nan, np.nan, 5.0, 6.0, 1.0])
    e = pd.Series(x).ewm(alpha=0.3, adjust=adjust, ignore_na=ignore_na)
    np.testing.assert_allclose(window.ewm_mean(x, 0.3, adjust, ignore_na, 0), e.mean())
    np.testing.assert_allclose(window.ewm_var(x, 0.3, adjust, ignore_na, 0, bias), e.var(bias=bias))
    assert window.ewm_alpha(halflife=1) == 0.5
    with pytest.raises(ValueError):
        window.ewm_alpha(com=1, span=3)


@pytest.mark.parametrize("block", [2, 4, 100])
def test_windows_in_blocks(spark, block):
    f = Frame.from_columns(spark, {"v": [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]})
    if block > 2:
        out = window.rolling(f, 3, {"s": ("v", "sum")}, block=block)
        assert values(out, "s") == [4, 5, 7, 8] and values(out, IDX) == [2, 3, 4, 5]
    assert values(window.expanding(f, 3, {"s": ("v", "sum")}, block=block), "s") == [4, 6, 9, 12]
    assert values(window.rolling(f, 10, {"s": ("v", "sum")}), "s") == []
    g = Frame.from_columns(spark, {"v": [1.0, None, 3.0, None, None, 6.0]})
    assert values(select.fill(g), "v") == [1, 1, 3, 3, 3, 6]
    assert values(select.fill(g, forward=False), "v") == [1, 3, 3, 6, 6, 6]
    assert values(window.cumulative(g, "v", "sum", block=block), "v") == [1, None, 4, None, None, 10]
    assert values(window.cumulative(g, "v", "sum", skip_nulls=False, block=block), "v") == [1, None, None, None, None, None]


def test_shift_and_change(spark):
    f = Frame.from_columns(spark, {"v": [1.0, 2.0, 3.0, 4.0, 5.0]})
    assert values(window.shift(f, {"v": "s"}, 1, block=3), "s") == [None, 1, 2, 3, 4]
    assert values(window.shift(f, {"v": "s"}, -2, 0.0, block=3), "s") == [3, 4, 5, 0, 0]
    assert values(window.pct_change(f, "v", block=3), "pct_change")[1:] == pytest.approx([1, 0.5, 1 / 3, 0.25])


def test_change_after_zero(spark):
    f = Frame.from_columns(spark, {"v": [0.0, 2.0, 0.0, 0.0, -1.0, None, 0.0]})
    assert str(values(window.pct_change(f, "v", block=3), "pct_change")) == "[None, inf, -1.0, nan, -inf, None, None]"


def test_selection_goldens(spark):
    a = Frame.from_columns(spark, {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8]})
    cond = Frame.from_columns(spark, {"a": [True, False, True, False], "b": [False, True, False, True]})
    assert values(select.where_else(a, cond, a * 10), "a") == [1, 20, 3, 40]
    assert values(select.where_else(a, cond, 42), "b") == [42, 6, 42, 8]
    f = Frame.from_columns(spark, {"v": [1, 2, 3, 4, 5, 6, 7], "m": [True, True, True, False, False, True, True]})
    other = Frame.from_columns(spark, {"o": [10, 20, 30, 40, 50, 60, 70]})
    assert values(select.replace_with_mask(f["v"], f["m"], other["o"]), "v") == [10, 20, 30, 4, 5, 40, 50]
    s = Frame.from_columns(spark, {"v": [1, 2, 3, 4, 5]}, list("abcde"))
    s = Frame(s.df)
    assert values(select.label_slice(s, "c"), "v") == [3, 4, 5] and values(select.label_slice(s, "b", "d"), "v") == [2, 3]
    with pytest.raises(KeyError):
        select.label_slice(s, "z")
    with pytest.raises(KeyError):
        s["nope"]


def test_reindex_concat_and_align(spark):
    f = Frame.from_columns(spark, {"c1": [1, 2, 3, 4, 5], "c2": [5, 4, 3, 2, 1]}, [1, 2, 3, 4, 5])
    new = spark.createDataFrame([(k,) for k in (1, 2, 4, 5, 6)], "k long")
    assert values(align.reindex(f, new, "k"), "c2") == [5, 4, 2, 1, None]
    x, y = Frame.from_columns(spark, {"v": [1, 2]}, [1, 2]), Frame.from_columns(spark, {"v": ["a", "b"]}, [2, 3])
    assert values(align.concat_rows([x, y]), "v") == ["1", "2", "a", "b"]
    assert values(align.concat_columns([x, y]), "v_1") == [None, "a", "b"]
    z = Frame.from_columns(spark, {"v": [10, 20]}, [2, 3])
    assert values((x["v"] + z["v"]).to_frame(), "v") == [None, 12, None]
    with pytest.raises(ValueError):
        align.concat_rows([])


def test_describe_and_aggregates(spark):
    f = Frame.from_columns(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    r = {x.column: x for x in aggregate.describe(f).collect()}["a"]
    assert (r["count"], r.mean, r["std"], r["min"], r.p25, r.p50, r.p75, r["max"], r.nunique) == (3, 2, 1, 1, 1.5, 2, 2.5, 3, 3)
    with pytest.raises(TypeError):
        aggregate.describe(Frame.from_columns(spark, {"s": ["x"]}))
    g = Frame.from_columns(spark, {"a": [1, 1, 3, 1, 1, 1, 3, 8, 2, 2], "b": list(range(10, 0, -1))})
    got = aggregate.group_by(g, "a").apply_columns(lambda s: s.sum()).collect()
    assert {r.key: (r.a, r.b) for r in got} == {1: (5, 37), 3: (6, 12), 8: (8, 3), 2: (4, 3)}
    assert [r.key for r in aggregate.group_by(g, "a").sizes().orderBy("place").collect()] == [1, 3, 8, 2]
    e = Frame.from_columns(spark, {"a": [None, None]}, schema="a double")
    assert {r.column: r.value for r in aggregate.per_column(e, "sum").collect()} == {"a": 0.0}


def test_null_and_division_rules(spark):
    cases = [None, 0.0, 1.0, -2.5, math.inf, -math.inf, math.nan]
    rows = [(a, b) for a in cases for b in cases]
    df = spark.createDataFrame(rows, "a double, b double")
    out = df.select("a", "b", nulls.divide(F.col("a"), F.col("b")).alias("d"), *[nulls.compare(F.col("a"), o, F.col("b"), True).alias(f"c{k}") for k, o in enumerate(("==", "<", ">="))]).collect()
    for r in out:
        if r.a is None or r.b is None:
            assert r.d is None and r.c0 is None
            continue
        with np.errstate(all="ignore"):
            want = np.float64(r.a) / np.float64(r.b)
        assert r.d == want or (math.isnan(r.d) and math.isnan(want)) or r.b == 0.0
        assert (r.c0, r.c1, r.c2) == (r.a == r.b, r.a < r.b, r.a >= r.b)
    bools = spark.createDataFrame([(a, b) for a in (None, True, False) for b in (None, True, False)], "a boolean, b boolean")
    for r in bools.select("a", "b", nulls.and_(F.col("a"), F.col("b")).alias("n"), nulls.if_else(F.col("a"), 1, 2).alias("i")).collect():
        assert r.n == (None if r.a is None or r.b is None else r.a and r.b) and r.i == {None: None, True: 1, False: 2}[r.a]


def test_maths_against_arrow(spark):
    x = [None, -2.5, -1.5, -0.5, 0.0, 0.5, 1.5, 2.5, 3.7, 8.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    modes = ("down", "up", "towards_zero", "towards_infinity", "half_down", "half_up", "half_towards_zero", "half_towards_infinity", "half_to_even", "half_to_odd")
    got = df.select("i", *[maths.round_to_multiple(F.col("x"), 1.0, m).alias(m) for m in modes], maths.round_half_even(F.col("x")).alias("r"), maths.trunc(F.col("x")).alias("t")).orderBy("i").collect()
    for m in modes:
        assert [r[m] for r in got] == pc.round_to_multiple(pa.array(x), 1.0, round_mode=m).to_pylist(), m
    assert [r.r for r in got] == pc.round(pa.array(x)).to_pylist() and [r.t for r in got] == pc.trunc(pa.array(x)).to_pylist()
    one = spark.range(1).select(maths.add(F.lit(2**63 - 1), F.lit(1), wrapping=True).alias("w")).first()
    assert one.w == -(2**63)


def test_strings_against_arrow(spark):
    x = [None, "", "Hello, World-foo", "éa ÀB c", "aXbX", "  pad\t", "12", "A1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x string")
    c = F.col("x")
    pairs = {
        "utf8_title": (strings.utf8_title(c), pc.utf8_title(pa.array(x))),
        "capitalize": (strings.utf8_capitalize(c), pc.utf8_capitalize(pa.array(x))),
        "center": (strings.center(c, 9, "*"), pc.utf8_center(pa.array(x), 9, "*")),
        "lpad": (strings.lpad(c, 4, "*"), pc.utf8_lpad(pa.array(x), 4, "*")),
        "slice": (strings.slice_codeunits(c, 1, 6, 2), pc.utf8_slice_codeunits(pa.array(x), 1, 6, 2)),
        "trim": (strings.trim_whitespace(c), pc.utf8_trim_whitespace(pa.array(x))),
        "find": (strings.find_substring(c, "X"), pc.find_substring(pa.array(x), "X")),
        "alnum": (strings.is_class(c, "utf8_is_alnum"), pc.utf8_is_alnum(pa.array(x))),
        "lower": (strings.utf8_is_lower(c), pc.utf8_is_lower(pa.array(x))),
        "split": (strings.split_pattern(c, "X", 1, from_right=True), pc.split_pattern(pa.array(x), "X", max_splits=1, reverse=True)),
        "replace": (strings.replace_substring(c, "X", "-", 1), pc.replace_substring(pa.array(x), "X", "-", max_replacements=1)),
        "slice2": (strings.replace_slice(c, 1, -1, "_"), pc.utf8_replace_slice(pa.array(x), 1, -1, "_")),
    }
    got = df.select("i", *[a.alias(n) for n, (a, _) in pairs.items()]).orderBy("i").collect()
    for n, (_, want) in pairs.items():
        assert [r[n] for r in got] == want.to_pylist(), n


def test_dates_against_arrow(spark):
    x = [datetime(1969, 12, 31, 23, 59, 59), datetime(2020, 2, 29, 12), datetime(2022, 1, 1), datetime(2014, 12, 31, 1), datetime(2018, 2, 1), datetime(2024, 1, 1, 13, 50)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, t timestamp_ntz")
    t, arrow = F.col("t"), pa.array(x, pa.timestamp("us"))
    pairs = {n: (getattr(dates, n)(t), getattr(pc, n)(arrow)) for n in ("iso_year", "iso_week", "us_week", "us_year", "day_of_week", "quarter", "is_leap_year")}
    pairs |= {f"{k}{n}{u}": (getattr(dates, k)(t, n, u), getattr(pc, f"{k}_temporal")(arrow, n, u)) for k in ("floor", "ceil", "round") for n, u in ((1, "day"), (7, "minute"), (1, "week"), (1, "month"), (1, "quarter"), (1, "year"))}
    for n, options in enumerate([(True, False, False), (True, True, True), (False, False, False), (False, True, False), (False, False, True)]):
        m, z, full = options
        pairs[f"week{n}"] = dates.week(t, *options), pc.week(arrow, week_starts_monday=m, count_from_zero=z, first_week_is_fully_in_year=full)
    got = df.select("i", *[a.alias(n) for n, (a, _) in pairs.items()]).orderBy("i").collect()
    for n, (_, want) in pairs.items():
        assert [r[n] for r in got] == want.to_pylist(), n


def test_sort_places_nulls_and_nan_last(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, None, math.nan, 1.0, 3.0])], "i long, x double")
    f = Frame.of(df, "i")
    assert values(sort.ranked(f, ["x"]), IDX) == [3, 0, 4, 2, 1]
    assert values(sort.ranked(f, ["x"], False), IDX) == [4, 0, 3, 2, 1]


def test_dense_positions(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"))
    got = with_position(df, ["k"], "p", parts=7).collect()
    assert all(r.k == r.p for r in got) and len(got) == 1000
    same = with_position(df.select(F.lit(5).alias("a"), "k"), ["a", "k"], "p", parts=7).collect()
    assert all(r.k == r.p for r in same)


def test_rules_and_patterns():
    assert freq.parse("3T").micros == 180_000_000 and freq.parse("QS").months == 3
    for bad in ("", "3", "T3", "0D", "Z"):
        with pytest.raises(ValueError):
            freq.parse(bad)
    assert freq.date_pattern("%Y at %d") == "yyyy 'at' dd"
    with pytest.raises(ValueError):
        freq.date_pattern("%Q")
    assert align.common_type([]) == "void"


def test_frames_of_other_lengths_are_refused(spark):
    a, b = Frame.from_columns(spark, {"v": [1, 2]}), Frame.from_columns(spark, {"v": [1, 2, 3]})
    with pytest.raises(Exception, match="differ in length"):
        (a + b).df.collect()
    with pytest.raises(ValueError):
        Frame.from_columns(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(Exception, match="lossy"):
        Frame.from_columns(spark, {"a": [1.5]})["a"].cast("int").to_frame().df.collect()


@pytest.mark.parametrize("name", ["bars_hourly", "g_mean", "w01_rolling", "f24_replace_with_mask", "j06_align_series", "s22_date_range_periods"])
def test_queries_equal_sql(spark, name):
    from tidemark import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "part", "customer"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    ran = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(map(str, ran.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())


def test_sums_of_large_keys_wrap(spark, tmp_path):
    from tidemark import queries

    con = duckdb.connect()
    path = f"{tmp_path}/lineitem.parquet"
    con.execute(f"copy (select range l_orderkey, 1 l_linenumber, k l_partkey, 2 l_suppkey, 1.5::double l_quantity, 2.5::double l_extendedprice from range(4), (select unnest([0, 5807, 5808, 1::bigint << 61]) k)) to '{path}'")
    con.execute(f"create view lineitem as select * from '{path}'")
    want = con.execute(queries.oracle_sql()["m01_add"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.queries()["m01_add"](spark, str(tmp_path)).collect())


def test_changes_are_rounded_as_in_sql(spark, tmp_path):
    """A change over a zero, and one whose shortest decimal is a tie that its double isn't."""
    from tidemark import queries

    con = duckdb.connect()
    path = f"{tmp_path}/events.parquet"
    con.execute(f"copy (select generate_subscripts(v, 1) event_id, now()::timestamp ts, 1 user_id, 'a' event_type, unnest(v) value from (select [51.2, 0.0, 160.66, 3.0, 0.0, 0.0, 0.0]::double[] v)) to '{path}'")
    con.execute(f"create view events as select * from '{path}'")
    want = con.execute(queries.oracle_sql()["w07_pct_change"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.queries()["w07_pct_change"](spark, str(tmp_path)).collect())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

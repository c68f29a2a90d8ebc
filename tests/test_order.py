"""Orders, ranges and what is computed over them."""

import datetime
import decimal
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.frame import IDX, POS, ROW, Frame, as_value
from tidemark.operators import aggregate, align, select, sort, window
from tidemark.order import PART, Key, Ranges, with_position

KINDS = {
    "int": lambda r: r.randrange(-5, 5),
    "long": lambda r: r.randrange(-(1 << 62), 1 << 62),
    "double": lambda r: r.choice([math.nan, math.inf, -math.inf, r.random(), 0.5]),
    "float": lambda r: r.choice([math.nan, 0.1, -2.5, float(r.randrange(9))]),
    "string": lambda r: r.choice(["", "a", "é", "z" * 70 + r.choice("ab"), "\"\\\n", "Z"]),
    "binary": lambda r: bytes([r.randrange(256)]) * r.randrange(3),
    "boolean": lambda r: r.random() < 0.5,
    "date": lambda r: datetime.date(1960, 1, 1) + datetime.timedelta(days=r.randrange(30000)),
    "timestamp_ntz": lambda r: datetime.datetime(1960, 1, 1) + datetime.timedelta(microseconds=r.randrange(10**15)),
    "timestamp": lambda r: datetime.datetime(1990, 1, 1) + datetime.timedelta(seconds=r.randrange(10**9)),
    "decimal(20,3)": lambda r: decimal.Decimal(r.randrange(-(10**12), 10**12)) / 1000,
    "struct<a:int,b:string>": lambda r: (r.choice([None, 1, 2]), r.choice([None, "x", "y"])),
}


@pytest.mark.parametrize("kind", KINDS)
def test_positions_of_every_type(spark, kind):
    rng = random.Random(kind)
    rows = [(k, None if rng.random() < 0.2 else KINDS[kind](rng)) for k in range(160)]
    df = spark.createDataFrame(rows, f"k int, x {kind}").repartition(5)
    out, plain = df, df
    for n, (up, first) in enumerate([(True, True), (True, False), (False, True), (False, False)]):
        key = Key(F.col("x"), up, first)
        out = out.join(with_position(df, [key, Key(F.col("k"))], f"p{n}", parts=7).select("k", f"p{n}"), "k")
        plain = plain.withColumn(f"p{n}", F.row_number().over(Window.orderBy(key.sort, "k")) - 1)
    names = ["k", *(f"p{n}" for n in range(4))]
    assert sorted(map(tuple, out.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))


@pytest.mark.parametrize("up", [True, False])
def test_frames_sort_by_times_and_dates(spark, up):
    rng = random.Random(2)
    rows = [(k, *(None if rng.random() < 0.2 else KINDS[t](rng) for t in ("timestamp_ntz", "date", "double"))) for k in range(60)]
    f = Frame.of(spark.createDataFrame(rows, "k int, t timestamp_ntz, d date, x double"), "k")
    for c, at in (("t", 1), ("d", 2), ("x", 3)):
        bad = lambda r: 2 if r[at] is None else int(r[at] != r[at])  # noqa: B023, E731
        good = sorted((r for r in rows if not bad(r)), key=lambda r: r[at], reverse=not up)  # noqa: B023
        want = [r[0] for r in [*good, *sorted((r for r in rows if bad(r)), key=bad)]]
        assert [r[0] for r in sort.ranked(f, [c], up).df.orderBy(POS).select(IDX).collect()] == want
        assert [r[0] for r in sort.sort_values(f, [c], up).df.select(IDX).collect()] == want
        assert [r.position for r in sort.argsort(f, [c], up).orderBy("place").collect()] == want
    assert sort.nth_element(f, "t", 3).first().position == sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])[3][0]
    by_time = Frame.of(f.df.where("t is not null").select("t", F.col(IDX).alias("k")), "t", ["k"])
    assert [r.k for r in sort.sort_index(by_time, up).df.orderBy(POS).collect()] == [r[0] for r in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1], reverse=not up)]


def spread(df, keys, parts=16):
    """(ranges with rows, share of the largest)."""
    ranges = Ranges.of(df, [Key(F.col(k)) for k in keys], parts)
    sizes = [r["count"] for r in ranges.mark(df).groupBy(PART).count().collect()]
    return len(sizes), max(sizes) / sum(sizes)


def test_no_range_holds_a_hot_value_strings_or_a_frame(spark):
    df = spark.range(8000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("hot"), F.concat(F.lit("name "), F.lpad("id", 6, "0")).alias("name"))
    for keys in (["hot", "id"], ["name"], ["id"]):
        n, share = spread(df, keys)
        assert n >= 12 and share < 0.25
    both = align.concat_rows([Frame.of(df.select("id", "hot"), "id"), Frame.of(df.select("id", "hot"), "id")])
    n, share = spread(both.df, [POS])
    assert n >= 12 and share < 0.25
    assert "Exchange SinglePartition" not in both.reset_index(drop=True).df._jdf.queryExecution().toString()


def test_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], "k long, s string")
    assert with_position(none, ["k"]).count() == 0
    f = Frame.of(none, "k")
    assert window.ewm(Frame.of(spark.createDataFrame([], "k long, v double"), "k"), "v", com=1.0).df.count() == 0
    assert select.preview(f).count() == 0
    one = Frame.of(spark.createDataFrame([(5, None)], "k long, v double"), "k")
    assert window.ewm(one, "v", com=1.0).df.first().ewm is None and one.dense().first()[ROW] == 0


@pytest.mark.parametrize("how", ["mean", "var", "std"])
@pytest.mark.parametrize("adjust", [True, False])
def test_weighted_windows_over_several_ranges(spark, how, adjust):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300).cumsum()
    x[rng.random(300) < 0.25] = np.nan
    rows = [(k // 10, k % 10, None if v != v else float(v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a int, b int, v double").repartition(7)
    f = Frame.of(df.select("a", "b", "v"), "a", ["a", "b"])
    for ignore in (True, False):
        got = window.ewm(f, "v", how, alpha=0.2, adjust=adjust, ignore_na=ignore, block=20)
        got = [np.nan if r.ewm is None else r.ewm for r in got.df.orderBy(POS).collect()]
        np.testing.assert_allclose(got, getattr(pd.Series(x).ewm(alpha=0.2, adjust=adjust, ignore_na=ignore), how)(), rtol=1e-7)


def test_weighted_scans_compose():
    rng = np.random.default_rng(2)
    for alpha, adjust, ignore in [(a, b, c) for a in (0.001, 0.3, 0.9999, 1.0) for b in (True, False) for c in (True, False)]:
        x = rng.normal(size=2000).cumsum() + 100
        x[rng.random(2000) < 0.3] = np.nan
        scan, state, out = window.Weighted(alpha, adjust, ignore), window.Weighted.EMPTY, []
        whole = scan.scan(x)
        cuts = [0, 0, 1, 40, 41, 900, 1999, 2000]
        for a, b in zip(cuts, cuts[1:]):
            out.append(scan.scan(x[a:b], state))
            state = scan.after(state, scan.summary(x[a:b]))
        for k in range(4):
            np.testing.assert_allclose(np.concatenate([o[k] for o in out]), whole[k], rtol=1e-6, atol=1e-9)


def test_windows_and_shifts_longer_than_a_range(spark, monkeypatch):
    f = Frame.of(spark.range(200).select("id", (F.col("id") * 2.0).alias("v")).repartition(3), "id")
    got = window.rolling(f, 70, {"s": ("v", "sum")}, block=20).df.orderBy(POS).collect()
    assert [r.s for r in got] == [sum(2.0 * k for k in range(a, a + 70)) for a in range(131)]
    for far in (True, False):
        monkeypatch.setattr(window, "HALO", 0 if far else 1000)
        for periods in (3, 150, -90, 500):
            out = window.shift(f, {"v": "s"}, periods, -1.0, block=20).df.orderBy(POS).collect()
            assert [r.s for r in out] == [2.0 * (k - periods) if 0 <= k - periods < 200 else -1.0 for k in range(200)]
    both = align.concat_rows([f, f])
    mean = window.rolling_apply(both, 2, lambda p: p["v"].mean(), block=30).df.orderBy(POS).collect()
    assert [r.value for r in mean] == [(a + b) / 2 for a, b in zip([*range(0, 400, 2), *range(0, 400, 2)], [*range(2, 400, 2), *range(0, 400, 2)])]


def test_aggregates_without_gathering(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, k % 3, rng.choice([1, 1, 1, -1, 2]) if k < 60 else 1, None if k % 7 == 0 else rng.random()) for k in range(500)]
    f = Frame.of(spark.createDataFrame(rows, "k long, g int, n long, x double"), "k")
    monkeypatch.setattr(aggregate, "LIST", 4)
    assert aggregate.integer_product(f, "n").first().n == math.prod(r[2] for r in rows)
    assert {r.key: r.n for r in aggregate.group_by(f, "g").product("n", True).collect()} == {g: math.prod(r[2] for r in rows if r[1] == g) for g in range(3)}
    x = pd.Series([r[3] for r in rows], dtype=float)
    wanted = {f"{how}{k}": (q, how) for how in ("linear", "lower", "higher", "nearest", "midpoint") for k, q in enumerate((0.0, 0.31, 0.5, 1.0))}
    got = aggregate.exact_quantiles(f, "x", wanted).first()
    assert all(got[n] == pytest.approx(x.quantile(q, how)) for n, (q, how) in wanted.items())
    assert aggregate.exact_quantiles(Frame(f.df.limit(0)), "x", {"m": (0.5, "linear")}).first().m is None
    small, large = (aggregate.describe(f[["n", "x"]], different=d).orderBy("column").collect() for d in (1000, 0))
    for a, b in zip(small, large):
        assert a.column == b.column and list(a)[1:] == pytest.approx(list(b)[1:])
    assert small[1].p50 == pytest.approx(x.median()) and small[1].nunique == x.nunique()
    y = pd.Series([r[2] for r in rows])
    assert aggregate.correlation(f, "x", "n", "spearman").first().corr == pytest.approx(x.rank().corr(y[x.notna()].rank()))


def test_chunks_that_combine_hold_no_group(spark):
    f = Frame.of(spark.createDataFrame([(k, None if k % 5 == 0 else k % 2, k * 7 % 300) for k in range(300)], "k long, g long, v long"), "k")

    def chunk(p):
        assert len(p) < 100, "a group in one call"
        return pd.DataFrame({"first": [p["v"].iloc[0]], "n": [len(p)]})

    def combine(p):
        return pd.DataFrame({"first": [p["first"].iloc[0]], "n": [p["n"].sum()]})

    got = aggregate.group_by(f, "g").apply_chunk(chunk, "first long, n long", combine, block=30).collect()
    assert sorted(map(tuple, got)) == [(0, 60), (7, 120), (14, 120)]


def test_rows_keep_longs_and_digests(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    f = Frame.from_columns(spark, {"a": [9007199254740993, 3], "b": [0, 5]})
    assert [r["sum"] for r in aggregate.per_row(f, "sum").df.orderBy(POS).collect()] == [9007199254740993, 8]
    assert [r["product"] for r in aggregate.per_row(f, "product").df.orderBy(POS).collect()] == [0, 15]
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8):
        values = [rng.random() for _ in range(n)]
        g = Frame.from_columns(spark, {f"c{k}": [v] for k, v in enumerate(values)})
        for q in (0.0, 0.25, 0.4, 0.5, 0.9, 1.0):
            assert aggregate.per_row(g, "tdigest", q=q).df.first().tdigest == pytest.approx(pc.tdigest(pa.array(values), q=q)[0].as_py())


def test_scalars_as_values():
    assert math.isnan(as_value(None, "double")) and as_value(3.0, "bigint") == 3 and as_value(1, "string") == "1"
    for value, kind in ((None, "string"), (None, "bigint"), (2.5, "int")):
        with pytest.raises(ValueError):
            as_value(value, kind)


def test_upper_case_is_one_character_for_one(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    from tidemark.functions import strings

    text = "".join(chr(c) for c in range(0x20, 0x600)) + "ﬁﬀẖᾳᾶ😀"
    got = spark.createDataFrame([(text,)], "x string").select(strings.utf8_upper(F.col("x"))).first()[0]
    want = pc.utf8_upper(pa.array([text]))[0].as_py()
    assert len(got) == len(text) and [(a, b, w) for a, b, w in zip(text, got, want) if b != w] == []

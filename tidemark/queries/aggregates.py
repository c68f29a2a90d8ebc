"""Aggregates of columns, cells, rows and groups (survey rows A, X, G, Y)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import IDX, POS, Frame, Series
from ..operators import aggregate as a
from ..operators import udf
from .base import EV, event_frame, query, table

c = F.col


def frame(spark, sf_dir) -> Frame:
    return event_frame(spark, sf_dir, "v", "user_id", "event_type", index="event_id")


def items(spark, sf_dir, *columns: str) -> Frame:
    df = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), *columns)
    return Frame.of(df, "k")


@query("a01_a06_sum_mean_count", f"SELECT round(sum(v), 4) AS sum, round(avg(v), 6) AS mean, count(v) AS count, count(*) - count(v) AS count_na, CAST(sum(user_id) AS BIGINT) AS isum FROM {EV}")
def a01(spark, sf_dir):
    out = a.agg(frame(spark, sf_dir), {"sum": ("v", "sum"), "mean": ("v", "mean"), "count": ("v", "count"), "count_na": ("v", "count_na"), "isum": ("user_id", "sum")})
    return out.select(F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), "count", "count_na", "isum")


@query("a03_a04_min_max", f"SELECT min(v) AS low, max(v) AS high FROM {EV}")
def a03(spark, sf_dir):
    return a.agg(frame(spark, sf_dir), {"m": ("v", "min_max")}).select(c("m.min").alias("low"), c("m.max").alias("high"))


@query("a05_product", "SELECT r_regionkey // 3 AS key, CAST(product(r_regionkey + 2) AS BIGINT) AS p, product(r_regionkey + 0.5) AS f FROM region GROUP BY 1")
def a05(spark, sf_dir):
    df = table(spark, sf_dir, "region").select("r_regionkey", (c("r_regionkey") / 3).cast("int").alias("k"), (c("r_regionkey") + 2).alias("p"), (c("r_regionkey") + 0.5).alias("f"))
    by = a.group_by(Frame.of(df, "r_regionkey"), "k")
    return by.product("p", True).join(by.product("f", False), "key")


@query("a07_nunique", f"SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM {EV}")
def a07(spark, sf_dir):
    return a.agg(frame(spark, sf_dir), {"users": ("user_id", "nunique"), "kinds": ("event_type", "nunique")})


@query("a08_std_var", f"SELECT round(stddev_samp(v), 6) AS s1, round(var_samp(v), 4) AS v1, round(stddev_pop(v), 6) AS s0, round(var_pop(v), 4) AS v0, round(var_pop(v) * count(v) / (count(v) - 2), 4) AS v2 FROM {EV}")
def a08(spark, sf_dir):
    x = c("v")
    return frame(spark, sf_dir).df.agg(F.round(a.deviation(x), 6).alias("s1"), F.round(a.variance(x), 4).alias("v1"), F.round(a.deviation(x, 0), 6).alias("s0"), F.round(a.variance(x, 0), 4).alias("v0"), F.round(a.variance(x, 2), 4).alias("v2"))


@query("a09_median", f"SELECT round(median(v), 6) AS m FROM {EV}")
def a09(spark, sf_dir):
    return a.exact_quantiles(frame(spark, sf_dir), "v", {"m": (0.5, "linear")}).select(F.round("m", 6).alias("m"))


RANKED = f"(SELECT list_sort(list(v) FILTER (v IS NOT NULL)) AS l, (count(v) - 1) * 0.3 AS r FROM {EV})"


@query("a10_quantile", f"SELECT round((SELECT quantile_cont(v, 0.3) FROM {EV}), 6) AS linear, l[CAST(floor(r) AS BIGINT) + 1] AS lower, l[CAST(ceil(r) AS BIGINT) + 1] AS higher, l[CAST(round_even(r, 0) AS BIGINT) + 1] AS nearest, (l[CAST(floor(r) AS BIGINT) + 1] + l[CAST(ceil(r) AS BIGINT) + 1]) / 2 AS midpoint FROM {RANKED}")
def a10(spark, sf_dir):
    kinds = ("linear", "lower", "higher", "nearest", "midpoint")
    out = a.exact_quantiles(frame(spark, sf_dir), "v", {k: (0.3, k) for k in kinds})
    return out.withColumn("linear", F.round("linear", 6))


@query("a11_tdigest", f"SELECT quantile_disc(v, 0.5) AS m FROM {EV}")
def a11(spark, sf_dir):
    return a.agg(frame(spark, sf_dir), {"m": ("v", "tdigest")})


@query("a12_mode", f"SELECT user_id AS mode, count(*) AS count FROM {EV} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def a12(spark, sf_dir):
    return a.top_modes(frame(spark, sf_dir), "user_id", 5)


@query("a13_a14_first_last", f"SELECT arg_min(v, event_id) FILTER (v IS NOT NULL) AS first, arg_max(v, event_id) FILTER (v IS NOT NULL) AS last, (SELECT v FROM {EV} ORDER BY event_id LIMIT 1) AS first_any FROM {EV}")
def a13(spark, sf_dir):
    out = a.agg(frame(spark, sf_dir), {"b": ("v", "first_last")}).select(c("b.first").alias("first"), c("b.last").alias("last"))
    any_first = frame(spark, sf_dir).df.agg(a.first(c("v"), c(POS), False).alias("first_any"))
    return out.withColumn("first_any", any_first.scalar())


@query("a15_all_any", f"SELECT bool_and(v > 0) AS pos, bool_or(v > 490) AS big, bool_and(v > 10) AS ten FROM {EV}")
def a15(spark, sf_dir):
    f = Frame(frame(spark, sf_dir).df.select(IDX, POS, (c("v") > 0).alias("p"), (c("v") > 490).alias("b"), (c("v") > 10).alias("t")))
    return a.agg(f, {"pos": ("p", "all"), "big": ("b", "any"), "ten": ("t", "all")})


@query("a16_agg_by_name_with_nulls", f"SELECT CAST(NULL AS DOUBLE) AS v, CAST(max(user_id) AS BIGINT) AS u FROM {EV}")
def a16(spark, sf_dir):
    return a.agg(frame(spark, sf_dir), {"v": ("v", "mean"), "u": ("user_id", "max")}, skip_nulls=False)


@query("a17_a18_index_and_extremes", f"WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM {EV}) SELECT (SELECT coalesce(min(p), -1) FROM e WHERE user_id = 8) AS at, (SELECT p FROM e WHERE v IS NOT NULL ORDER BY v, p LIMIT 1) AS argmin, (SELECT p FROM e WHERE v IS NOT NULL ORDER BY v DESC, p LIMIT 1) AS argmax, (SELECT event_id FROM e WHERE v IS NOT NULL ORDER BY v, p LIMIT 1) AS idxmin, (SELECT event_id FROM e WHERE v IS NOT NULL ORDER BY v DESC, p LIMIT 1) AS idxmax")
def a17(spark, sf_dir):
    f = frame(spark, sf_dir)
    return a.arg_extremes(f, "v").withColumn("at", a.index_of(f, "user_id", 8).scalar())


@query("a19_describe", "SELECT 'q' AS \"column\", count(q) AS count, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS std, min(q) AS min, count(DISTINCT q) AS nunique, quantile_cont(q, 0.25) AS p25, quantile_cont(q, 0.5) AS p50, quantile_cont(q, 0.75) AS p75, max(q) AS max FROM (SELECT l_quantity AS q FROM lineitem) UNION ALL SELECT 't', count(q), round(avg(q), 6), round(stddev_samp(q), 6), min(q), count(DISTINCT q), round(quantile_cont(q, 0.25), 6), round(quantile_cont(q, 0.5), 6), round(quantile_cont(q, 0.75), 6), max(q) FROM (SELECT l_tax AS q FROM lineitem)")
def a19(spark, sf_dir):
    f = items(spark, sf_dir, c("l_quantity").alias("q"), c("l_tax").alias("t"))
    return a.describe(f).select("column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "nunique", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")], "max")


@query("a20_value_counts", "SELECT p_type AS \"values\", count(*) AS counts, min(p_partkey) AS place FROM part GROUP BY 1")
def a20(spark, sf_dir):
    return a.value_counts(Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey"), "p_type")


@query("a21_unique", "SELECT count(*) = count(DISTINCT p_partkey) AS keys, count(*) = count(DISTINCT p_type) AS kinds FROM part")
def a21(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey", keep=True)
    return a.is_unique(f, "p_partkey").select(c("is_unique").alias("keys")).withColumn("kinds", a.is_unique(f, "p_type").scalar())


@query("a22_dictionary_encode", "WITH f AS (SELECT p_type, min(p_partkey) AS m FROM part GROUP BY 1), k AS (SELECT p_type, row_number() OVER (ORDER BY m) - 1 AS code FROM f) SELECT p_partkey AS \"index\", p_type, code FROM part JOIN k USING (p_type)")
def a22(spark, sf_dir):
    return a.dictionary_encode(Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey"), "p_type").to_df().select("index", "p_type", "code")


@query("a23_cov", "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS c1, round(covar_pop(l_quantity, l_tax), 8) AS c0 FROM lineitem")
def a23(spark, sf_dir):
    f = items(spark, sf_dir, "l_quantity", "l_extendedprice", "l_tax")
    return f.df.agg(F.round(a.covariance(f, "l_quantity", "l_extendedprice"), 2).alias("c1"), F.round(a.covariance(f, "l_quantity", "l_tax", 0), 8).alias("c0"))


@query("a24_corr", "WITH r AS (SELECT l_quantity, l_extendedprice, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(l_quantity, l_extendedprice), 8) AS pearson, round(corr(a, b), 8) AS spearman FROM r")
def a24(spark, sf_dir):
    f = items(spark, sf_dir, "l_quantity", "l_extendedprice")
    spearman = a.correlation(f, "l_quantity", "l_extendedprice", "spearman").select(F.round("corr", 8))
    return a.correlation(f, "l_quantity", "l_extendedprice").select(F.round("corr", 8).alias("pearson")).withColumn("spearman", spearman.scalar())


@query("frame_cells", "SELECT round(sum(q) + sum(t), 2) AS total, count(*) * 2 AS count, max(greatest(q, t)) AS max FROM (SELECT l_quantity AS q, l_tax AS t FROM lineitem)")
def frame_cells(spark, sf_dir):
    f = items(spark, sf_dir, "l_quantity", "l_tax")
    out = a.agg_cells(f, ["count", "max"])
    return out.withColumn("total", f.df.agg(F.round(a.sum_cells(f), 2).alias("t")).scalar())


# ------------------------------------------------------------------- by axis

COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CELLS = "[l_quantity, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END, l_tax]"
NN = f"list_filter({CELLS}, lambda z: z IS NOT NULL)"


def rows(spark, sf_dir) -> Frame:
    return items(spark, sf_dir, "l_quantity", "l_extendedprice", F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END").alias("l_discount"), "l_tax")


for _how, _sql in {"median": f"list_aggregate({NN}, 'median')", "count": f"CAST(len({NN}) AS BIGINT)", "count_na": f"CAST(4 - len({NN}) AS BIGINT)", "nunique": f"CAST(len(list_distinct({NN})) AS BIGINT)", "first": "l_quantity", "last": "l_tax", "max": f"list_max({NN})", "min": f"list_min({NN})", "mean": f"list_avg({NN})", "sum": f"list_sum({NN})", "product": f"list_aggregate({NN}, 'product')", "std": f"list_aggregate({NN}, 'stddev_samp')", "var": f"list_aggregate({NN}, 'var_samp')", "quantile": f"list_aggregate({NN}, 'quantile_cont', 0.25)"}.items():
    _round = _how in ("median", "mean", "sum", "product", "std", "var", "quantile")

    @query(f"x_rows_{_how}", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {f'round({_sql}, {6 if _how == "product" else 4})' if _round else _sql} AS y FROM lineitem")
    def x_rows(spark, sf_dir, how=_how, rounded=_round):
        out = a.per_row(rows(spark, sf_dir), how, "y", q=0.25)
        return out.to_df("k").select("k.*", (F.round("y", 6 if how == "product" else 4) if rounded else c("y")).alias("y"))


@query("x_columns_numeric", "SELECT c AS \"column\", round(CAST(sum(v) AS DOUBLE), 2) AS sum, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, count(v) AS count, count(*) - count(v) AS na, count(DISTINCT v) AS nunique, round(var_samp(v), 4) AS var, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c, unnest(" + CELLS + ") AS v FROM lineitem) GROUP BY 1")
def x_columns(spark, sf_dir):
    f = rows(spark, sf_dir)
    out = None
    for name, how, digits in (("sum", "sum", 2), ("mean", "mean", 6), ("min", "min", None), ("max", "max", None), ("count", "count", None), ("na", "count_na", None), ("nunique", "nunique", None), ("var", "var", 4), ("median", "median", 6), ("q", "quantile", 6)):
        part = a.per_column(f, how, q=0.25).select("column", (F.round("value", digits) if digits else c("value")).alias(name))
        out = part if out is None else out.join(part, "column")  # four rows each
    return out


@query("x_rows_tdigest", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN len(z) * 0.25 <= 1 THEN z[1] WHEN len(z) * 0.25 >= len(z) - 1 THEN z[len(z)] ELSE z[CAST(floor(len(z) * 0.25) AS BIGINT) + 1] END AS low, CASE WHEN len(z) % 2 = 0 THEN (z[len(z) // 2] + z[len(z) // 2 + 1]) / 2 ELSE z[len(z) // 2 + 1] END AS middle FROM (SELECT *, list_sort({NN}) AS z FROM lineitem)")
def x_rows_tdigest(spark, sf_dir):
    f = rows(spark, sf_dir)
    both = Frame(a.per_row(f, "tdigest", "low", q=0.25).df.join(a.per_row(f, "tdigest", "middle").df.select(IDX, "middle"), IDX))
    return both.to_df("k").select("k.*", "low", "middle")


@query("x_columns_tdigest", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS \"column\", true AS near")
def x_columns_tdigest(spark, sf_dir):
    """Approximate medians, held against exact quantiles a ten-thousandth of the rows before and after."""
    f = rows(spark, sf_dir)
    found = a.per_column(f, "tdigest")
    low, high = (a.per_column(f, "quantile", q=q).withColumnRenamed("value", n) for q, n in ((0.4999, "low"), (0.5001, "high")))
    return found.join(low, "column").join(high, "column").select("column", c("value").between(c("low"), c("high")).alias("near"))


@query("x_columns_logical", "SELECT c AS \"column\", bool_and(v) AS every, bool_or(v) AS any FROM (SELECT unnest(['a', 'b']) AS c, unnest([l_quantity > 0, l_tax > 0.07]) AS v FROM lineitem) GROUP BY 1")
def x_logical(spark, sf_dir):
    f = items(spark, sf_dir, (c("l_quantity") > 0).alias("a"), (c("l_tax") > 0.07).alias("b"))
    every, some = a.per_column(f, "all").withColumnRenamed("value", "every"), a.per_column(f, "any").withColumnRenamed("value", "any")
    return every.join(some, "column")


@query("x_rows_logical", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > 25 AND l_tax > 0.02 AS every, l_quantity > 25 OR l_tax > 0.02 AS any FROM lineitem")
def x_rows_logical(spark, sf_dir):
    f = items(spark, sf_dir, (c("l_quantity") > 25).alias("a"), (c("l_tax") > 0.02).alias("b"))
    both = Frame(a.per_row(f, "all", "every").df.join(a.per_row(f, "any", "any").df.select(IDX, "any"), IDX))
    return both.to_df("k").select("k.*", "every", "any")


# ------------------------------------------------------------------- by group

for _how, _sql in {"mean": "round(avg(v), 6)", "median": "round(median(v), 6)", "std": "round(stddev_pop(v), 6)", "var": "round(var_pop(v), 4)", "count": "count(v)", "nunique": "count(DISTINCT v)", "max": "max(v)", "min": "min(v)", "sum": "round(sum(v), 4)", "first": "arg_min(coalesce(v, -1), event_id)", "last": "arg_max(coalesce(v, -1), event_id)", "tdigest": "quantile_disc(v, 0.5)"}.items():
    _digits = {"mean": 6, "median": 6, "std": 6, "var": 4, "sum": 4}.get(_how)

    @query(f"g_{_how}", f"SELECT event_type AS key, {_sql} AS y FROM {EV} GROUP BY 1")
    def g(spark, sf_dir, how=_how, digits=_digits):
        out = a.group_by(frame(spark, sf_dir), "event_type").agg({"y": ("v", how)})
        if how in ("first", "last"):
            return out.select("key", F.coalesce("y", F.lit(-1.0)).alias("y"))
        return out.select("key", (F.round("y", digits) if digits else c("y")).alias("y"))


@query("g06_all_any", f"SELECT event_type AS key, bool_and(v > 1) AS every, bool_or(v > 480) AS any FROM {EV} GROUP BY 1")
def g06(spark, sf_dir):
    f = Frame(frame(spark, sf_dir).df.withColumn("p", c("v") > 1).withColumn("q", c("v") > 480))
    return a.group_by(f, "event_type").agg({"every": ("p", "all"), "any": ("q", "any")})


@query("g08_product", "SELECT r_regionkey % 2 AS key, CAST(product(r_regionkey + 1) AS BIGINT) AS p FROM region GROUP BY 1")
def g08(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "region").select("r_regionkey", (c("r_regionkey") % 2).alias("k"), (c("r_regionkey") + 1).alias("p")), "r_regionkey")
    return a.group_by(f, "k").product("p", True)


@query("g09_min_max", f"SELECT user_id AS key, min(v) AS v_min, max(v) AS v_max FROM {EV} GROUP BY 1")
def g09(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "user_id").min_max(["v"])


@query("g12_mode", f"WITH n AS (SELECT event_type, user_id, count(*) AS k FROM {EV} GROUP BY 1, 2) SELECT event_type AS key, user_id AS y FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC, user_id) AS r FROM n) WHERE r = 1")
def g12(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "event_type").agg({"y": ("user_id", "mode")})


@query("g13_quantile", f"SELECT event_type AS key, round(quantile_cont(v, 0.9), 6) AS v, quantile_cont(user_id, 0.25) AS user_id FROM {EV} GROUP BY 1")
def g13(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "event_type").quantile({"v": 0.9, "user_id": 0.25}).select("key", F.round("v", 6).alias("v"), "user_id")


@query("g14_g18_apply_to_scalar", f"SELECT event_type AS key, round(sum(v * user_id), 2) AS value FROM {EV} GROUP BY 1")
def g14(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "event_type").apply_scalar(lambda p: float((p["v"] * p["user_id"]).sum())).select("key", F.round("value", 2).alias("value"))


@query("g15_apply_to_array", f"SELECT event_id AS \"index\", round(v - avg(v) OVER (PARTITION BY event_type), 4) AS value FROM {EV}")
def g15(spark, sf_dir):
    out = a.group_by(frame(spark, sf_dir), "event_type").apply_array(lambda p: (p["v"] - p["v"].mean()).tolist())
    return out.to_df().select("index", F.when(~F.isnan("value"), F.round("value", 4)).alias("value"))


@query("g16_apply_chunk", f"SELECT event_type, max(user_id) AS top, count(*) AS n FROM {EV} GROUP BY 1")
def g16(spark, sf_dir):
    def chunk(p):
        return p.groupby("event_type", as_index=False).agg(top=("user_id", "max"), n=("user_id", "size"))

    def combine(p):
        return p.groupby("event_type", as_index=False).agg(top=("top", "max"), n=("n", "sum"))

    return a.group_by(frame(spark, sf_dir), "event_type").apply_chunk(chunk, "event_type string, top long, n long", combine)


@query("g17_g19_apply_to_columns", f"SELECT event_type AS key, round(sum(v), 2) AS v, CAST(sum(user_id) AS DOUBLE) AS user_id FROM {EV} GROUP BY 1")
def g17(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "event_type").apply_columns(lambda s: s.sum(), ["v", "user_id"]).select("key", F.round("v", 2).alias("v"), "user_id")


@query("g20_groups", f"SELECT event_type AS key, count(*) AS size, min(event_id) AS place FROM {EV} GROUP BY 1")
def g20(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "event_type").sizes()


@query("g20_one_group", f"SELECT event_id AS \"index\", v FROM {EV} WHERE event_type = 'click'")
def g20_one(spark, sf_dir):
    return a.group_by(frame(spark, sf_dir), "event_type").group("click")[["v"]].to_df()


@query("g_by_expression", f"SELECT event_type = 'click' AS key, count(*) AS n FROM {EV} GROUP BY 1")
def g_expression(spark, sf_dir):
    f = frame(spark, sf_dir)
    return a.group_by(f, c("event_type") == "click").agg({"n": ("user_id", "count")})


# ------------------------------------------------------------- user functions


@query("y01_map", f"SELECT event_id AS \"index\", v * v AS v FROM {EV}")
def y01(spark, sf_dir):
    return udf.map_series(frame(spark, sf_dir)["v"], lambda x: x * x, "double").to_frame().to_df()


@query("y02_map_frame", f"SELECT event_id AS \"index\", user_id + 1.0 AS user_id, v + 1.0 AS v FROM {EV}")
def y02(spark, sf_dir):
    return udf.map_frame(frame(spark, sf_dir)[["v", "user_id"]], lambda x: x + 1.0, "double").to_df()


@query("y03_apply_with_arguments", f"SELECT event_id AS \"index\", (v + 2) * (v + 2) AS v FROM {EV}")
def y03(spark, sf_dir):
    return udf.map_series(frame(spark, sf_dir)["v"], lambda x, k: (x + k) * (x + k), "double", 2).to_frame().to_df()


@query("f18_filter_by_function", f"SELECT event_id AS \"index\", user_id FROM {EV} WHERE user_id % 10 = 3")
def f18(spark, sf_dir):
    f = frame(spark, sf_dir)
    return udf.filter_rows(Series(f, c("user_id"), "user_id"), lambda u: u % 10 == 3)[["user_id"]].to_df()

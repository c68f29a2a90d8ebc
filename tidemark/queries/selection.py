"""Projection, rows by position and label, masks, sorts (survey rows P, F1-F25, O)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..frame import IDX, POS, Frame
from ..operators import select as s
from ..operators import sort as o
from .base import EV, event_frame, query, table

c = F.col


def parts(spark, sf_dir, *columns: str) -> Frame:
    return Frame.of(table(spark, sf_dir, "part").select("p_partkey", *columns), "p_partkey")


def numbered(spark, sf_dir, *columns: str) -> Frame:
    return event_frame(spark, sf_dir, *columns, index="event_id")


@query("p01_p02_columns", "SELECT p_partkey AS \"index\", p_size, p_name FROM part")
def p01(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_size", "p_type")[["p_size", "p_name"]].to_df()


@query("p03_row_by_label", "SELECT p_partkey AS \"index\", p_name FROM part WHERE p_partkey = 17")
def p03(spark, sf_dir):
    return s.by_label(parts(spark, sf_dir, "p_name"), 17).to_df()


@query("p04_row_by_position", "SELECT p_partkey AS \"index\", p_name, p_size FROM part ORDER BY p_partkey LIMIT 1 OFFSET 41")
def p04(spark, sf_dir):
    return s.row(parts(spark, sf_dir, "p_size", "p_name"), 41).to_df()


@query("p05_at", "SELECT (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1 OFFSET 5) AS a, (SELECT p_size FROM part ORDER BY p_partkey LIMIT 1 OFFSET 7) AS b")
def p05(spark, sf_dir):
    f = parts(spark, sf_dir, "p_name", "p_size")
    return spark.range(1).select(F.lit(s.at(f, 5, "p_name")).alias("a"), F.lit(s.at(f, 7, 1)).cast("int").alias("b"))


@query("p06_rename", "SELECT p_partkey AS \"index\", p_name AS name, p_size FROM part")
def p06(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_size").rename({"p_name": "name"}).to_df()


@query("p07_p08_prefix_suffix", "SELECT p_partkey AS \"index\", p_name AS x_p_name_y, p_size AS p_size_y FROM part")
def p07(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_size").add_prefix("x_", ["p_size"]).add_suffix("_y").to_df()


@query("p09_set_columns", "SELECT p_partkey AS \"index\", p_name AS p_size, p_size AS p_name FROM part")
def p09(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_size").set_columns(["p_size", "p_name"]).to_df()


@query("p10_add_column", "SELECT p_partkey AS \"index\", p_size * 2 AS p_size, p_size + 1 AS n FROM part")
def p10(spark, sf_dir):
    f = parts(spark, sf_dir, "p_size")
    return f.add_column("n", f["p_size"] + 1).add_column("p_size", c("p_size") * 2).to_df()


@query("p10_paste_column", "SELECT p_partkey AS \"index\", p_size, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) USING (r)")
def p10_paste(spark, sf_dir):
    other = Frame.of(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    return parts(spark, sf_dir, "p_size").add_column("s_acctbal", other["s_acctbal"]).to_df()


@query("p11_drop", "SELECT p_partkey AS \"index\", p_size FROM part")
def p11(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_size").drop("p_name", "unknown").to_df()


@query("p12_p13_shape", "SELECT true AS has, false AS hasnt, count(*) AS n, CAST(2 AS BIGINT) AS k, 'string' AS kind FROM part")
def p13(spark, sf_dir):
    f = parts(spark, sf_dir, "p_name", "p_size")
    return f.df.agg(F.lit(f.contains("p_name")).alias("has"), F.lit(f.contains("x")).alias("hasnt"), F.count("*").alias("n"), F.lit(len(f.columns)).cast("long").alias("k"), F.lit(f.dtypes["p_name"]).alias("kind"))


@query("p14_series_facts", "SELECT count(*) AS size, count(*) = 0 AS empty, count(*) * 8 AS prices, CAST(sum(strlen(p_name)) + 4 * count(*) + 4 AS BIGINT) AS names, 'double' AS kind FROM part")
def p14(spark, sf_dir):
    f = parts(spark, sf_dir, "p_name", "p_retailprice")
    price, name = f["p_retailprice"], f["p_name"]
    return f.df.agg(F.lit(price.size()).alias("size"), F.lit(price.empty()).alias("empty"), price.nbytes().alias("prices"), name.nbytes().alias("names"), F.lit(price.dtype.simpleString()).alias("kind"))


@query("p15_set_index", "SELECT p_name AS \"index\", p_size FROM part")
def p15(spark, sf_dir):
    return parts(spark, sf_dir, "p_name", "p_size").set_index("p_name").to_df()


@query("p16_reset_index", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS \"index\", ts, v FROM {EV} WHERE user_id < 50")
def p16(spark, sf_dir):
    f = event_frame(spark, sf_dir, "v", "user_id")
    return s.where(f, f["user_id"] < 50)[["v"]].reset_index("ts").to_df()


@query("p17_index", "SELECT p_partkey AS \"index\" FROM part")
def p17(spark, sf_dir):
    return parts(spark, sf_dir, "p_name").index().withColumnRenamed(IDX, "index")


@query("p18_p19_normalized_index", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS \"index\", v FROM {EV}")
def p19(spark, sf_dir):
    return event_frame(spark, sf_dir, "v").index_as_datetime().normalize_index().to_df()


@query("p20_transpose", "PIVOT (SELECT r_regionkey, unnest(['r_regionkey2', 'r_name']) AS key, unnest([CAST(r_regionkey * 2 AS VARCHAR), r_name]) AS v FROM region) ON r_regionkey IN (0, 1, 2, 3, 4) USING first(v) GROUP BY key")
def p20(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "region").select("r_regionkey", (c("r_regionkey") * 2).alias("r_regionkey2"), "r_name"), "r_regionkey")
    return f.transpose()


@query("p21_unary", "SELECT p_partkey AS \"index\", -p_size AS p_size, -p_retailprice AS p_retailprice FROM part")
def p21(spark, sf_dir):
    return (-parts(spark, sf_dir, "p_size", "p_retailprice")).to_df()


@query("p21_invert", "SELECT p_partkey AS \"index\", ~p_size AS p_size FROM part")
def p21_invert(spark, sf_dir):
    return (~parts(spark, sf_dir, "p_size")).to_df()


@query("p23_equals", "SELECT true AS same, false AS other, true AS near")
def p23(spark, sf_dir):
    f = parts(spark, sf_dir, "p_size", "p_retailprice")
    return spark.range(1).select(F.lit(f.equals(parts(spark, sf_dir, "p_size", "p_retailprice"))).alias("same"), F.lit(f.equals(f + 1)).alias("other"), F.lit(f.approx_equals(f + 1e-12)).alias("near"))


# ------------------------------------------------------------------ filters


@query("f01_where", f"SELECT event_id AS \"index\", v FROM {EV} WHERE v > 100")
def f01(spark, sf_dir):
    f = numbered(spark, sf_dir, "v")
    return f[f["v"] > 100.0].to_df()


@query("f01_where_emit_null", f"SELECT event_id AS \"index\", CASE WHEN v IS NOT NULL THEN user_id END AS user_id FROM {EV} WHERE v > 100 OR v IS NULL")
def f01_emit(spark, sf_dir):
    f = numbered(spark, sf_dir, "v", "user_id")
    return s.where(f, f["v"] > 100.0, emit_null=True)[["user_id"]].to_df()


@query("f02_f03_take", "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part), w AS (SELECT s_nationkey * 3 AS k FROM supplier) SELECT p_partkey AS \"index\", p_name FROM w JOIN p ON r = k")
def f02(spark, sf_dir):
    wanted = Frame.of(table(spark, sf_dir, "supplier").select("s_suppkey", (c("s_nationkey") * 3).alias("at")), "s_suppkey")
    return parts(spark, sf_dir, "p_name")[wanted["at"]].to_df()


COND = "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size > 25 END"


def _cond(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return Frame.of(df.select("p_partkey", F.expr(COND).alias("p_size"), F.expr("p_size > 10").alias("p_retailprice")), "p_partkey")


def _where(name, sql, other):
    @query(name, f"SELECT p_partkey AS \"index\", CASE WHEN ({COND}) IS NULL THEN NULL WHEN {COND} THEN p_size ELSE {sql[0]} END AS p_size, CASE WHEN p_size > 10 THEN p_retailprice ELSE {sql[1]} END AS p_retailprice FROM part")
    def run(spark, sf_dir):
        f = parts(spark, sf_dir, "p_size", "p_retailprice")
        return s.where_else(f, _cond(spark, sf_dir), other(f)).to_df()


_where("f04_where_frame", ("p_size * 10", "p_retailprice * 10"), lambda f: f * 10)
_where("f05_where_series", ("p_size + 1", "p_size + 1"), lambda f: f["p_size"] + 1)
_where("f06_where_scalar", ("42", "42"), lambda f: 42)
_where("f06_where_null", ("NULL", "NULL"), lambda f: None)


@query("f08_f09_slices", "SELECT * FROM (SELECT p_partkey AS \"index\", p_name FROM part ORDER BY p_partkey LIMIT 12 OFFSET 30) UNION ALL SELECT * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 5 OFFSET 2)")
def f08(spark, sf_dir):
    f = parts(spark, sf_dir, "p_name", "p_size")
    return s.slice_rows(f, 30, 42, ["p_name"]).to_df().union(f[-7:-2][["p_name"]].to_df())


LOW, HIGH = datetime(2024, 1, 5, 12), datetime(2024, 1, 20)


@query("f10_f11_time_slice", f"SELECT ts AS \"index\", v FROM {EV} WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def f11(spark, sf_dir):
    return s.between(event_frame(spark, sf_dir, "v"), LOW, HIGH).to_df()


@query("f12_f13_loc", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS \"index\", v FROM {EV} WHERE ts < TIMESTAMP '2024-01-21 00:00:00'")
def f12(spark, sf_dir):
    return s.between(event_frame(spark, sf_dir, "v").normalize_index(), None, HIGH, closed=True).to_df()


@query("f14_label_slice", "SELECT n_name AS \"index\", n_nationkey FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 11 UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_nationkey <= 4")
def f14(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "nation").select("n_name", "n_nationkey", c("n_nationkey").alias("o")), "n_name", ["o"])[["n_nationkey"]]
    return s.label_slice(f, "NATION_3", "NATION_11").to_df().union(s.label_slice(f, None, "NATION_4", closed=True).to_df())


@query("f15_head_tail", "SELECT * FROM (SELECT p_partkey AS \"index\", p_name FROM part ORDER BY p_partkey LIMIT 5) UNION ALL SELECT * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 3)")
def f15(spark, sf_dir):
    f = parts(spark, sf_dir, "p_name")
    return s.head(f).to_df().union(s.tail(f, 3).to_df())


@query("f16_f17_drop_na", f"SELECT event_id AS \"index\", v, user_id FROM {EV} WHERE v IS NOT NULL")
def f16(spark, sf_dir):
    return s.drop_na(numbered(spark, sf_dir, "v", "user_id")).to_df()


@query("f21_is_valid_row", f"SELECT (SELECT v IS NOT NULL FROM {EV} ORDER BY event_id LIMIT 1 OFFSET 14) AS a")
def f21(spark, sf_dir):
    return s.row(numbered(spark, sf_dir, "v"), 14).df.select(c("v").isNotNull().alias("a"))


@query("f22_indices_nonzero", "SELECT p - 1 AS position FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS p FROM part) WHERE p_size % 5 <> 0")
def f22(spark, sf_dir):
    f = parts(spark, sf_dir, "p_size")
    return s.indices_nonzero(f["p_size"].map_expr(lambda x: x % 5)).df.select("position")


@query("f23_coalesce", f"SELECT event_id AS \"index\", coalesce(v, user_id) AS y FROM {EV}")
def f23(spark, sf_dir):
    return s.coalesce(numbered(spark, sf_dir, "v", "user_id"), ["v", "user_id"]).to_frame("y").to_df()


@query("f24_replace_with_mask", f"WITH m AS (SELECT event_id, value, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id < 40 END AS m FROM events), k AS (SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS k FROM m), o AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT event_id AS \"index\", CASE WHEN m IS NULL THEN NULL WHEN m THEN p_retailprice ELSE value END AS value FROM k LEFT JOIN o USING (k)")
def f24(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "events").select("event_id", "value", F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id < 40 END").alias("m")), "event_id")
    return s.replace_with_mask(f["value"], f["m"], parts(spark, sf_dir, "p_retailprice")["p_retailprice"]).to_df()


@query("f25_fill", f"SELECT event_id AS \"index\", last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {EV}")
def f25(spark, sf_dir):
    f = numbered(spark, sf_dir, "v")
    forward, back = s.fill(f).rename({"v": "f"}), s.fill(f, forward=False).rename({"v": "b"})
    return forward.df.join(back.df.select(IDX, "b"), IDX).select(c(IDX).alias("index"), "f", "b")


@query("f25_fill_by_entity", f"SELECT event_id AS \"index\", user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {EV}")
def f25_by(spark, sf_dir):
    return s.fill(numbered(spark, sf_dir, "v", "user_id"), by=["user_id"]).to_df()


# -------------------------------------------------------------------- sorts

_X = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END"


def odd(spark, sf_dir) -> Frame:
    x = F.when(c("event_id") % 7 == 0, F.lit(None)).when(c("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(c("value"))
    return Frame.of(table(spark, sf_dir, "events").select("event_id", x.alias("x"), "user_id"), "event_id")


def _place(direction: str) -> str:
    return f"row_number() OVER (ORDER BY x IS NULL, isnan(x), x {direction}, event_id) - 1"


@query("o01_sort_nulls_last", f"WITH e AS (SELECT event_id, {_X} AS x FROM events) SELECT event_id AS \"index\", {_place('ASC')} AS up, {_place('DESC')} AS down FROM e")
def o01(spark, sf_dir):
    f = odd(spark, sf_dir)
    up, down = (o.ranked(f, ["x"], k).df.select(c(IDX).alias("index"), c(POS).cast("long").alias(n)) for k, n in ((True, "up"), (False, "down")))
    return up.join(down, "index")


@query("o02_o03_argsort", "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part) SELECT row_number() OVER (ORDER BY p_size, p_type, position) - 1 AS place, position FROM p")
def o03(spark, sf_dir):
    return o.argsort(parts(spark, sf_dir, "p_size", "p_type"), ["p_size", "p_type"])


@query("o04_sort_values", "SELECT p_partkey AS \"index\", p_size, p_type, row_number() OVER (ORDER BY p_size DESC, p_type DESC, p_partkey) - 1 AS place FROM part")
def o04(spark, sf_dir):
    return o.ranked(parts(spark, sf_dir, "p_size", "p_type"), ["p_size", "p_type"], False).df.select(c(IDX).alias("index"), "p_size", "p_type", c(POS).cast("long").alias("place"))


@query("o02_argsort_by_time", "WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT position, row_number() OVER (ORDER BY o_orderdate, position) - 1 AS up, row_number() OVER (ORDER BY o_orderdate DESC, position) - 1 AS down FROM o")
def o02_time(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    up, down = (o.argsort(f, ["o_orderdate"], k).withColumnRenamed("place", n) for k, n in ((True, "up"), (False, "down")))
    return up.join(down, "position").select("position", "up", "down")


@query("o05_sort_index_by_time", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS up, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS down FROM events")
def o05_time(spark, sf_dir):
    f = event_frame(spark, sf_dir, "event_id")
    up, down = (o.sort_index(f, k).df.select("event_id", c(POS).cast("long").alias(n)) for k, n in ((True, "up"), (False, "down")))
    return up.join(down, "event_id")


@query("o07_nth_element_by_time", "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT position, o_orderdate AS value FROM o ORDER BY o_orderdate, position LIMIT 1 OFFSET 700")
def o07_time(spark, sf_dir):
    return o.nth_element(Frame.of(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey"), "o_orderdate", 700)


@query("o05_sort_index", "SELECT row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS \"index\", p_partkey FROM part")
def o05(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", ["p_partkey"])
    return o.sort_index(f, ignore_index=True).to_df()


@query("o06_largest_smallest", f"SELECT * FROM (SELECT event_id AS \"index\", v FROM {EV} ORDER BY v DESC NULLS LAST, event_id LIMIT 10) UNION ALL SELECT * FROM (SELECT event_id, v FROM {EV} ORDER BY v NULLS LAST, event_id LIMIT 10)")
def o06(spark, sf_dir):
    f = numbered(spark, sf_dir, "v")
    return o.largest(f, "v", 10).to_df().union(o.smallest(f, "v", 10).to_df())


@query("o07_nth_element", f"WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS position FROM {EV}) SELECT position, v AS value FROM e ORDER BY v NULLS LAST, position LIMIT 1 OFFSET 500")
def o07(spark, sf_dir):
    return o.nth_element(numbered(spark, sf_dir, "v"), "v", 500)

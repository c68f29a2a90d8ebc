import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filters as u
from tidemark.llm.queries import OP2_SQL, op2_url_filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
REF = "try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS bigint)"


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        raw = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(raw) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def sql(spark_dir):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{spark_dir}/{t}.parquet'")
    return con.execute(OP2_SQL).fetchall()


URLS = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.COM/en/1?a#b", "http://example.com/en/2", "http://a.example.com/en", "http://a.example.com/en/3", "ftp://notexample.com/x", "http://x.net/fr/4", "http://x.net/FR/4", "http://net/es/", "http://x.com", "http://x.com?q/5", "a://b://c.net/es/6", "http://x.com:80/7", "http://Ü.net/es/8", "http://x.co.uk/9", "http://bad.org/10", "http://www.bad.org/11", "http://bad.org/12", "http://line\nend.net/fr/x", "http://10.0.0.1/10", "http://99.9.0.1:8080/14", "http://99.9.0.1/14", "http://bad.org./10", "http://localhost/11"]


def tables(spark, folder, labels):
    rows = [(i, x, i, "h") for i, x in enumerate(URLS)] + [(1000 + i, f"http://bad.org/{10 + i % 3}", 0, "") for i in range(300)] + [(None, "http://good.org/13", 0, None)] * 2
    spark.createDataFrame(rows, "page_id long, url string, verdict int, host string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return rows


@pytest.mark.parametrize("labels", [[], [(10, 0, 0), (11, 0, 1), (12, 1, 1), (12, 1, 0), (13, 1, 0), (9, 1, 0), (None, 0, 0), (4, None, None)]])
def test_rules_and_reputation(spark, tmp_path, labels):
    rows = tables(spark, tmp_path, labels)
    got = op2_url_filters(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    urls = dict((r[0], r[1]) for r in rows)
    for r in got:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
        elif host.endswith("bad.org") and labels and host == "bad.org":
            assert r.verdict == "block"
        elif not labels or host == "good.org":
            assert r.verdict == "allow"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(str, con.execute(OP2_SQL).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert sorted(map(tuple, op2_url_filters(spark, sf).collect())) == sorted(sql(sf))


def test_plan_is_native(spark, capsys):
    op2_url_filters(spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow|Cartesian", capsys.readouterr().out)


def test_shrinkage(spark):
    counts = spark.createDataFrame([("a.x.org", 100, 100, 95), ("b.x.org", 1, 0, 0), ("c.y.info", 1, 1, 1), ("d.z.com", 500, 500, 5), ("", 1, 0, 0)], "host string, pages long, n long, bad long")
    got = {r.host: r for r in u.reputations(counts).collect()}
    assert got["a.x.org"].lower > 0.5 > got["c.y.info"].lower and got["d.z.com"].mean < 0.05
    assert got["b.x.org"].mean > got["d.z.com"].mean and all(r.lower < r.mean for r in got.values())
    assert u.strength(counts) < 100 and u.strength(counts.limit(0)) == u.STRONGEST


def test_empty(spark):
    pages, none = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "ref long, bad boolean")
    assert u.filter_urls(pages, none, F.expr(REF)).count() == 0


def test_numbers_last_stops_and_single_labels(spark):
    hosts = ["10.0.0.1", "99.9.0.1:80", "a.b.co.uk.", "localhost", "1.2.3", "x.1.2.3.4", ""]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *u.domains(F.col("host"))).collect()
    assert [tuple(r)[1:] for r in got] == [("10.0.0.1", u.NUMBER), ("99.9.0.1", u.NUMBER), ("b.co.uk", "co.uk"), ("localhost", "localhost"), ("2.3", "3"), ("3.4", "4"), ("", "")]
    own = spark.createDataFrame([("a.b.tv.example",)], "host string").select(*u.domains(F.col("host"), ["tv.example"])).first()
    assert tuple(own) == ("b.tv.example", "tv.example")
    counts = spark.createDataFrame([("10.0.0.1", 90, 90, 90), ("99.9.0.1", 90, 90, 0)], "host string, pages long, n long, bad long")
    rated = {r.host: r.mean for r in u.reputations(counts).collect()}
    assert rated["10.0.0.1"] > 0.5 > rated["99.9.0.1"]

import hashlib

import duckdb

from tidemark.llm.queries import OP9_SQL, op9_warc
from tidemark.llm.store import Workspace
from tidemark.llm.warc import read, records, write

BIG = "é" * 600


def archive(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, header string, address int")
    folder = Workspace(spark).path("archive")
    write(pages, folder)
    return folder, read(spark, folder)


def test_exact_round_trip_and_revisits(spark):
    rows = [(1, "http://a/\r\nWARC-Type: x", BIG, "h", 1), (2, "http://b/", BIG, None, None), (3, None, None, "", 2), (4, "http:// c/", "", "", 2), (5, "u", "small", "", 0), (6, "u", "small", "", 0), (7, "u", "z" * 999, "", 0), (9, "u", "z" * 999, "", 0), (8, "u", BIG + "!", "", 0)]
    folder, got = archive(spark, rows)
    by_id = {r.page_id: r for r in got.collect()}
    assert sorted(by_id) == [r[0] for r in sorted(rows)]
    for page_id, _, html, *_ in rows:
        raw, r = (html or "").encode(), by_id[page_id]
        assert (bytes(r.payload), r.payload_bytes, r.payload_digest) == (raw, len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if page_id == 1 else ("response", None))
    assert by_id[1].target == "http://a/WARC-Type: x" and by_id[4].target == "http:// c/" and by_id[3].target == ""
    whole = {r.page_id: bytes(r.record) for r in records(read(spark, folder)).collect()}
    for page_id, record in whole.items():
        head, body = record.split(b"\r\n\r\n", 1)
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(body) == length + 4 and body.endswith(b"\r\n\r\n")
        assert body[:-4] == (b"" if page_id == 1 else (dict((r[0], r[2]) for r in rows)[page_id] or "").encode())
    assert spark.read.parquet(f"{folder}/payloads").count() == 5  # each payload once


def test_null_and_repeated_ids_and_empty(spark):
    _, got = archive(spark, [(None, "u", BIG, "", 0), (4, "u", BIG, "", 0), (4, "u", BIG, "", 0), (None, "u", "y" * 2000, "", 0)])
    assert sorted(((r.page_id, r.record_type, r.refers_to, len(r.payload)) for r in got.collect()), key=repr) == sorted([(4, "response", None, 1200), (4, "response", None, 1200), (None, "response", None, 2000), (None, "revisit", 4, 1200)], key=repr)
    assert archive(spark, [])[1].count() == 0


def test_damaged_payload_is_not_given(spark):
    folder, _ = archive(spark, [(1, "u", BIG, "", 0)])
    stored = spark.read.parquet(f"{folder}/payloads").collect()
    spark.createDataFrame([(stored[0].address, bytearray(b"other"))], "address string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    row = read(spark, folder).first()
    assert row.payload is None and row.payload_bytes is None


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(OP9_SQL).fetchall()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op9_warc(spark, sf).collect()]
    assert sorted(got) == sorted(want)

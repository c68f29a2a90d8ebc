"""A content-addressed WARC archive.

Writing
    One WARC/1.1 record per row.  Payloads are addressed by a verified strong
    digest: SHA-1 (the WARC-Payload-Digest) together with SHA-256 and the length,
    so rows share a payload only if all three agree.  Of rows with equal
    payloads of at least ``least`` bytes, that with the largest id is the
    response, the others are revisits that refer to it; smaller ones are all
    responses.

    ``headers``: the exact bytes of each record's header block, with the address
    of its payload; ``payloads``: the bytes of each address, once.

Reading
    ``read`` parses the header blocks as they are stored, joins responses with
    payloads, and revisits through the record they refer to, checks the digest
    and gives the exact bytes of each record: headers, a blank line, the payload
    for a response, two line ends.

Scale
    An aggregation over addresses, without payloads, names each payload's
    writer; payload bytes are shuffled once, by id, which no hot payload skews,
    and only a writer's row is kept.  Readers join on the address against one
    row; a payload that a third of all rows share is a skew join there.

Defined results
    A null payload is empty; a null url is an empty target; line ends in a url
    are dropped, since a header is a line.  A null id is written as an empty
    name and read back as null.  All rows of a payload's largest id are
    responses, should that id repeat.  An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 1000
PREFIX = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(column: Column) -> Column:
    return F.coalesce(F.encode(column.cast("string"), "UTF-8"), F.lit(b""))


def _header(kind: str) -> Column:
    """The header block, each line ended by CR LF."""
    lines = ["WARC/1.1", "WARC-Type: " + kind, F.concat(F.lit(f"WARC-Record-ID: <{PREFIX}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")), "WARC-Date: 1970-01-01T00:00:00Z", F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))]
    if kind == "revisit":
        lines += [F.concat(F.lit(f"WARC-Refers-To: <{PREFIX}"), F.col("winner").cast("string"), F.lit(">")), "WARC-Profile: " + REVISIT_PROFILE, "WARC-Truncated: length"]
    length = F.lit("0") if kind == "revisit" else F.col("bytes").cast("string")
    lines += ["Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), length), F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string"))]
    return F.encode(F.concat(*[x if isinstance(x, Column) else F.lit(x) for line in lines for x in (line, "\r\n")]), "UTF-8")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Writes ``folder``/headers and ``folder``/payloads, as zstd Parquet."""
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), _payload(pages[payload_col]).alias("payload"))
    address = [F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes")]
    addressed = rows.select("id", "url", *address)
    addressed.write.option("compression", "zstd").parquet(f"{folder}/addresses")
    addressed = spark.read.schema(addressed.schema).parquet(f"{folder}/addresses")
    winners = addressed.groupBy("sha1", "sha256", "bytes").agg(F.max("id").alias("winner"))
    named = addressed.join(winners, ["sha1", "sha256", "bytes"])
    revisit = (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("winner")) & F.col("winner").isNotNull()
    headers = named.select(F.when(revisit, _header("revisit")).otherwise(_header("response")).alias("header"), F.concat("sha256", F.lit(":"), "sha1").alias("address"))
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")
    slot = F.coalesce("id", F.lit(-(1 << 63)))  # a null id's; the address tells it from that id
    writers = winners.select(F.col("winner").alias("id"), F.concat("sha256", F.lit(":"), "sha1").alias("address")).select(slot.alias("slot"), "address")
    verified = F.concat(F.sha2("payload", 256), F.lit(":"), F.sha1("payload"))
    stored = rows.select(slot.alias("slot"), verified.alias("address"), "payload").join(writers, ["slot", "address"])
    stored = stored.dropDuplicates(["slot", "address"]).select("address", "payload")  # of a repeated id; keeps the join's partitioning
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def _field(name: str) -> Column:
    return F.regexp_extract("text", rf"(?md)^{name}: (.*?)\r?$", 1)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, record_type, target, payload_digest, payload_bytes, refers_to, header, payload.

    All but the bytes of header and payload comes from the stored header blocks;
    a payload is null if its bytes don't have the digest that the header names.
    """
    named = F.regexp_extract(_field("WARC-Record-ID"), r"(-?\d+)>$", 1)
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"(-?\d+)>$", 1)
    parsed = spark.read.parquet(f"{folder}/headers").select("header", "address", F.decode("header", "UTF-8").alias("text"))
    records = parsed.select(
        F.when(named != "", named.cast("long")).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("target"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        _field("X-Payload-Length").cast("long").alias("stated_bytes"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        "header",
        "address",
    )
    checked = spark.read.parquet(f"{folder}/payloads").select("address", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    joined = records.join(checked, "address", "left")
    sound = (F.col("sha1") == F.col("payload_digest")) & (F.col("payload_bytes") == F.col("stated_bytes"))
    return joined.select("page_id", "record_type", "target", "payload_digest", F.when(sound, F.col("payload_bytes")).alias("payload_bytes"), "refers_to", "header", F.when(sound, F.col("payload")).alias("payload"))


def records(archive: DataFrame) -> DataFrame:
    """``archive`` with the exact bytes of each WARC record in place of header and payload."""
    ends = F.encode(F.lit("\r\n"), "UTF-8")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.withColumn("record", F.concat("header", ends, body, ends, ends)).drop("header", "payload")

"""The registered queries of this subpackage: one thin opN_<name> per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its document's label: bad if of low quality or toxic; the path names the document."""
    from pyspark.sql import functions as F

    from .url_filters import filter_urls

    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    outcomes = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("ref")).agg(F.bool_or(bad).alias("bad"))
    reference = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS bigint)")
    return filter_urls(table(spark, sf_dir, "pages"), outcomes, reference)


OP2_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
o AS (SELECT doc_id AS ref, CAST(bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS BIGINT) AS bad
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad
      FROM p LEFT JOIN o ON o.ref = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) GROUP BY host),
b AS (SELECT *, string_split(regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '[.]$', ''), '.') AS l FROM c),
t AS (SELECT *, regexp_full_match(array_to_string(l, '.'), '[0-9]+([.][0-9]+){3}') AS number, array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'or.jp',
             'com.br', 'com.cn', 'com.mx', 'co.in', 'co.nz', 'co.za', 'com.tr', 'com.ar') AS two FROM b),
named AS (SELECT host, n, bad, array_to_string(CASE WHEN number THEN l WHEN two THEN l[-3:] ELSE l[-2:] END, '.') AS domain,
                 CASE WHEN number THEN '(number)' ELSE array_to_string(CASE WHEN two THEN l[-2:] ELSE l[-1:] END, '.') END AS suffix FROM t),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
levels AS (SELECT 'h' AS level, n, bad FROM named UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
m AS (SELECT level, count(*) AS m, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS x, sum(CAST(bad AS DOUBLE) * bad / n) AS xx, CAST(sum(n * n) AS DOUBLE) AS nn
      FROM levels WHERE n > 0 GROUP BY level),
r AS (SELECT level, CASE WHEN x > 0 AND x < n AND n - nn / n > 0
             THEN (xx - x * x / n - (m - 1) * (x / n) * (1 - x / n)) / (n - nn / n) / ((x / n) * (1 - x / n)) ELSE 0 END AS rho FROM m),
k AS (SELECT coalesce(max(CASE WHEN level = 'h' AND rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) END), 1000) AS kh,
             coalesce(max(CASE WHEN level = 'd' AND rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) END), 1000) AS kd,
             coalesce(max(CASE WHEN level = 's' AND rho > 0 THEN least(1000, greatest(1, 1 / rho - 1)) END), 1000) AS ks FROM r),
g AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS rate FROM s),
ps AS (SELECT d.domain, d.n AS nd, d.bad AS bd, (s.bad - d.bad + ks * rate) / (s.n - d.n + ks) AS ps FROM d JOIN s USING (suffix), k, g),
pd AS (SELECT host, n, bad, (bd - bad + kd * ps) / (nd - n + kd) AS pd FROM named JOIN ps USING (domain), k),
ab AS (SELECT host, bad + kh * pd AS a, n - bad + kh * (1 - pd) AS b FROM pd, k),
post AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound FROM ab),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN post USING (host)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import best_fit_sequences

    return best_fit_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each document's bytes are played as 8-bit samples at 8 kHz, whole.

    Frames are 32 ms, since most documents last under half a second; those too
    short for the overlap that a link needs are played again until they have it.
    Queries are the documents whose id is divisible by 50.
    """
    from pyspark.sql import functions as F

    from .audio import Format, search

    form = Format(rate=8000, frame=256, hop=64, bits=8, low=100.0, high=3600.0, least=8)
    media = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    return search(media, "doc_id", "pcm", F.col("doc_id") % 50 == 0, form)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, find

    return digests(find(table(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import DIGESTS, digest_columns, transcribe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return transcribe(docs, path, public_tokenizers.PATTERN, digest_columns, DIGESTS).drop("text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import Workspace
    from .warc import read, write

    folder = Workspace(spark).path("archive")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import perplexities

    return perplexities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM w
"""


def queries() -> dict[str, Query]:
    return {"op1_simhash": op1_simhash, "op2_url_filters": op2_url_filters, "op3_packing": op3_packing, "op4_chroma": op4_chroma, "op5_quality_rules": op5_quality_rules, "op6_pii": op6_pii, "op7_licenses": op7_licenses, "op8_bpe": op8_bpe, "op9_warc": op9_warc, "op10_kneser_ney": op10_kneser_ney}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op9_warc": OP9_SQL}

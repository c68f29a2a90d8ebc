"""URL filters: rules, then empirical-Bayes reputation of hosts.  DataFrame functions only.

Parts of a url
    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end.

Rules
    ``host/path`` allows or blocks its host and all subdomains where the url's
    path starts with the rule's path; the longest fitting rule wins.

Reputation
    Labelled page outcomes (bad or not) are counted per host.  Suffixes are
    shrunk towards the global rate, registered domains towards their suffix, and
    hosts towards their domain, each without its own counts, so that none is
    evidence for itself, by beta-binomial priors whose strengths are
    estimated from the counts of each level (method of moments).  A page is
    blocked where the lower bound of its host's posterior bad rate, ``mean - z *
    deviation``, exceeds ``limit``.

Scale
    Pages are counted by host and reference before labels are joined, so a host
    that holds a third of all rows is one row per reference.  Verdicts return to
    pages by a shuffle join for common hosts; hosts with more than one page in
    ``HOT`` - fewer than ``HOT`` of them, whatever the input - are broadcast.

Defined results
    A null url, or one without ``://``, has an empty host and path; the empty
    host has a reputation like any other.  Pages without labels follow their
    domain's rate; without any labels the global rate is a half, and nothing is
    blocked at a limit of a half or more.  Every row of ``pages`` gives one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LIMIT = 0.5
Z = 1.645
HOT = 1000
WEAKEST, STRONGEST = 1.0, 1000.0
#: Suffixes of two labels under which names are registered.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.nz", "co.za", "com.tr", "com.ar")
#: The suffix of hosts that are four numbers.
NUMBER = "(number)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    url = url.cast("string")
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of columns host and path; null without a fitting rule."""
    names, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        names, verdicts = F.when(fits, F.lit(rule)).otherwise(names), F.when(fits, F.lit(verdict)).otherwise(verdicts)
    return names, verdicts


def domains(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; neither a port nor a last full stop counts.

    An address of four numbers is a domain of its own, under the suffix that all
    of them share; a host of one label is domain and suffix.
    """
    bare = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), "[.]$", "")
    two = F.substring_index(bare, ".", -2)
    number, pair = bare.rlike(r"\A[0-9]+([.][0-9]+){3}\z"), two.isin(*two_labels)
    domain = F.when(number, bare).when(pair, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(number, F.lit(NUMBER)).when(pair, two).otherwise(F.substring_index(bare, ".", -1))


def strength(level: DataFrame) -> float:
    """The beta prior's weight, in pages, from the spread of (n, bad) over groups."""
    total = level.where("n > 0").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("bad").alias("x"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("xx"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not total.m or not 0 < total.x < total.n:
        return STRONGEST
    p = total.x / total.n
    spread = total.xx - total.n * p * p
    free = total.n - total.nn / total.n
    rho = (spread - (total.m - 1) * p * (1 - p)) / free / (p * (1 - p)) if free > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def reputations(counts: DataFrame, *, z: float = Z, two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """``counts`` (host, pages, n, bad) with the posterior's mean and lower bound."""
    named = reduce(lambda df, c: df.withColumn(*c), zip(("domain", "suffix"), domains(F.col("host"), two_labels)), counts)
    by_domain = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = by_suffix.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    ks, kd, kh = strength(by_suffix), strength(by_domain), strength(named)
    rate = (bad + 1.0) / (n + 2.0)
    above = by_suffix.select("suffix", F.col("n").alias("ns"), F.col("bad").alias("bs"))
    of_domain = by_domain.join(above, "suffix").select("domain", F.col("n").alias("nd"), F.col("bad").alias("bd"), ((F.col("bs") - F.col("bad") + ks * rate) / (F.col("ns") - F.col("n") + ks)).alias("ps"))
    pd = (F.col("bd") - F.col("bad") + kd * F.col("ps")) / (F.col("nd") - F.col("n") + kd)
    a = F.col("bad") + kh * F.col("pd")
    b = F.col("n") - F.col("bad") + kh * (1 - F.col("pd"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return named.join(of_domain, "domain").withColumn("pd", pd).select("host", "pages", (a / (a + b)).alias("mean"), (a / (a + b) - z * deviation).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, reference: Column, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, z: float = Z, two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """id_col, host, path, rule and verdict of every row of ``pages``.

    ``outcomes`` has different values of ref, and bad (boolean); ``reference`` is
    the outcome's name, as a column of host and path.
    """
    space = Workspace(pages.sparkSession)
    host, path = url_parts(pages[url_col])
    parsed = pages.select(pages[id_col].alias("__tm_id"), host.alias("host"), path.alias("path"))
    seen = parsed.groupBy("host", reference.alias("ref")).agg(F.count("*").alias("pages"))
    known = outcomes.select(F.col("ref").alias("__tm_ref"), F.col("bad").cast("long").alias("bad"))
    counts = seen.join(known, F.col("ref") == F.col("__tm_ref"), "left").groupBy("host").agg(F.sum("pages").alias("pages"), F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).alias("bad"))
    counts = space.save(counts)
    hosts = space.save(reputations(counts, z=z, two_labels=two_labels))
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = F.col("pages") * HOT > F.lit(total)
    few = F.broadcast(hosts.where(hot).select(F.col("host").alias("__tm_host"), F.col("lower").alias("hot_lower")))  # fewer than HOT rows
    marked = parsed.join(few, F.col("host") == F.col("__tm_host"), "left")
    near = marked.where("__tm_host is not null").withColumnRenamed("hot_lower", "lower")
    far = marked.where("__tm_host is null").drop("hot_lower").join(hosts.where(~hot).select("host", "lower"), "host")
    columns = ["__tm_id", "host", "path", "lower"]
    name, verdict = rule_columns(rules)
    judged = near.select(*columns).union(far.select(*columns)).withColumns({"rule": name, "said": verdict})
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.select(F.col("__tm_id").alias(id_col), "host", "path", "rule", F.coalesce("said", own).alias("verdict"))

"""Registered queries as a whole, against versions of their own."""

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
import xxhash
from pyspark.sql import functions as F
from test_kneser_ney import Brute, grams
from test_quality_rules import brute as brute_counts
from test_simhash import brute as brute_links

from tidemark.llm import kneser_ney as kn
from tidemark.llm import quality_rules as q
from tidemark.llm.queries import op1_simhash, op5_quality_rules, op10_kneser_ney
from tidemark.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_op1(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert sorted(map(tuple, op1_simhash(spark, SF).collect()), key=repr) == brute_links(rows)


def test_op1_with_columns_of_its_own_names(spark):
    docs = table(spark, "documents").limit(80)
    names = ("id", "fp", "comp", "component", "component_id", "fingerprint", "key", "hash", "least", "src", "dst")
    clash = docs.select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted(map(tuple, near_duplicates(clash).collect())) == sorted(map(tuple, near_duplicates(docs).collect()))


def trusted_and_held(spark):
    marks = defaultdict(list)
    for r in table(spark, "labels").collect():
        marks[r.doc_id].append(r.quality == 1 and not r.toxic)
    good = {d for d, m in marks.items() if all(m)}
    ids = spark.createDataFrame([(d,) for d in good], "id long")
    return good, {r.id for r in ids.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(kn.HELD_OUT)) == 0).collect()}


def test_op10(spark):
    docs = table(spark, "documents").collect()
    good, held = trusted_and_held(spark)
    model = Brute([r.text for r in docs if r.doc_id in good - held], kn.ORDER)
    share = {k: {g: (sum(c), sum(model.d[k][min(x, 3)] for x in c)) for g, c in model.after[k].items()} for k in model.after}

    @lru_cache(None)
    def log(gram):
        def p(g):
            k = len(g)
            lower = p(g[1:]) if k > 1 else 1 / (len(model.c[1]) + 1)
            if g[:-1] not in share[k]:
                return lower
            total, spared = share[k][g[:-1]]
            c = model.c[k][g]
            return (c - model.d[k][min(c, 3)] + spared * lower) / total

        return math.log(p(gram))

    mean = {r.doc_id: -sum(map(log, grams(r.text, kn.ORDER))) / (len(r.text or "") + 1) for r in docs}
    slack = {r.doc_id: kn.SPREAD / math.sqrt(len(r.text or "") + 1) for r in docs}
    bins = defaultdict(list)
    for r in docs:
        if r.doc_id in held:
            bins[r.lang].append(math.ceil((mean[r.doc_id] - slack[r.doc_id]) * 1000 - 1e-6))
    cuts = {}
    for lang, values in bins.items():
        values.sort()
        n, center = len(values), sum(values) / len(values)
        spread = math.sqrt(sum((v - center) ** 2 for v in values) / max(n - 1, 1))
        cuts[lang] = (values[math.ceil(kn.QUANTILE * n - 1e-9) - 1] + kn.SURE * spread / math.sqrt(n)) / 1000
    got = {r.doc_id: r for r in op10_kneser_ney(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own, d = got[r.doc_id], r.doc_id
        assert own.lang == r.lang and own.n_chars == len(r.text or "")
        assert math.log(own.perplexity) == pytest.approx(mean[d], abs=1e-5)
        if r.lang not in cuts:
            assert own.kept and own.threshold is None
            continue
        assert math.log(own.threshold) == pytest.approx(cuts[r.lang] + slack[d], abs=3e-3)
        if abs(mean[d] - cuts[r.lang] - slack[d]) > 5e-3:
            assert own.kept == (mean[d] <= cuts[r.lang] + slack[d])


def test_op10_an_id_of_a_third_of_all_rows(spark):
    docs = [(7 if k % 3 == 0 else k, f"{'etaoin shrdlu ' * (k % 5 + 1)}{k}", "en", "", 0) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string, parts int")
    trusted = spark.createDataFrame([(k,) for k in range(0, 300) if k % 2 or k == 7], "id long")
    one, many = (Counter((r.id, r.hash, r.n, r.held, round(r.nll, 4)) for r in kn.score(frame, trusted, order=3, block=b).collect()) for b in (1 << 24, 700))
    assert one == many and sum(one.values()) == 300


def test_op5(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = q.train(docs, labels)
    mask = (1 << 32) - 1

    def chance(text):
        words = [xxhash.xxh32_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        pairs = [((a * 0x9E3779B1 & mask) ^ ((b * 0x85EBCA77 & mask) + 0x27D4EB2F & mask)) * 0xC2B2AE3D & mask for a, b in zip(words, words[1:])]
        c = list(map(ord, text))
        three = [((x * 0x9E3779B1 & mask) ^ (y * 0x85EBCA77 & mask) ^ (z * 0xC2B2AE3D & mask)) * 0x27D4EB2F & mask for x, y, z in zip(c, c[1:], c[2:])]
        raw = sum(sum(int(own[h >> 32 - q.BITS]) for h in hashed) / len(hashed) / q.FIXED for own, hashed in zip(model.weights, (words, pairs, three)) if hashed)
        return 1 / (1 + math.exp(-max(-500, min(500, model.slope * raw + model.offset))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op5_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, chars, symbols, lines, repeats = counts = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = n < 50 or 100 * repeats > 50 * n
        p = chance(texts[r.doc_id] or "")
        assert r.base_failed == failed and r.probability == pytest.approx(p, abs=1e-6)
        if abs(p - q.THRESHOLD) > 1e-6:
            assert r.kept == (not failed and p >= q.THRESHOLD)


def test_op5_learns_from_one_row_of_an_id(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    once, often = q.train(docs, labels), q.train(docs.union(docs).union(docs), labels)
    assert (once.weights == often.weights).all() and (once.slope, once.offset) == (often.slope, often.offset)

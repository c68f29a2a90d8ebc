import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def samples():
    rng = random.Random(4)
    texts = ["", " ", "\n\n", "a", "a a a a", "é\xa0ß x\ny\n\ny\n \ny", "字 " * 90, "# * <&> | $%", "x\r\ny\r\nx\r\n"]
    for n in (5, 40, 60, 300, 3000):
        for kinds in (2, 9, 200):
            texts.append("".join(rng.choice(["w%d", "é%d", "#%d"]) % rng.randrange(kinds) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n)))
    return texts


def test_base_counts_against_brute_force():
    texts = samples()
    got = [b for some in q.groups(texts) for b in q.featurise(some).base]
    assert got == [brute(t) for t in texts]


def test_batches_dont_change_scores(monkeypatch):
    rng = np.random.default_rng(0)
    model = q.Model(rng.integers(-q.FIXED, q.FIXED, (q.FAMILIES, 1 << q.BITS)), 1.0, 0.0)
    texts = samples()
    together = model.raw(q.featurise(texts))
    assert together.tolist() == [model.raw(q.featurise([t]))[0] for t in texts]
    monkeypatch.setattr(q, "GROUP", 10)
    assert [t for some in q.groups(texts) for t in some] == texts


def test_many_kinds_of_words():
    ids = np.array([5, 1 << 21, 7, 5, 1 << 21, 7, 5])
    assert q.repeat_words(ids, (1 << 21) + 1) == q.repeat_words(ids, (1 << 21) - 1) == 7


def test_held_out_accuracy_and_counts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    got = q.score(docs.join(F.broadcast(labels), "doc_id", "left_semi"), q.train(docs, labels.where(fold))).join(labels.where(~fold), "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in got if not r.base_failed)
    assert right >= 0.99 * sum(not r.base_failed for r in got)
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 20 = 0").collect()}
    for r in got:
        if r.doc_id not in texts:
            continue
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


@pytest.mark.parametrize("quality", [[], [1, 1], [None, 2]])
def test_without_both_classes_only_base_rules_reject(spark, quality):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "a", 1.0), (2, None, "b", 2.0), (2, "", "b", 2.0), (None, long, "c", None), (5, long * 2000, "d", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, probability double")
    labels = spark.createDataFrame([(k + 1, x) for k, x in enumerate(quality)], "doc_id long, quality int")
    model = q.train(docs, labels)
    got = sorted(map(str, ((r.doc_id, r.base_failed, r.kept) for r in q.score(docs, model).collect())))
    assert got == sorted(map(str, [(1, False, True), (2, True, False), (2, True, False), (None, False, True), (5, True, False)]))
    kept = q.score(docs, model, keep_docs=True)
    assert kept.columns == docs.columns and sorted(r.kept for r in kept.collect()) == ["a", "c"]
    assert q.score(docs.limit(0), model).count() == 0 and q.score(docs.limit(0), model, keep_docs=True).count() == 0


def test_calibration_of_separable_scores():
    scores, labels = np.array([-9.0, -8.0, 5.0, 6.0, 7.0, 8.0]), np.array([0, 0, 1, 1, 1, 1])
    slope, offset = q.calibrate(scores, labels)
    p = 1 / (1 + np.exp(-(slope * scores + offset)))
    assert (np.round(p) == labels).all() and abs(p[:2].mean() - 0.25) < 0.05 and abs(p[2:].mean() - 5 / 6) < 0.05

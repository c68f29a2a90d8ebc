import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import kneser_ney as kn

DOCS = "doc_id long, text string, lang string, kept string, gram int"


class Brute:
    """Modified Kneser-Ney by the book, over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.c = {order: Counter(g for t in texts for g in grams(t, order))}
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.after = {}, {}
        for k, counts in self.c.items():
            n = Counter(counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            told = [0.0] + [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.0 for i in (1, 2, 3)]
            self.d[k] = [d if 0 < d < i else 0.5 * i for i, d in enumerate(told)]
            self.after[k] = defaultdict(list)
            for g, c in counts.items():
                self.after[k][g[:-1]].append(c)

    def p(self, gram):
        k = len(gram)
        followers = self.after[k].get(gram[:-1])
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.c[1]) + 1)
        if not followers:
            return lower
        c, total = self.c[k][gram], sum(followers)
        return (c - self.d[k][min(c, 3)] + sum(self.d[k][min(x, 3)] for x in followers) * lower) / total


def grams(text, order):
    padded = kn.START * (order - 1) + (text or "").replace("\0", "�") + kn.END
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["good", "good", "bad"])
        alphabet = "etaoin shrdlu" if kind == "good" else "#$%&*XQZ@!"
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400)))
        rows.append((i, text, rng.choice(["en", "de", None]), kind, i))
    return rows


def test_ngrams_against_brute_force(monkeypatch):
    texts = ["", "a", "abcabcabc", "é字😀\0x", "ab" * 50, ""]
    for order in (1, 2, 5):
        kinds, numbers, sizes = kn.ngrams(texts, order)
        want = [g for t in texts for g in grams(t, order)]
        assert [str(kinds[k]) for k in numbers] == want and sizes.tolist() == [len(t) + 1 for t in texts]
        assert len(set(kinds.tolist())) == len(kinds)
    many = ["".join(chr(0x4E00 + i) for i in range(15000))]
    assert [str(g) for g in kn.ngrams(many, 5)[0]] == grams(many[0], 5)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_scores_against_brute_force(spark, order):
    rows = corpus() + [(500, None, "en", "good", 0), (501, "", None, "good", 0), (7, "etaoin twice", "en", "good", 1), (None, "no id", "en", "x", 0), (None, "#", None, "x", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = spark.createDataFrame([(r[0],) for r in rows if r[3] == "good" and r[0] is not None], "id long").distinct()
    got = kn.score(docs, trusted, order=order, block=4000).collect()
    held = {r.id for r in got if r.held}
    good = {r.id for r in trusted.collect()}
    assert held and held < good
    model = Brute([r[1] for r in rows if r[0] in good - held], order)
    want = Counter()
    for d, text, lang, *_ in rows:
        own = grams(text, order)
        want[d, lang, len(own), round(-sum(math.log(model.p(g)) for g in own), 1)] += 1
    assert Counter((r.id, r.lang, r.n, round(r.nll, 1)) for r in got) == want


def test_default_is_a_model_of_five_characters(spark):
    rows = corpus()
    trusted = spark.createDataFrame([(r[0],) for r in rows if r[3] == "good"], "id long")
    got = kn.score(spark.createDataFrame(rows, DOCS), trusted).collect()
    held = {r.id for r in got if r.held}
    model = Brute([r[1] for r in rows if r[3] == "good" and r[0] not in held], 5)
    want = {r[0]: -sum(math.log(model.p(g)) for g in grams(r[1], 5)) for r in rows}
    assert all(r.nll == pytest.approx(want[r.id], abs=0.01) for r in got)


def test_probabilities_sum_to_one():
    rows = corpus(40)
    model = Brute([r[1] for r in rows], 3)
    kinds = [g for g in model.c[1]]
    for context in list(model.after[3])[:50] + ["??"]:
        total = sum(model.p(context + g) for g in kinds)
        assert total <= 1 + 1e-9 and total + model.p(context + "香") == pytest.approx(1)


def test_judge_quantiles(spark):
    rows = [(i, 0, "en" if i < 100 else None, i % 2 == 0, 10**8, (1 + i / 1000) * 1e8) for i in range(200)] + [(300, 0, "xx", False, 10**8, 9e9)]
    scored = spark.createDataFrame(rows, "id long, hash long, lang string, held boolean, n long, nll double")
    got = {r.id: r for r in kn.judge(scored, quantile=0.9, margin=0.0).collect()}
    for lang, ids in (("en", range(100)), (None, range(100, 200))):
        means = sorted(1 + i / 1000 for i in ids if i % 2 == 0)
        cut = means[math.ceil(0.9 * len(means)) - 1]
        assert all(got[i].threshold == pytest.approx(cut, abs=2e-3) for i in ids)
        assert all(got[i].kept for i in ids if 1 + i / 1000 < cut - 2e-3) and not any(got[i].kept for i in ids if 1 + i / 1000 > cut + 2e-3)
    assert got[300].kept and got[300].threshold is None


def test_held_out_documents_decide_the_threshold(spark):
    rows = [(i, 0, "en" if i < 4000 else "de", i % 2 == 0, 10**8, (1 + i % 100 / 1000) * 1e8) for i in range(4016)]
    scored = spark.createDataFrame(rows, "id long, hash long, lang string, held boolean, n long, nll double")
    got = {r.id: r for r in kn.judge(scored).collect()}
    assert got[0].threshold == pytest.approx(1.098, abs=5e-3)
    own = np.array([1 + i % 100 / 1000 for i in range(4000, 4016, 2)])
    assert got[4000].threshold == pytest.approx(own.max() + kn.SURE * own.std(ddof=1) / 8**0.5, abs=2e-3)


def test_junk_goes_and_columns_stay(spark):
    rows = corpus(400) + [(None, "$#%&" * 50, "en", "bad", 0), (None, "etaoin shrdlu " * 9, "en", "good", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[3] == "good"), 0) for r in rows if r[0] is not None and r[0] % 2], "doc_id long, quality int, toxic int")
    kept = kn.keep(docs, labels)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert not [r for r in left if r.kept == "bad" and len(r.text) > 40]
    assert sum(r.kept == "good" for r in left) >= 0.97 * sum(r[3] == "good" for r in rows)
    assert sum(r.doc_id is None for r in left) == 1


def test_no_trust_and_empty(spark):
    docs = spark.createDataFrame(corpus(5), DOCS)
    none = spark.createDataFrame([(1, None, 0), (2, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.perplexity for r in kn.perplexities(docs, none).collect()] == [None] * 5
    assert kn.keep(docs, none).count() == 5
    assert kn.perplexities(docs.limit(0), none).count() == 0 and kn.keep(docs.limit(0), none).count() == 0

import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm import pii
from tidemark.llm.queries import op6_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x if x < 10 else x - 9
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and brute_luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("seed", range(20))
def test_base_against_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["a@b.c_d@e.f", "@", ".", "x.y@", "-", " ", "@a.b", "a", "%+", "1.2.3.4", "255.0.0.256", "4111 1111-1111 1111", "+1 (523) 555-1055", "+", "0", "9", "é", "(", "4111111111111111", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + " @") == []
    assert pii.base_spans("a" * 300_000 + "@b.c") == [("email", 0, 300_004)]


def evidence():
    keys = Counter()
    rng = random.Random(1)
    for _ in range(400):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if brute_luhn(card + c))
        text = f"word a.b{rng.randrange(99)}@mail.example.com then {rng.randrange(1, 255)}.1.2.3 and {card} or +1 (523) 555-{rng.randrange(1000, 9999)} end at some. The hash a{rng.randrange(10**15, 10**16)}b"
        keys.update(c.key for c in pii.candidates(text))
    return keys


def test_labelers_and_classifier_add_true_spans_only():
    model = pii.fit(evidence())
    chance = pii.posteriors(evidence())
    assert min(p for k, p in chance.items() if k.split(":")[1].startswith("1,1,1")) > 0.9
    text = "ring +1 (269) 555-3296 4539578763621486 now"  # one run of digits: the base drops both
    assert pii.base_spans(text) == []
    base, spans = pii.all_spans(text, model)
    assert base == [] and ("card", 23, 39) in spans and ("phone", 5, 22) in spans
    for clean in ("token = 052c00265143945820206", "ed at thenen. Eratonha", "a1234567890123456b", "pages 100-200, 1999"):
        assert pii.all_spans(clean, model)[1] == [], clean


@pytest.mark.parametrize("own", ["jane {at} example.com", "jane(AT)example.org", "jane [AT] example.com", "jane at example.com", "jane{At}mail.example.com", "jane (at) example (dot) com"])
def test_every_written_out_at_is_proposed(own):
    found = pii.candidates(f"Reach {own}, we reply")
    assert [(c.kind, c.start, c.end) for c in found] == [("email", 6, 6 + len(own))]
    assert pii.candidates(f"Reach {own}, says the anecdote") == found
    assert pii.candidates("An anecdote to look at home. It was told at length. In short.") == []


def test_estimation_prefers_reliable_labelers():
    counts = Counter({"card:1,1,1,0,1:16": 900, "card:0,-1,-1,0,-1:16": 600, "card:0,1,1,0,1:16": 40, "card:0,-1,1,0,-1:16": 40})
    p = pii.posteriors(counts)
    assert p["card:0,1,1,0,1:16"] > 0.9 and p["card:0,-1,1,0,-1:16"] < 0.1


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        counts = Counter(k for k, *_ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(r.spans.split(","))


def test_redaction_and_edge_cases(spark):
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (3, "mail a@b.co, é 10.0.0.1 and +1 (523) 555-1055.", 3, "c"), (3, "plain", 3, "d"), (None, "x " * 50000 + "a@b.co", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, base string")
    model = pii.fit(evidence())
    clean = pii.redact(docs, model)
    assert clean.schema == docs.schema
    assert sorted(map(str, [r.text if r.text is None else r.text[-40:] for r in clean.collect()])) == sorted(["None", "", "mail <EMAIL>, é <IP> and <PHONE>."[-40:], "plain", ("x " * 50000 + "<EMAIL>")[-40:]])
    found = {(r.doc_id, r.n_email) for r in pii.digests(pii.find(docs, model)).collect()}
    assert found == {(1, 0), (2, 0), (3, 1), (3, 0), (None, 1)}
    empty = docs.limit(0)
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
    assert pii.all_spans("a@b.co", pii.fit(Counter()))[1] == [("email", 0, 6)]


def test_every_form_of_a_pattern_is_proposed():
    from tidemark.llm.pii import candidates

    for text in ("joe (AT) example.org", "joe {at} example.org", "joe [At] example {dot} org", "at 2001:db8::1 now", "from ::1, then", "fe80:0:0:0:1:2:3:4 x", "joe at example dot org"):
        assert [c for c in candidates(text) if not c.base], text
    for text in ("12:34:56 at noon", "a::b", "std::vector", "::", "0:0", "n" * 70 + " (at) example.org"):
        assert not candidates(text), text


def test_planted_data_is_added(spark):
    rows = []
    for k in range(300):
        rows.append((k, f"Some prose about {k} things. Write to anna{k} (at) mail{k % 9} (dot) org, or call +49 30 90{k % 10}1234{k % 10}. The host 10.1.{k % 200}.7 answered."))
        rows.append((1000 + k, f"Our server address 2001:db8::{k + 1:x} is down; version 1.2.3.{k % 250} of item 12 34 is old."))
        rows.append((2000 + k, f"Plain words, {k} of them, without anything that concerns a person."))
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {d: [s.kind for s in r.spans if s not in r.base] for d, r in found.items()}
    assert sum("email" in added[k] for k in range(300)) >= 290 and sum("ip" in added[1000 + k] for k in range(300)) >= 290
    assert not any(added[2000 + k] for k in range(300))


def test_the_fit_depends_on_shares_only():
    from collections import Counter

    from tidemark.llm.pii import candidates, fit

    counts = Counter(c.key for k in range(50) for c in candidates(f"tel 030 123 45{k:02} or a{k} (at) b.org, host 10.0.0.{k}"))
    small, large = fit(Counter({k: 100 * n for k, n in counts.items()})), fit(Counter({k: 100_000 * n for k, n in counts.items()}))
    assert all(abs(small.probability(k) - large.probability(k)) < 0.02 for k in counts)


def test_very_many_spans_in_one_text():
    import time

    from tidemark.llm.pii import all_spans, fit, candidates
    from collections import Counter

    text, began = "call 030 123 4567 today; " * 40_000, time.perf_counter()
    model = fit(Counter(c.key for c in candidates(text)))
    all_spans(text, model, 0.0)
    assert time.perf_counter() - began < 40

import random
import re

import pytest

from tidemark.llm.licenses import NOTICES, PHRASES, Scanner, license_scan, pieces, scan
from tidemark.llm.queries import op7_licenses

SCANNER = Scanner()


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def brute_base(text):
    words = words_of(text)
    places = sorted((i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(notice, k, rng):
    out = list(notice)
    for _ in range(k):
        at = rng.randrange(1, len(out) - 1)
        kind = rng.choice("sid")
        if kind == "s":
            out[at] = rng.choice("qxz")
        elif kind == "i":
            out.insert(at, rng.choice("qxz"))
        else:
            del out[at]
    return "".join(out)


def test_pieces_make_up_the_notice():
    for notice, _ in NOTICES:
        for k in range(6):
            cut = pieces(notice, k)
            assert len(cut) == k + 1 and "".join(p for _, p in cut) == notice and all(notice[o:].startswith(p) for o, p in cut)


@pytest.mark.parametrize("seed", range(40))
def test_edited_notices_are_found_and_verified(seed):
    rng = random.Random(seed)
    notice, label, edits = rng.choice(SCANNER.notices)
    wrong = edited(notice, rng.randint(0, edits), rng)
    text = f"Some words — {wrong.upper() if seed % 2 else wrong}. And é more, words"
    found = [m for m in scan(text, SCANNER).matches if m.label == label]
    joined = " ".join(words_of(wrong))
    if distance(joined, notice) <= edits:
        assert found
        m = found[0]
        assert distance(" ".join(words_of(text[m.start : m.end])), notice) <= edits


def test_every_window_by_brute_force():
    rng = random.Random(8)
    scanner = Scanner([("abcab cab", "x"), ("bca cabb", "y")], every=4)
    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        joined = " ".join(text.split())
        starts = [i for i in range(len(joined)) if joined[i] != " " and (i == 0 or joined[i - 1] == " ")]
        ends = [i + 1 for i in range(len(joined)) if joined[i] != " " and (i + 1 == len(joined) or joined[i + 1] == " ")]
        for notice, label, edits in scanner.notices:
            want = any(distance(joined[a:b], notice) <= edits for a in starts for b in ends if b > a)
            assert want == any(m.label == label for m in scanner.search(joined)), (joined, label)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_licenses(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0)
    for phrase, label in (("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("All rights reserved.", "all-rights-reserved"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0")):
        held = [r for r in got if phrase in texts[r.doc_id]]
        assert held and all(label in r.labels.split(",") for r in held)


def test_edge_cases(spark):
    text = "mit license mit license; the MIT\nLicense permit license"
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, text, "c", 3), (3, text, "c", 3), (None, "x " * 100000 + "GNU general public license", None, None)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score int")).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == 5 and by[1, 0].labels == "" and by[2, 0].score == 0.0 and by[2, 0].first_word is None
    assert (by[3, 9].n_base, by[3, 9].first_word, by[3, 9].last_word, by[3, 9].base_labels) == (3, 0, 5, "mit")
    last = next(r for r in got if r.doc_id is None)
    assert (last.n_words, last.first_word, last.base_labels, last.score) == (100004, 100000, "gpl", 1.0)
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_many_matches_in_one_text():
    import time

    from tidemark.llm.licenses import NOTICES, Scanner, scan

    text, began = "released under the mit license x1 " * 20_000, time.perf_counter()
    found = scan(text, Scanner(NOTICES))
    assert time.perf_counter() - began < 30
    mit = [m for m in found.matches if m.label == "mit"]
    assert len(found.places) == 20_000 and len(mit) == 20_000
    assert all(a.end <= b.start for a, b in zip(mit, mit[1:])) and text[mit[-1].start : mit[-1].end] == "released under the mit license"

import random
import re

import pytest
import xxhash

from tidemark.llm.simhash import choices, fingerprint, keep_one, link, near_duplicates, segments, together

SCHEMA = "doc_id long, text string, component long, fp string"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    rows = [(None, "x y"), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A B C D"), (8, "a b c d e"), (8, "a b c d e"), (9, "  nbsp word")]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 10, " ".join(copy)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("distance", [0, 1, 6])
def test_other_distances(spark, distance):
    rows = corpus()[:60]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance=distance).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, distance)


def test_long_text_and_chunks(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000))
    want = brute_fp(text)
    monkeypatch.setattr("tidemark.llm.simhash.CHUNK", 64)
    assert fingerprint(text.encode()) == want


def test_segments_cover_all_bits():
    for distance in range(32):
        cut = segments(distance)
        assert sum(b for _, b in cut) == 64 and 2 * len(cut) > distance and all(b <= 32 for _, b in cut)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = [(3, "a b c d", 1, "x"), (2, "a b c d", 2, "y"), (None, "a b c d", 3, "z"), (5, "quite another text here", 4, None), (7, None, 5, "n"), (8, "", 6, "e"), (5, "quite another text here", 4, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 7]


@pytest.mark.parametrize("distance, m", [(4, 1), (4, 2), (4, 3), (4, 4), (3, 2), (6, 2)])
def test_some_choice_differs_by_one_bit_at_most(distance, m):
    rng = random.Random(distance * 10 + m)
    options = choices(distance, m)
    assert all(sum(b for _, b in c) <= 48 for c in options) and len(options) * 65 < 1 << 15
    for _ in range(3000):
        flipped = {rng.randrange(64) for _ in range(distance)}
        assert any(sum(a <= f < a + b for f in flipped for a, b in c) <= 1 for c in options)


def test_wider_keys_give_the_same_links(spark):
    from tidemark.llm.store import Workspace

    rng = random.Random(8)
    fps = {0, -1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(4):
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
            fps.add(base - (1 << 64) if base >> 63 else base)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    one, two = (sorted(map(tuple, link(frame, 4, Workspace(spark), m).collect())) for m in (1, 2))
    assert one == two and len(one) == len(fps)


def test_keys_grow_with_the_number_of_fingerprints():
    assert together(1000, 4) == together(1_000_000, 4) == 1 and together(10**8, 4) >= 2 and together(10**11, 4) == 4

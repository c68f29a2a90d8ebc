import itertools
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import WASTE, best_fit, best_fit_sequences, bins, bound, completed, cut, fillings, library_encoder, pack
from tidemark.llm.queries import op3_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def optimum(sizes, capacity):
    @lru_cache(None)
    def go(left, rooms):
        if not left:
            return 0
        n, rest = left[0], left[1:]
        options = []
        for k, r in enumerate(rooms):
            if r >= n and (k == 0 or rooms[k - 1] != r):
                options.append(go(rest, tuple(sorted((*rooms[:k], r - n, *rooms[k + 1 :])))))
        options.append(1 + go(rest, tuple(sorted((*rooms, capacity - n)))))
        return min(options)

    return go(tuple(sorted(sizes, reverse=True)), ())


def whole(solution, counts, capacity):
    held = np.zeros_like(counts)
    for pattern, times in solution:
        assert sum(pattern) <= capacity and times > 0
        np.add.at(held, list(pattern), times)
    return (held == counts).all()


@pytest.mark.parametrize("seed", range(30))
def test_small_cases_are_optimal_and_whole(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 21, rng.integers(1, 9)).tolist()
    counts = np.bincount(sizes, minlength=21)
    solution = pack(counts, 20)
    assert whole(solution, counts, 20) and bins(solution) == optimum(sizes, 20)


def test_large_histograms_come_close_to_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(1024, 1 + rng.exponential(300, 200_000).astype(int)), minlength=1025) * 1000
    solution = pack(counts, 1024)
    assert whole(solution, counts, 1024) and bins(solution) <= bound(counts, 1024) * 1.001 and len(solution) < 5000
    assert pack(np.zeros(1025, dtype=np.int64), 1024) == []


def test_fillings_are_undominated():
    counts = np.bincount([9, 7, 5, 4, 3, 2, 2, 1], minlength=17)
    for pattern in fillings(9, counts, 16, 20):
        left = counts - np.bincount(pattern, minlength=17)
        room = 16 - sum(pattern)
        assert not any(left[n] for n in range(1, room + 1))


def every_filling(largest, counts, capacity):
    """All fillings around ``largest`` to which no piece left can be added, by plain recursion."""
    found = set()

    def go(pattern, left, top):
        room = capacity - sum(pattern)
        if not any(left[n] for n in range(1, room + 1)):
            found.add(tuple(pattern))
        for n in range(min(top, room), 0, -1):
            if left[n]:
                left[n] -= 1
                go([*pattern, n], left, n)
                left[n] += 1

    left = counts.copy()
    left[largest] -= 1
    go([largest], left, largest)
    return found


def lays(a, b):
    """Whether b's pieces after the first fit into a's, by trying every assignment."""
    return any(all(sum(n for n, to in zip(b[1:], place) if to == k) <= a[1:][k] for k in range(len(a) - 1)) for place in itertools.product(range(len(a) - 1), repeat=len(b) - 1))


@pytest.mark.parametrize("seed", range(20))
def test_fillings_are_all_that_nothing_dominates(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 13, rng.integers(2, 9)).tolist()
    counts, top = np.bincount(sizes, minlength=17), max(sizes)
    everything, kept = every_filling(top, counts, 16), fillings(top, counts, 16)
    assert set(kept) <= everything and len(kept) == len(set(kept))
    for pattern in everything:
        assert any(other == pattern or lays(other, pattern) for other in kept)
    assert not any(a != b and lays(a, b) for a in kept for b in kept)
    assert set(fillings(top, counts, 16, 3)) <= everything


@pytest.mark.parametrize("seed", range(30))
def test_the_unbounded_search_is_optimal(seed):
    rng = np.random.default_rng(100 + seed)
    sizes = rng.integers(3, 15, rng.integers(1, 11)).tolist()
    counts = np.bincount(sizes, minlength=21)
    solution = pack(counts, 20, nodes=None)
    assert whole(solution, counts, 20) and bins(solution) == optimum(sizes, 20)


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_equals_the_piecewise_rule(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 21, 60).tolist()
    rooms = []
    for n in sorted(sizes, reverse=True):
        at = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(20 - n)
        else:
            rooms[at] -= n
    counts = np.bincount(sizes, minlength=21)
    solution = best_fit(counts, 20)
    assert whole(solution, counts, 20) and sorted(20 - sum(p) for p, times in solution for _ in range(times)) == sorted(rooms)


@pytest.mark.parametrize("low, high", [(5, 40), (20, 120), (200, 500)])
def test_completion_alone_is_not_above_best_fit(low, high):
    counts = np.bincount(np.random.default_rng(low).integers(low, high + 1, 50_000), minlength=1025)
    alone = min((completed(counts, 1024, 1024 * w // 256) for w in WASTE), key=bins)
    assert whole(alone, counts, 1024) and bound(counts, 1024) <= bins(alone) <= bins(best_fit(counts, 1024))
    assert bins(pack(counts, 1024, nodes=50)) <= bins(alone)


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(1, 4) == [(0, 1)]


def check(rows, texts, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for doc, group in by_doc.items():
        ids = [*TOKENIZER.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        group.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in group] == cut(len(ids), capacity) and [r.piece for r in group] == list(range(len(group)))
        for r in group:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op3_packing(spark, sf).collect(), texts)


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, None, 0, "a"), (2, "", 1, "b"), (3, "word " * 5000, 2, "c"), (4, "<|endoftext|>", 3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string")
    check(best_fit_sequences(docs, PATH).collect(), {r[0]: r[1] for r in rows})
    twice = best_fit_sequences(docs.union(docs), PATH, with_ids=True).collect()
    assert len(twice) == 2 * len(best_fit_sequences(docs, PATH).collect())
    places = {(r.sequence_id, r.offset) for r in twice}
    assert len(places) == len(twice) and all(len(r.ids) == r.length for r in twice)
    assert best_fit_sequences(docs.limit(0), PATH).collect() == []
    assert len(best_fit_sequences(spark.createDataFrame([(None, "x")], "doc_id long, text string"), PATH).collect()) == 1


def test_fast_reader_equals_the_library():
    texts = ["Ünï cödé 字 'll we've  \n\n x", " " * 3000, "a" * 5000, "", "<|endoftext|>"]
    assert library_encoder(PATH)(texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]

import hashlib
import random

import public_tokenizers
import tiktoken

from tidemark.llm.bpe import Codec, PerfectHash, decode, digests, encode, load_ranks, splitter
from tidemark.llm.queries import op8_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = load_ranks(PATH)
CODEC = Codec(RANKS, PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　aéßñ字'’stSTREverll0١²½_-!.€😀‍﻿́"


def test_perfect_hash_is_minimal_and_total():
    keys = [str(i).encode() for i in range(5000)]
    found = PerfectHash(keys).lookup(keys)
    assert found.tolist() == list(range(5000))
    assert PerfectHash([]).n == 0


def test_equals_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert CODEC.encode(texts) == [ORACLE.encode_ordinary(t) for t in texts]


def test_long_pretokens():
    for text in ("a" * 30000, " " * 30000 + "x", "ab" * 15000, "é" * 9999):
        assert CODEC.encode([text])[0] == ORACLE.encode_ordinary(text)


def test_cache_may_start_afresh(monkeypatch):
    monkeypatch.setattr("tidemark.llm.bpe.CACHE", 3)
    monkeypatch.setattr("tidemark.llm.bpe.GROUP", 4)
    texts = ["one two three", "", "four five six seven", "one"] * 3
    assert Codec(RANKS, PATTERN).encode(texts) == [ORACLE.encode_ordinary(t) for t in texts]


def test_frames_nulls_clashing_columns_and_round_trip(spark):
    rows = [(1, None, "i", 7), (2, "", "j", 8), (3, "Hello <|endoftext|> wörld", "k", 9), (3, "Hello <|endoftext|> wörld", "k", 9), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = decode(encode(df, PATH, PATTERN), PATH, PATTERN)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        assert bytes(r.decoded).decode() == (r.text or "") and list(r.ids) == ORACLE.encode_ordinary(r.text or "")
    assert decode(encode(df.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ORACLE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert digests(spark.createDataFrame([], "doc_id long, ids array<int>, decoded binary")).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quick_engine_equals_the_full_one():
    import regex

    split, full = splitter(PATTERN), regex.compile(PATTERN).findall
    rng = random.Random(9)
    for _ in range(20000):
        text = "".join(rng.choice(ALPHABET + "ĀǀªµºÀ×÷ɏɐ") for _ in range(rng.randint(0, 9)))
        assert split(text) == full(text)
    odd = r"\p{L}++|\[|."
    assert splitter(odd)("ab[c") == regex.compile(odd).findall("ab[c")


def test_a_small_shelf_starts_afresh_and_ids_stay_the_same(spark):
    from tidemark.llm.bpe import ENTRY, Shelf

    rng = random.Random(4)
    words = [f" w{k}é" for k in range(400)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for entries in (1, 7, 90, 1000):
        own = Codec(RANKS, PATTERN)
        own.shelf = Shelf(entries * ENTRY)
        for k in range(0, 300, 10):
            assert own.encode(texts[k : k + 10]) == [ORACLE.encode_ordinary(t) for t in texts[k : k + 10]]
        assert own.shelf.n <= entries


def test_pre_tokens_of_one_hash_are_told_apart():
    import numpy as np

    from tidemark.llm.bpe import Shelf

    shelf, one = Shelf(1 << 12), np.zeros(1, dtype=np.uint64)
    pack = lambda t: (np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))
    shelf.add(one, *pack(b"abc"), np.array([5, 6], dtype=np.int32), np.array([0, 2]))
    assert shelf.find(one, *pack(b"abc")).tolist() == [0] and shelf.find(one, *pack(b"abd")).tolist() == [-1] and shelf.find(one, *pack(b"ab")).tolist() == [-1]

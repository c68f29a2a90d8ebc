import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute_kept
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm import pii, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out of the last, each written and read again."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_decisions(spark, stages):
    docs = stages[0]
    assert all(s.columns == docs.columns for s in stages[:5]) and len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    labels = rows(spark.read.parquet(f"{SF}/labels.parquet"))
    first, second, third, fourth = (rows(s) for s in stages[1:5])
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(d in first for d in good) >= 0.95 * len(good)
    model = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = rows(quality_rules.score(stages[1], model))
    assert set(second) == {d for d in first if verdict[d].kept}
    assert sorted(third) == brute_kept([(d, r.text) for d, r in second.items()])
    assert set(fourth) == set(third)
    for d, r in fourth.items():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not pii.base_spans(third[d].text) and "0" <= min(third[d].text, default="") and r.text != third[d].text:
            assert "<" in r.text


def test_packing_of_what_is_left(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, sequences, seen = rows(stages[4]), defaultdict(list), defaultdict(int)
    for r in stages[5].collect():
        ids = [*tokenizer.encode(texts[r.doc_id].text, add_special_tokens=False).ids, 2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert set(seen) == set(texts)
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist() and sum(n for _, n in places) <= 1024


def test_run_equals_the_stages(spark, stages):
    got = cp.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, stages[5].select("doc_id", "piece", "ids_crc32").collect()))


def test_nulls_repeats_and_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0), (None, "x " * 99, "en", "s", 1)], docs.schema)
    for name, some in (("odd", docs.limit(60).union(odd)), ("none", docs.limit(0))):
        folder = tmp_path / name
        some.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").where(F.lit(name == "odd")).coalesce(1).write.parquet(f"{folder}/labels.parquet")
        assert (cp.run(spark, str(folder)).count() > 0) == (name == "odd")


def test_columns_with_clashing_names(spark):
    """Columns named as those that the stages work with stay, and change no decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ("id", "hash", "block", "gram", "kept", "set", "n", "fp", "comp", "prefix", "key", "of", "spans", "base", "w", "__own")
    clash = docs.select("*", *[F.lit("x").alias(n) for n in names])
    for _, stage in cp.STAGES[:-1]:
        plain, more = stage(spark, docs, SF), stage(spark, clash, SF)
        assert more.columns == clash.columns
        assert sorted(map(tuple, more.select(docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert all(r[n] == "x" for r in more.collect() for n in names)
    clash = docs.select("*", *[F.lit("x").alias(n) for n in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row", "doc")])
    assert cp.sequences(spark, clash, SF).columns == cp.sequences(spark, docs, SF).columns

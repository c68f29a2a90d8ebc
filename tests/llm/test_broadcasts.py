"""Exploded tables are never built and broadcast on the driver: Spark sizes them by the file that they come from."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, jaccard, simhash
from tidemark.llm.store import Workspace


@pytest.fixture
def planned(monkeypatch):
    """The physical plan of each table, as it is saved."""
    plans, save = [], Workspace.save

    def keep(self, df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Workspace, "save", keep)
    return plans


def test_fingerprint_keys_are_joined_by_merging(spark, planned):
    fps = spark.range(200).select(F.xxhash64("id").alias("fp"))
    assert simhash.link(fps, 4, Workspace(spark)).count() == 200
    exploded = [p for p in planned if "Generate explode" in p]
    assert len(exploded) == 2 and not any("BroadcastHashJoin" in p for p in exploded)


def test_prefixes_are_joined_by_merging(spark, planned):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[: 59 - i] + [f"x{i}"])) for i in range(4)], "doc_id long, text string")
    assert jaccard.keep_one(docs).count() == 1
    exploded = [p for p in planned if "Generate explode(prefix" in p]
    assert exploded and not any("BroadcastHashJoin" in p for p in exploded)


def test_many_edges_are_joined_by_merging(spark, planned, monkeypatch):
    edges = spark.range(1, 50).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    for few in (1000, 1):
        monkeypatch.setattr(components, "FEW", few)
        planned.clear()
        assert components.propagate(spark.range(60).select("id"), edges, Workspace(spark)).where("comp = 0").count() == 50
        assert any("BroadcastHashJoin" in p for p in planned) == (few == 1000)

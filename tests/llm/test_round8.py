"""Tests for the findings of round 3: what near documents leave on disk."""

import os

from pyspark.sql import functions as F

from riskloom.llm import jaccard
from riskloom.llm.common import shared_root


def test_steps_of_near_documents_are_freed(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.floor(F.col("id") / (40 if i % 9 else 3))) for i in range(60))).alias("text"))
    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    seen = jaccard.near_groups(docs, 5, 80).collect()
    assert len(seen) == 300 and len({x.component_id for x in seen}) < 300
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert not left & {"sketches", "shared-blocks", "blocks", "pairs", "candidate-ids", "rest", "second-pairs"}, left


def test_passes_give_the_same_components(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.floor(F.col("id") / (20 if i % 9 else 4))) for i in range(60))).alias("text"))
    found = []
    for passes in (1, 4):
        monkeypatch.setattr(jaccard, "PASSES", passes)
        found.append(sorted(map(tuple, jaccard.near_groups(docs, 5, 80).collect())))
    assert found[0] == found[1]

"""Shards of the smallest real table: sizes, and equal texts with different metadata."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import kd_shards

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("most", [0, kd_shards.MOST_BROADCAST])
def test_equal_texts_stand_together(spark, monkeypatch, most):
    monkeypatch.setattr(kd_shards, "MOST_BROADCAST", most)
    rows = [(i, f"text {i % 40} " + "word " * (i % 40), f"l{i % 3}", f"s{i % 7}", "clash") for i in range(400)] + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __same string").drop("__same")
    shards = defaultdict(set)
    for r in kd_shards.kd_shards(df, 8).collect():
        shards[r["text"]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # one group for each cut at most


def test_sizes_differ_by_the_largest_row_at_most(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = kd_shards.kd_shards(docs, 40)
    sums = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= placed.agg(F.max("size")).first()[0]
    assert placed.count() == docs.count() and {*docs.columns, "shard", "size"} == set(placed.columns)

"""Rows of one key that outgrow a task are split: anchors with many neighbourhoods, and texts with many copies."""

import random

import pytest

from gaugeflow.llm import column_dedup
from gaugeflow.llm._scratch import Scratch

SPLITS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_text_are_split(split):
    g = random.Random(3)
    text = lambda k: "".join(g.choices("abcdefgh", k=k))
    copied, alone = text(700), [text(300) for _ in range(200)]
    df = split.createDataFrame(list(enumerate([copied] * 600 + alone)), "doc_id long, text string").repartition(8)
    out = column_dedup.remove_repeats(df)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out.collect()}
    assert got == {i: (700, 700, 1) for i in range(600)} | {600 + i: (300, 0, 0) for i in range(200)}
    assert "skew=true" in _plan(out)


def test_neighbourhoods_of_an_anchor_are_split(split):
    rows = [(7, i) for i in range(4000)] + [(100 + i // 2, i) for i in range(600)] + [(1000 + i, i) for i in range(300)]
    around = split.createDataFrame(rows, "anchor long, around long").selectExpr("anchor", "around", "1L AS n", "named_struct('key', around, 'at', 0L, 'left', 0, 'right', 500) AS one")
    scratch = Scratch(split, "crowded-joins")
    out = column_dedup._differing(scratch.table(around.repartition(8)), scratch)
    got = {(r["w"]["anchor"], r["w"]["around"], r["w"]["many"]) for r in out.collect()}
    assert got == {(a, b, False) for a, b in rows[:4600]}
    assert "skew=true" in _plan(out)

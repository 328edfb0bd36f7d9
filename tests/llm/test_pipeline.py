"""The corpus pipeline's stages on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import queries
from gaugeflow.llm._scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, scratch, out = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.table(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert after.count() > 0
    assert {"shard", "size"} <= set(stages[-1][2].columns)


def test_filters_remove_and_add_nothing(stages):
    for name, before, after in stages[:3]:
        assert after.exceptAll(before).count() == 0, name
        assert after.count() <= before.count()


def test_no_copies_are_left(stages):
    assert stages[1][2].groupBy("text").count().where("count > 1").count() == 0


def test_last_stage_places_every_row(stages):
    _, before, after = stages[-1]
    assert after.count() == before.count() and after.where(~F.col("shard").between(0, 39)).count() == 0


def test_eleven_queries_are_registered():
    names = sorted(queries.QUERIES)
    assert len(names) == 11 and "pipeline" in names
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 11)}

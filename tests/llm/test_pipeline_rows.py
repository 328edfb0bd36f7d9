"""The pipeline's stages on odd rows: null and repeated ids, null and empty texts, repeated rows, no rows, clashing columns."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from gaugeflow.llm import _scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string, component string, score string"
LONG = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
THIRD = " ".join(f"third{i}" for i in range(60))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", None, "clash") for i, t in rows], SCHEMA).repartition(3)


def test_one_row_of_each_group_stays(spark):
    rows = [(5, LONG), (5, OTHER), (7, OTHER), (None, LONG), (None, LONG + " more"), (3, THIRD), (3, THIRD), (None, "alone words"), (None, "alone words"), (9, None), (9, ""), (10, " ")]
    kept = corpus_pipeline.one_of_each_group(spark, table(spark, rows), SF)
    assert kept.columns == table(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, LONG), (5, OTHER), (3, THIRD), (None, "alone words"), (9, None), (9, ""), (10, " ")])


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, ""), (2, "one two three"), (2, "one two three"), (4, LONG * 50)]])
def test_all_stages_take_odd_rows(spark, rows):
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name != "sharding":
            assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert "shard" in docs.columns and {r["shard"] for r in docs.collect()} <= set(range(40))


def test_a_run_leaves_one_table(spark):
    base = Path(_scratch.shared_dir(spark).removeprefix("file:"))
    before = set(base.iterdir())
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and len(set(base.iterdir()) - before) == 1

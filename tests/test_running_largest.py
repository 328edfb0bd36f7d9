import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.joins import interval_overlap
from gaugeflow.operators.ranks import running_largest


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_ranges_carry_their_maxima(spark, parts):
    g = random.Random(parts)
    rows = [("hot" if g.random() < 0.8 else "cold", g.choice([g.random(), 0.5]), g.choice([None, g.random()])) for _ in range(600)]
    got = running_largest(spark.createDataFrame(rows, "k string, at double, v double"), ["k"], "at", "v", "most", parts).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["most"] == max((v for k, at, v in rows if k == r["k"] and at <= r["at"] and v is not None), default=None)


@pytest.mark.parametrize("parts", [1, 9])
def test_overlap_of_one_hot_key_equals_all_pairs(spark, parts):
    g = random.Random(3)
    span = lambda: (lambda a: (a, a + g.random() * 0.02))(g.random() * 5 + 1)
    sims = [("k", *span()) for _ in range(150)] + [("other", 2.0, 3.0)]
    rows = [(i, "k", *span()) for i in range(200)] + [(900, "none", 1.0, 2.0), (901, "other", 3.0, 4.0)]
    got = interval_overlap(spark.createDataFrame(rows, "id long, key string, lo double, hi double"), spark.createDataFrame(sims, "key string, lo double, hi double"), "key", "id", 0.001, parts)
    want = {i: int(any(k == s[0] and s[1] * 0.999 <= hi and s[2] * 1.001 >= lo for s in sims)) for i, k, lo, hi in rows}
    assert {r["id"]: r["feasible"] for r in got.collect()} == want and 0 < sum(want.values()) < len(rows)


def test_ranges_of_a_single_key_are_about_equal(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), F.pow(F.rand(1), 4).alias("at"), F.rand(2).alias("v"))
    sizes = [r["count"] for r in running_largest(df, ["k"], "at", "v", "most", 8).groupBy("__part").count().collect()]
    assert sum(sizes) == 100_000 and len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)

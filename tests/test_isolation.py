"""Isolation forests: samples, and scores against single walks down the trees."""

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.operators import detect


def test_rows_are_in_samples_independently(spark):
    df = spark.range(60_000).select(F.col("id").cast("double").alias("x"))
    got = np.array([r["tree"] for r in detect._drawn(df, ["x"], 50, 0.01, 1).select("tree").collect()])
    sizes = np.bincount(got, minlength=50)
    assert abs(sizes - 600).max() < 5 * np.sqrt(600)  # every tree's alike, also the last ones'
    twice = detect._drawn(df, ["x"], 50, 0.01, 1).groupBy("x").count()
    n, pairs = twice.agg(F.count(F.lit(1)), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()
    assert abs(n - 60_000 * (1 - 0.99**50)) < 600 and abs(pairs - 60_000 * 1225 * 1e-4) < 500
    assert detect._drawn(df.limit(7), ["x"], 3, 1.0, 1).count() == 21


def test_leaves_filled_downwards_are_the_leaves(spark):
    average = lambda m: m / 10
    #      feature, cut, lo, hi, size, depth
    nodes = np.array([[1, 5.0, 1, 2, 9, 0], [-1, 0, -1, -1, 4, 1], [0, -1.0, 3, 4, 5, 1], [-1, 0, -1, -1, 2, 2], [-1, 0, -1, -1, 3, 2]], float)
    feature, cut, value = detect._heap(nodes, average)
    for x, want in (([0.0, 4.9], 1.4), ([0.0, 5.0], 2.3), ([-2.0, 7.0], 2.2), ([-1.0, 7.0], 2.3), ([1.8e308, 1.8e308], 2.3)):
        at = 0
        for _ in range(detect.DEEPEST):
            at = 2 * at + 1 + int(np.nan_to_num(x)[feature[at]] >= cut[at])
        assert value[at] == want


def test_lonely_rows_score_highest(spark):
    g = np.random.default_rng(0)
    rows = [(i, *map(float, g.normal(0, 1, 2))) for i in range(400)] + [(400, 30.0, -30.0), (401, None, None)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    found = {r["id"]: r["score"] for r in detect.isolation_scores(df, df, ["x", "y"], trees=50).collect()}
    assert max(found, key=found.get) == 400 and len(found) == 402 and all(0 < s < 1 for s in found.values())

"""Graph steps that many networks share: rounds of averaging against matrices, and pipes scaled without a task per network."""

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.operators import graph, neighbours


def test_averaging_over_links_equals_the_normalised_matrix(spark):
    g = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in g.integers(0, 30, (80, 2)) if a != b})
    x = g.normal(size=31)  # point 30 has no link
    a = np.eye(31)
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    root = np.sqrt(a.sum(axis=1))
    want = np.linalg.matrix_power(a / root[:, None] / root[None, :], 3) @ x
    features = spark.createDataFrame([(f"n{i}", float(v)) for i, v in enumerate(x)], "id string, v double")
    both = spark.createDataFrame([(f"n{i}", f"n{j}") for i, j in pairs] + [(f"n{j}", f"n{i}") for i, j in pairs] * 2, "src string, dst string")
    got = {r["id"]: r["v"] for r in neighbours.propagate(features, both, ["v"], 3).collect()}
    assert len(got) == 31 and all(abs(got[f"n{i}"] - want[i]) < 1e-12 for i in range(31))


def test_links_come_once_in_each_direction(spark):
    edges = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x"), ("a", "x", "y"), ("a", "z", "z"), ("b", "x", "y")], "network_id string, src string, dst string")
    assert sorted(map(tuple, graph.both_ways(edges).collect())) == [("a", "x", "y"), ("a", "y", "x"), ("b", "x", "y"), ("b", "y", "x")]


def test_no_task_gets_all_pipes_of_a_network(spark):
    pipes = spark.range(200).select(F.lit("one").alias("network_id"), F.col("id").cast("string").alias("pipe_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("src"), F.lit("t").alias("dst"), F.col("id").cast("double").alias("length"), F.lit(0.0).alias("diameter"))
    nodes = pipes.select("network_id", F.col("src").alias("node")).unionAll(spark.createDataFrame([("one", "t")], "network_id string, node string"))
    found = graph.edge_features(pipes, nodes, pipes.select("network_id", "pipe_id", *[(-F.col("length")).alias(c) for c in ("flow", "velocity", "headloss")]))
    rows = found.collect()
    assert len(rows) == 400 and all(abs(r["flow"] - r["length"]) < 1e-12 and r["diameter"] == 0 for r in rows)
    assert {r["src"]: r["length"] for r in rows}["s50"] == 50 / 199
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan

"""What a neighbour search writes grows with the points, not with the cells that each of them asks for."""

import numpy as np
from test_betweenness_disk import written
from test_pivot_index import brute

from gaugeflow.operators import neighbours
from gaugeflow.operators.sampling import adasyn_augment


def test_twice_the_points_without_clusters_shuffle_about_twice_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    g, seen = np.random.default_rng(5), []
    for n in (500, 1000):
        rows = list(enumerate(g.normal(size=(n, 24)).tolist()))
        before = written(spark)
        pairs = neighbours.knn_pairs(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 4).collect()
        seen.append(written(spark) - before)
        got = {}
        for r in sorted(pairs, key=lambda r: (r["id"], r["rank"])):
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert got == brute(rows, 4)
    assert seen[1] < 2.5 * seen[0]


def test_blocks_searched_in_parts_give_the_same(spark, monkeypatch):
    """Several partitions to search in, each of which may find k others, and ids that are texts."""
    monkeypatch.setattr(neighbours, "BLOCK", 15)
    monkeypatch.setattr(neighbours, "HELD", 2_000)
    monkeypatch.setattr(neighbours, "ASKING", 1_000)
    g = np.random.default_rng(6)
    rows = [(f"p{i:03}", v) for i, v in enumerate(g.integers(0, 5, (150, 3)).astype(float).tolist())]
    got = {}
    for r in sorted(neighbours.knn_pairs(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec", 6).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(rows, 6)


def test_coordinates_are_halved_only_where_that_loses_nothing():
    for x, size in (([[1.5, -2.0]], 4), ([[0.1, 2.0]], 8), ([[float("nan"), 0.25]], 4), ([[1e300, 0.25]], 8)):
        x = np.array(x)
        sent = neighbours._sent(x)
        assert len(sent) == size * x.size and np.array_equal(neighbours._read(sent, 1, 2), x, equal_nan=True)


def test_pairs_are_made_once_for_both_directions(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    pairs = spark.range(40).selectExpr("id", "id + 1 AS neighbour").mapInPandas(counted, "id long, neighbour long")
    rows = neighbours.symmetric_edges(pairs).collect()
    assert sorted((r["src"], r["dst"]) for r in rows) == sorted([(i, i + 1) for i in range(40)] + [(i + 1, i) for i in range(40)])
    assert made.value == 40


def test_twice_the_points_of_an_augmentation_shuffle_about_twice_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    g, seen = np.random.default_rng(7), []
    for n in (500, 1000):
        df = spark.createDataFrame([(i, v, int(i % 3 == 0)) for i, v in enumerate(g.normal(size=(n, 24)).tolist())], "id long, vec array<double>, event_label int")
        before = written(spark)
        assert adasyn_augment(df, "vec", 4).groupBy("is_synthetic").count().where("is_synthetic = 0").first()["count"] == n
        seen.append(written(spark) - before)
    assert seen[1] < 2.5 * seen[0]

from collections import defaultdict

import numpy as np
import pytest

from gaugeflow.operators import neighbours


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids.tolist(), x, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        out[i] = [j for _, j in sorted((float(a), j) for a, j in zip(d, ids.tolist(), strict=True) if j != i)[:k]]
    return out


def search(spark, rows, k):
    index = neighbours.PivotIndex(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "id long, vec array<double>"), "id", "vec")
    pairs, work = index.search(k)
    got = defaultdict(dict)
    for r in pairs.collect():
        got[r["id"]][r["rank"]] = r["neighbour"]
    return {i: [n[j] for j in sorted(n)] for i, n in got.items()}, sum(r["compared"] for r in work.collect())


def test_clusters_are_searched_exactly_below_the_square(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    g = np.random.default_rng(1)
    centres = g.normal(0, 40, (30, 6))
    rows = [(i, centres[i % 30] + g.normal(0, 0.3, 6)) for i in range(1200)]
    got, compared = search(spark, rows, 5)
    assert got == brute(rows, 5)
    assert compared < 0.35 * 1200**2


@pytest.mark.parametrize("n", [2, 4, 300])
def test_points_without_clusters_fewer_than_k_and_equal_ones(spark, monkeypatch, n):
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    g = np.random.default_rng(n)
    rows = [(i, g.integers(0, 4, 3)) for i in range(n)]  # many ties
    got, _ = search(spark, rows, 7)
    assert got == brute(rows, 7)


def test_one_hot_place_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    rows = [(i, [1.0, 2.0]) for i in range(150)] + [(150 + i, [float(i), 9.0]) for i in range(100)]
    got, _ = search(spark, rows, 3)
    assert got == brute(rows, 3)


def test_no_points(spark):
    df = spark.createDataFrame([], "id long, vec array<double>")
    assert neighbours.knn_pairs(df, "id", "vec", 3).count() == 0


def test_a_point_that_no_cell_can_be_ruled_out_for_has_one_row(spark, monkeypatch):
    """A row for each cell would hold the point's vector as often as there are cells."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "STRIP", 7)
    g = np.random.default_rng(2)
    rows = list(enumerate(g.normal(size=(200, 30))))
    index = neighbours.PivotIndex(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id long, vec array<double>"), "id", "vec")
    asked = index._asks(index.cells.select("id").selectExpr("id", "CAST(NULL AS DOUBLE) AS bound")).collect()
    cells = {r["cell"] for r in index.cells.select("cell").distinct().collect()}
    own = {r["id"]: r["cell"] for r in index.cells.collect()}
    assert sorted(r["id"] for r in asked) == list(range(200)) and all(set(r["targets"]) == cells - {own[r["id"]]} for r in asked)
    assert search(spark, rows, 4)[0] == brute(rows, 4)

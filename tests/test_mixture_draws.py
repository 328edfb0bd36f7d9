"""Draws from a mixture in blocks, fits on counted rows, and noise that is computed once a row."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import functions as F

from gaugeflow.operators import sampling

PARTS = [(np.array([0.0, 5.0]), np.array([[1.0, 0.0], [0.5, 2.0]])), (np.array([20.0, -3.0]), np.array([[0.3, 0.0], [0.0, 0.1]]))]


def test_draws_follow_the_mixture_and_depend_on_ids_only():
    ids = np.arange(60_000)
    x = sampling.mixture_draws(ids, np.array([3.0, 1.0]), PARTS, 7)
    first = x[:, 0] < 12
    assert first.mean() == pytest.approx(0.75, abs=0.01)
    assert np.allclose(x[first].mean(axis=0), [0, 5], atol=0.05) and np.allclose(np.cov(x[first].T), PARTS[0][1] @ PARTS[0][1].T, atol=0.1)
    assert np.allclose(x[~first].mean(axis=0), [20, -3], atol=0.02)
    cut = [sampling.mixture_draws(p, np.array([3.0, 1.0]), PARTS, 7) for p in np.split(ids, [1, 5_000, 5_001, 33_333])]
    assert np.array_equal(np.concatenate(cut), x) and len(np.unique(x, axis=0)) == len(x)
    mixed = np.random.default_rng(1).permutation(ids)[:999]
    assert np.array_equal(sampling.mixture_draws(mixed, np.array([3.0, 1.0]), PARTS, 7), x[mixed])


def test_rows_share_generators(monkeypatch):
    made, new = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda key: made.append(key) or new(key))
    sampling.mixture_draws(np.arange(10_000), np.array([1.0]), PARTS[:1], 7)
    assert len(made) == 3


def test_a_mixture_is_fitted_on_counted_rows(spark, monkeypatch):
    rows, fit = [], GaussianMixture.fit
    monkeypatch.setattr(GaussianMixture, "fit", lambda self, df: rows.append((df.count(), df.agg(F.sum("__w")).first()[0])) or fit(self, df))
    g = np.random.default_rng(5)
    one = [(int(i % 4 > 0), float(g.normal(i % 2 * 50, 1)), float(g.normal(0, 1))) for i in range(400)]
    df = spark.createDataFrame(one * 3, "event_label int, a double, b double")
    out = sampling.gmm_augment(df, ["a", "b"], 2, 3_000)
    assert rows == [(300, 900.0)]
    made = out.where("is_synthetic = 1").toPandas()
    assert len(made) == 3_000 and out.where("is_synthetic = 0").count() == 1_200
    want = np.array([r[1:] for r in one if r[0]])
    assert (made["a"] > 25).mean() == pytest.approx((want[:, 0] > 25).mean(), abs=0.04)
    assert made.loc[made["a"] > 25, "a"].mean() == pytest.approx(want[want[:, 0] > 25, 0].mean(), abs=0.2)


def test_screened_noise_is_computed_once(spark):
    rows = [(int(i % 3 > 0), float(i % 7), None if i % 5 == 0 else float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_label int, a double, b double")
    out = sampling.augment(df, "noise", ["a", "b"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and not [line for line in plan.split("\n") if "Filter" in line and "md5(" in line]
    made = sampling.noise_augment(df, ["a", "b"], 2).where("is_synthetic = 1")
    assert made.count() == 120 and made.where("b is null").count() == 2 * sum(r[0] and r[2] is None for r in rows)

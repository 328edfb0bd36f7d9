"""The mixture's rates against another solver of the same least squares, with the real targets."""

import numpy as np
import pytest

from gaugeflow.llm import mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    mixture = mixing.fit_mixture(docs, labels)
    rows = mixing.with_rates(docs, mixture).select("n_tokens", "posterior", "rate").collect()
    return mixture, np.array([r["n_tokens"] for r in rows], float), np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])


def solve(share, p, goal, ridge, steps=20_000):
    """Accelerated projected gradient on min |(share * rate) @ p - goal|^2 / 2 + ridge / 2 * share @ (rate - 1)^2, rate >= 0."""
    length = 1 / (np.linalg.eigvalsh((p * share[:, None]).T @ p).max() + ridge)
    rate = ahead = np.ones(len(p))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, ahead - length * (p @ ((share * ahead) @ p - goal) + ridge * (ahead - 1)))
        if (share * (ahead - after)) @ (after - rate) > 0:
            t = 1.0
        new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rate, t = after + (t - 1) / new * (after - rate), after, new
    return rate


def test_rates_solve_the_least_squares(fitted):
    mixture, n, p, rate = fitted
    share, goal = n / n.sum(), np.array(list(mixing.TARGET.values()))
    objective = lambda r: ((((share * r) @ p - goal) ** 2).sum() + mixture.ridge * (share @ (r - 1) ** 2)) / 2
    other = solve(share, p, goal, mixture.ridge)
    assert (rate >= 0).all() and objective(rate) <= objective(other) * (1 + 1e-6)
    off = lambda r: np.linalg.norm((share * r) @ p - goal)
    assert abs(off(rate) / off(other) - 1) < 0.01
    assert off(rate) < 0.02
    slope = p @ ((share * rate) @ p - goal) + mixture.ridge * (rate - 1)
    assert np.abs(slope[rate > 1e-9]).max() < 1e-7 and slope[rate == 0].min(initial=0) > -1e-7


def test_targets_that_can_be_met_are_met(spark, fitted):
    _, n, p, _ = fitted
    goal = (n @ p) / n.sum() * [0.8, 1.4, 1.0]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    mixture = mixing.fit_mixture(docs, labels, dict(zip(mixing.TARGET, (goal / goal.sum()).tolist(), strict=True)))
    rows = mixing.with_rates(docs, mixture).select("n_tokens", "posterior", "rate").collect()
    totals = sum(r["n_tokens"] * r["rate"] * np.array(r["posterior"]) for r in rows) / n.sum()
    assert np.abs(totals - goal / goal.sum()).max() < 1e-3


def test_ties_repeats_and_clashing_columns(spark):
    rows = [(i % 7, "same words here" if i % 2 else f"word{i} other", "clash", "clash", 1.5) for i in range(60)] + [(None, None, None, None, None), (8, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, posterior string, copies string, rate double")
    labels = spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(7)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    mixture = mixing.fit_mixture(df, labels)
    got = mixing.with_rates(df, mixture)
    assert got.count() == 62 and sorted(got.columns) == ["copies", "doc_id", "n_tokens", "posterior", "rate", "text"]
    by_text = got.where("text is not null").groupBy("text").agg({"rate": "stddev_pop"}).collect()
    assert all(r[1] < 1e-12 for r in by_text)
    assert mixing.mix(df, mixture).columns == df.columns

"""Logistic regressions of many sets of rows in shared passes, against separate fits and an independent optimiser."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import many_logistic as L
from gaugeflow.operators.detect import fit_logistic, score_rows

FEATURES = ["u", "v"]
SCHEMA = "id int, g string, kind string, u double, v double, event_label int"


@pytest.fixture(scope="module")
def rows():
    g, out = random.Random(3), []
    for i in range(600):
        y = int(g.random() < 0.3)
        out.append((i, f"g{i % 5}", "ab"[i % 2], g.gauss(y, 2), g.gauss(-y, 100) + 5000, y))
    out[7] = (7, "g2", "b", None, float("nan"), 1)
    return out


def minimum(rows, ridge=1e-4):
    """Plain gradient steps on the same objective with numpy, in small steps until they stop."""
    x, y = np.array([[np.nan if v is None else v for v in r[3:5]] for r in rows], float), np.array([r[5] for r in rows], float)
    for j in range(2):
        known = np.sort(x[~np.isnan(x[:, j]), j])
        x[np.isnan(x[:, j]), j] = known[int(np.ceil(len(known) / 2)) - 1]
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z, w = np.column_stack([np.ones(len(y)), (x - mean) / sd]), np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b = np.zeros(3)
    for _ in range(40_000):
        b -= 0.5 * (z.T @ (w * (1 / (1 + np.exp(-z @ b)) - y)) / len(y) + ridge * np.array([0, b[1], b[2]]))
    return b[0] - (b[1:] / sd) @ mean, b[1:] / sd


def test_folds_equal_separate_fits_and_the_minimum(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fits", F.expr("filter(array('g0', 'g1', 'g2', 'g3', 'g4'), x -> x <> g)"))
    together = {r["fit"]: r for r in L.fit_many_logistic(df, FEATURES).collect()}
    assert sorted(together) == [f"g{k}" for k in range(5)]
    for k in (0, 2):
        part = [r for r in rows if r[1] != f"g{k}"]
        alone = L.fit_many_logistic(df.where(F.col("g") != f"g{k}").withColumn("fits", F.array(F.lit("x"))), FEATURES).first()
        one, (intercept, slopes) = together[f"g{k}"], minimum(part)
        assert one["coefficients"] == pytest.approx(alone["coefficients"], rel=1e-6) and one["intercept"] == pytest.approx(alone["intercept"], rel=1e-6)
        assert one["coefficients"] == pytest.approx(slopes, rel=1e-5) and one["intercept"] == pytest.approx(intercept, rel=1e-5)
        assert (one["rows"], one["positive_rows"]) == (len(part), sum(r[5] for r in part))


def test_scores_are_those_of_the_single_fit(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] != 7], SCHEMA)
    models = L.fit_many_logistic(df.withColumn("fits", F.array(F.lit("x"))), FEATURES)
    ours = L.score_many(models, df.withColumn("fit", F.lit("x")), FEATURES).select("id", "score")
    theirs = score_rows(fit_logistic(df, FEATURES), df, "x").select("id", "score__x")
    assert ours.join(theirs, "id").agg(F.max(F.abs(F.col("score") - F.col("score__x")))).first()[0] < 1e-3


def test_blocks_of_fits_and_odd_rows(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fits", F.array("g", F.lit(None).cast("string"), "g", F.lit("all")))
    whole = {r["fit"]: r["coefficients"] for r in L.fit_many_logistic(df, FEATURES).collect()}
    monkeypatch.setattr(L, "CELLS", 30)
    blocks = {r["fit"]: r["coefficients"] for r in L.fit_many_logistic(df, FEATURES).collect()}
    assert sorted(whole) == sorted(blocks) == ["all", "g0", "g1", "g2", "g3", "g4"]
    assert all(whole[f] == pytest.approx(blocks[f], rel=1e-8) for f in whole)
    assert L.fit_many_logistic(df.where("id < 0"), FEATURES).count() == 0
    one_class = L.fit_many_logistic(df.where("event_label = 1"), FEATURES).where("fit = 'all'").first()
    assert one_class["coefficients"] is None and one_class["rows"] == one_class["positive_rows"]


def test_separable_rows_converge(spark):
    df = spark.createDataFrame([(i, "g", "a", float(i), 1.0, int(i >= 10)) for i in range(20)], SCHEMA).withColumn("fits", F.array(F.lit("x")))
    r = L.fit_many_logistic(df, FEATURES).first()
    assert r["coefficients"][0] > 0 and r["coefficients"][1] == pytest.approx(0.0, abs=1e-9)


def test_jobs_do_not_grow_with_groups(spark, rows):
    tracker = spark.sparkContext.statusTracker()

    def jobs(groups):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.concat(F.lit("g"), (F.col("id") % groups).cast("string"))).withColumn("s", F.array(F.lit("all")))
        spark.sparkContext.setJobGroup(f"groups-{groups}", "")
        L.leave_one_out_by_slice(df, "g", "s", FEATURES)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"groups-{groups}"))

    few, many = jobs(3), jobs(30)
    assert abs(few - many) <= 6  # a Newton step more or less


def test_slices_train_and_score_their_own_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slices", F.when(F.col("kind") == "a", F.array(F.lit("a"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    got = L.leave_one_out_by_slice(df, "g", "slices", FEATURES)
    assert {(r["__slice"], r["n"]) for r in got.groupBy("__slice").agg(F.count("*").alias("n")).collect()} == {("a", 300), ("all", 600)}
    intercept, slopes = minimum([r for r in rows if r[2] == "a" and r[1] != "g2"])
    for r in got.where("__slice = 'a' and g = 'g2'").collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(intercept + slopes[0] * r["u"] + slopes[1] * r["v"]))), rel=1e-4)


def test_tasks_without_rows_add_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fits", F.array(F.lit("x")))
    known = L.fit_many_logistic(df, FEATURES).first()
    slim = df.where("id <> 7").select("fits", F.col("event_label").cast("double").alias("y"), F.array("u", "v").alias("x"))
    dealt = slim.repartition(64, F.lit(1))  # all rows in one task, none in the others
    n = L._passes(dealt, ["x", "of no row"], 1, lambda fit, x, y: np.array([len(y)]))
    assert {f: s.tolist() for f, s in n.items()} == {"x": [599.0]}
    assert L._passes(slim.where("y > 1"), ["x"], 1, lambda fit, x, y: np.array([len(y)])) == {}
    assert known["rows"] == 600


def test_sums_that_round_do_not_stop_the_search(spark, rows, monkeypatch):
    passes = L._passes

    def noisy(slim, fits, width, state):
        """Losses that are off by what adding up a hundred million rows in another order makes."""
        noisy.calls += 1
        return {f: np.concatenate([s[:1] * (1 + 2e-13 * noisy.calls), s[1:]]) if width > 6 else s for f, s in passes(slim, fits, width, state).items()}

    noisy.calls = 0
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fits", F.array(F.lit("x")))
    known = L.fit_many_logistic(df, FEATURES).first()
    monkeypatch.setattr(L, "_passes", noisy)
    assert L.fit_many_logistic(df, FEATURES, most=30).first()["coefficients"] == pytest.approx(known["coefficients"], rel=1e-6)

"""Operators of the record tables against plain Python, and the properties that their definitions promise."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.operators import aggregates, compare, detect, graph, joins, metrics, neighbours, sampling, windows


def plain_ap(labels, scores):
    pairs = sorted(zip(scores, labels, strict=True), reverse=True)
    total, tp, n, out, i = sum(labels), 0, 0, 0.0, 0
    while i < len(pairs):
        j, hits = i, 0
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            hits += pairs[j][1]
            j += 1
        tp, n = tp + hits, j
        out += hits / total * tp / n
        i = j
    return out


@pytest.fixture(scope="module")
def tied(spark):
    g = random.Random(1)
    rows = [(f"g{i % 3}", int(g.random() < 0.3), float(g.randrange(20))) for i in range(600)]
    rows += [("one", 1, 0.5), ("one", 1, 0.2), ("flat", 1, 1.0), ("flat", 0, 1.0), ("nan", 1, float("nan")), ("nan", 0, 1.0), ("null", 1, None), ("null", 0, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, event_label int, score double")


@pytest.mark.parametrize("parts", [1, 7])
def test_ranking_metrics(tied, parts):
    rows, df = tied
    got = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"], parts=parts).collect()}
    for name in ("g0", "g1", "g2"):
        y = [r[1] for r in rows if r[0] == name]
        s = [r[2] for r in rows if r[0] == name]
        assert got[name]["ap"] == pytest.approx(plain_ap(y, s), abs=1e-12)
        pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
        assert got[name]["auc"] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]), abs=1e-12)
    assert got["one"]["ap"] is None and got["nan"]["ap"] is None and got["null"]["auc"] is None
    assert got["flat"]["ap"] == 0.5 and got["flat"]["auc"] == 0.5


def test_weights_stand_for_copies(spark, tied):
    rows, df = tied
    w = df.where("g = 'g0'").withColumn("w", (F.col("score") % 3).cast("int"))
    copies = w.where("w > 0").withColumn("c", F.explode(F.sequence(F.lit(1), "w")))
    assert metrics.weighted_average_precision(w, ["g"], "w").first()["ap"] == pytest.approx(metrics.average_precision(copies, ["g"]).first()["ap"])


def stream(spark, values, labels=None, kind="leak"):
    labels = labels or [0] * len(values)
    return spark.createDataFrame([("s", kind, float(t), t, y, float(v), float(v), 0.0) for t, (v, y) in enumerate(zip(values, labels, strict=True))], "s string, scenario_kind string, time_seconds double, event_id int, event_label int, score double, mass_residual double, energy_residual double")


def test_causal_score_is_the_loop_and_ignores_the_future(spark):
    g = random.Random(2)
    x = [g.gauss(0, 1) for _ in range(40)] + [50 + g.gauss(0, 1) for _ in range(20)]
    ref = spark.createDataFrame([("s", 0.0, 1.0, 0.0, 0.0)], "s string, mean__mass_residual double, sd__mass_residual double, mean__energy_residual double, sd__energy_residual double")
    score = lambda v: [r["score"] for r in windows.causal_residual_score(stream(spark, v), ["s"], ref, ["s"]).orderBy("event_id").collect()]
    z = [0.0 if t < 4 else (x[t] - np.mean(x[:t])) / (np.std(x[:t]) + 1e-9) for t in range(60)]
    want = [np.mean(z[max(0, t - 2) : t + 1]) for t in range(60)]
    assert score(x) == pytest.approx(want, abs=1e-9)
    assert score(x)[:40] == pytest.approx(score(x[:40] + [0.0] * 20)[:40])


def test_constant_streams_and_references_score_zero(spark):
    df = stream(spark, [3.0] * 12, kind="baseline")
    ref = windows.normal_reference(df, ["s"], ["mass_residual"])
    assert {r["z__mass_residual"] for r in windows.normalise(df, ref, ["s"], ["mass_residual"]).collect()} == {0.0}
    with pytest.raises(Exception, match="10 are needed"):
        windows.normal_reference(df.limit(9), ["s"], ["mass_residual"]).collect()


def test_alarms_outside_the_window_are_misses(spark):
    labels = [0, 0, 1, 1, 1, 0, 0, 0]
    for at, closed, want in ((6, True, (0, 2.0)), (6, False, (1, 4.0)), (3, True, (1, 1.0)), (4, True, (1, 2.0)), (1, True, (0, 2.0))):
        df = stream(spark, [float(t == at) for t in range(8)], labels)
        r = windows.detection_delay(df, ["s"], F.lit(1.0), closed).first()
        assert (r["detected"], r["delay"]) == want
    early = stream(spark, [1.0] + [0.0] * 7, labels).withColumn("threshold", F.lit(1.0))
    assert windows.pre_onset_alarm(early, ["s"], "threshold").first()["early"] == 1


def test_episodes_and_budget(spark):
    g = random.Random(3)
    v = [round(g.random(), 2) for _ in range(200)]
    df = stream(spark, v, kind="baseline").withColumn("threshold", F.lit(0.7))
    count = lambda t: sum(a >= t and (i == 0 or v[i - 1] < t) for i, a in enumerate(v))
    assert windows.alarm_episodes(df, ["s"], "threshold").first()["episodes"] == count(0.7)
    df = df.withColumn("time_seconds", F.col("time_seconds") * 3600)
    levels = sorted(set(np.quantile(v, 1 - np.geomspace(0.3, 1e-6, 400))))
    want = next(t for t in levels if count(t) <= 2.0 * 200 / 24)
    assert windows.budget_threshold(df, ["s"], ["s"], 2.0, ["s"]).first()["threshold"] == pytest.approx(want, abs=1e-9)


def test_wilcoxon(spark):
    rows = [("all", float(i)) for i in range(1, 9)] + [("zero", 0.0)] * 3 + [("mixed", d) for d in (-1.0, 2.0, 3.0, -4.0, 5.0)]
    got = {r["g"]: r for r in compare.wilcoxon(spark.createDataFrame(rows, "g string, delta double"), ["g"]).collect()}
    assert got["all"]["p"] == pytest.approx(2 / 2**8) and got["zero"]["p"] == 1.0
    assert got["mixed"]["statistic"] == 5.0 and got["mixed"]["p"] == pytest.approx(0.625)


def test_holm(spark):
    got = compare.holm(spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, arm string, p double"), ["f"])
    assert {r["arm"]: round(r["p_holm"], 9) for r in got.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_draws_repeat_and_keep_their_number(spark):
    m = spark.createDataFrame([("n", i) for i in range(9)], "g string, id int")
    a, b = ([tuple(r) for r in compare.draws(m, ["g"], "id", 5, "x").orderBy("b", "id").collect()] for _ in range(2))
    assert a == b and all(sum(r[3] for r in a if r[1] == k) == 9 for k in range(5))


def test_screen_keeps_constant_columns(spark):
    g = random.Random(4)
    df = spark.createDataFrame([(g.gauss(0, 1), g.gauss(5, 1), 0.0, 0.0, 1) for _ in range(500)], "a double, b double, c double, d double, event_label int")
    names = ["a", "b", "c", "d"]
    bounds = sampling.fit_quantile_screen(df, names)
    assert sampling.apply_quantile_screen(df, bounds, names).count() > 400
    far = df.limit(100).withColumn("b", F.lit(5000.0))
    assert sampling.apply_quantile_screen(far, bounds, names).count() == 0
    with pytest.raises(ValueError, match="isn't fitted"):
        sampling.apply_quantile_screen(df, bounds, ["e"])


def test_placement_is_the_same_for_all_scenarios(spark):
    s = spark.createDataFrame([("n", i) for i in range(400)], "network_id string, sensor_id int")
    place = lambda seed, cov: {r["sensor_id"] for r in sampling.place_sensors(s, cov, seed).collect()}
    assert len(place(1, 0.25)) == 100 and place(1, 0.25) == place(1, 0.25) != place(2, 0.25)
    assert sampling.place_sensors_stride(s, 0.25).count() == 100


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 17)
    x = np.random.default_rng(5).normal(size=(50, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    got = {(r["id"], r["neighbour"]) for r in neighbours.knn_pairs(df, "id", "vec", 6).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(50) for j in np.argsort(d[i])[:6]}


def test_smote_fills_up_to_the_negatives(spark):
    g = random.Random(6)
    df = spark.createDataFrame([(i, [g.random(), g.random()], int(i < 20)) for i in range(100)], "id int, vec array<double>, event_label int")
    out = sampling.smote_augment(df, "vec", 5)
    assert out.where("event_label = 1").count() == 80 and out.where("is_synthetic = 1").count() == 60
    assert sampling.smote_augment(df.where("event_label = 0"), "vec").where("is_synthetic = 1").count() == 0


def test_guards(spark):
    with pytest.raises(ValueError, match="leak_area"):
        joins.guard_no_metadata(["pressure_mean", "leak_area"])
    with pytest.raises(ValueError, match="sum to 1"):
        joins.validate_split({"a": 0.5, "b": 0.4})
    df = spark.createDataFrame([("x", 1.0, 1)], "s string, a double, y int")
    assert joins.select_numeric_features(df, "y") == ["a"]
    for args in ((["a", "a"],), (["a"], ["b"], "a"), (["zz"],)):
        with pytest.raises(ValueError, match="feature|missing"):
            joins.validate_schema(df, *args)
    with pytest.raises(Exception, match="unknown benchmark"):
        joins.resolve_splits(df, df.limit(0).select("s", F.lit(1).alias("z")), "s").collect()


def test_event_windows_are_never_empty(spark):
    df = spark.createDataFrame([(d, u) for d in (0, -1, 86400, 604800) for u in (0.0, 0.5, 1.0)], "d int, u double")
    d = scalar.effective_duration(F.col("d"))
    for w in (scalar.event_window(d, F.lit(3600)), scalar.event_window(d, F.lit(3600), F.col("u"), F.col("u"))):
        assert all(r["w"]["end"] > r["w"]["start"] >= 0 for r in df.select(w.alias("w")).collect())


def test_betweenness_of_a_path_and_a_star(spark):
    e = spark.createDataFrame([("path", "a", "b"), ("path", "b", "c"), ("path", "c", "d"), ("star", "m", "x"), ("star", "m", "y"), ("star", "m", "z")], "network_id string, src string, dst string")
    got = {(r["network_id"], r["node"]): r["centrality"] for r in graph.betweenness(e, chunk=2).collect()}
    assert got["path", "b"] == pytest.approx(2 / 3) and got["path", "a"] == 0 and got["star", "m"] == pytest.approx(1.0)


def test_weights_balance_classes(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(12)], "i int, event_label int")
    got = {r["event_label"]: r["w"] for r in detect.class_weights(df).groupBy("event_label").agg(F.sum("weight").alias("w")).collect()}
    assert got == {0: pytest.approx(6.0), 1: pytest.approx(6.0)}


def test_macro_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 2.0, None)], "g string, x double, w double")
    got = {r["g"]: r["macro"] for r in aggregates.macro_weighted(df, ["g"], "x", F.col("w")).collect()}
    assert got == {"a": 0.0, "b": 2.0} and math.isclose(sum(got.values()), 2.0)

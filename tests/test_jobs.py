"""Composed evaluations on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import detect, jobs

STREAM = ["seed", "network_id", "scenario_id", "sensor_coverage"]


def streams(spark, rows):
    """Long readings of three steps a stream from (network, scenario, kind, level)."""
    out = []
    for net, sid, kind, level in rows:
        for t in range(3):
            for k, channel in enumerate(("pressure", "demand", "flow")):
                out.append((42, net, sid, 0.5, kind, int(kind != "baseline" and t > 0), float(t), k, channel, level + 0.1 * t + k + 20))
    return spark.createDataFrame(out, "seed int, network_id string, scenario_id long, sensor_coverage double, scenario_kind string, event_label int, time_seconds double, sensor_id int, channel string, value double")


FEATURES = ["pressure_mean", "demand_mean", "flow_mean"]


def test_scenarios_that_differ_are_told_apart(spark):
    rows = [(f"n{i % 2}", i, "leak" if i % 3 == 0 else "baseline", 10.0 if i % 3 == 0 else 0.1 * (i % 5)) for i in range(60)]
    table = jobs.scenario_table(streams(spark, rows), STREAM)
    assert table.count() == 60 and table.agg(F.sum("event_label")).first()[0] == 20
    found = jobs.scenario_evaluation(table.where("scenario_id < 36"), table.where("scenario_id >= 36"), STREAM, FEATURES, [0.5], ["leak"], 2, trees=5, draws=50).collect()
    assert {r["model"] for r in found} == {"forest", "triage"}
    for r in found:
        assert (r["status"], r["n_train"], r["n_test"], r["support"]) == ("ok", 36, 24, 24) and r["ap"] == r["auc"] == r["f1"] == 1.0
        assert r["lo"] == r["hi"] == 1.0 and 0 < r["valid"] <= 50
    # Too few steps, an unknown coverage or kind: the empty side is named.
    for more in (([0.5], ["leak"], 4), ([0.25], ["leak"], 1)):
        one = jobs.scenario_evaluation(table, table, STREAM, FEATURES, *more, trees=5).collect()
        assert len(one) == 1 and one[0]["status"] == "empty_train" and one[0]["ap"] is None
    normal = jobs.scenario_evaluation(table.where("event_label = 0"), table, STREAM, FEATURES, [0.5], ["leak"], 1, trees=5, draws=20).collect()
    assert {(r["model"], r["support"]) for r in normal} == {("forest", 60), ("triage", 60)} and {r["recall"] for r in normal} == {0.0}


def test_triage_takes_every_column_that_there_is(spark):
    table = jobs.scenario_table(streams(spark, [("n", 1, "leak", 1.0), ("n", 2, "baseline", 0.0)]), STREAM).withColumn("base_score", F.lit(0.5))
    frame = jobs.triage_frame(table, table.where("event_label = 0"))
    assert jobs.triage_columns(frame) == [c for c in jobs.TRIAGE if c != "simulation_residual"]
    assert jobs.triage_columns(frame.withColumn("simulation_residual", F.lit(0.0)).drop("mass")) == [c for c in jobs.TRIAGE if c != "mass"]
    assert frame.where("score_by_coverage <> 0.25").count() == 0 and table.columns + ["base_score"] != frame.columns


def test_copies_have_one_factor_a_scenario(spark):
    df = spark.createDataFrame([(s, float(t), 10.0, 5.0) for s in range(40) for t in range(3)], "scenario_id int, t double, demand double, pressure double")
    made = jobs.perturbed_copies(df, ["demand"], 2, ["scenario_id"])
    assert made.count() == 240 and made.where("pressure <> 5.0").count() == 0
    factors = made.groupBy("scenario_id", "copy").agg(F.count_distinct("demand").alias("n"), (F.first("demand") / 10).alias("f")).collect()
    assert len(factors) == 80 and {r["n"] for r in factors} == {1} and len({r["f"] for r in factors}) > 70
    assert all(0.5 <= r["f"] <= 2 for r in factors) and abs(sum(r["f"] for r in factors) / 80 - 1) < 0.1


def test_randomised_training_falls_back_to_the_clean_rows(spark):
    clean = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, only string")
    none = jobs.randomised_training(clean, jobs.perturbed_copies(clean, ["b"], 0, ["a"]))
    assert none.columns == ["a", "b", "only", "origin"] and [r["origin"] for r in none.collect()] == ["clean"]
    both = jobs.randomised_training(clean, spark.createDataFrame([(3.0, 5)], "b double, a int"))
    assert both.columns == ["a", "b", "origin"] and sorted(map(tuple, both.collect())) == [(1, 2.0, "clean"), (5, 3.0, "noisy")]


def test_normals_are_drawn_whole_and_repeatably(spark):
    ids = spark.createDataFrame([("big", i) for i in range(30)] * 2 + [("small", i) for i in range(3)], "network_id string, scenario_id int")
    one, two = (sorted(map(tuple, jobs.drawn_normals(x, 5, 42).collect())) for x in (ids, ids.orderBy(F.rand(1))))
    assert one == two and [r[0] for r in one].count("big") == 5 and [r[0] for r in one].count("small") == 3
    assert {r[2] for r in one if r[0] == "small"} == {f"small__normal__{j:04d}" for j in range(3)}
    assert sorted(map(tuple, jobs.drawn_normals(ids, 5, 7).collect())) != one


def test_more_normals_lower_the_prior(spark):
    df = spark.createDataFrame([("n", "a", i, 42, 0.5, k, int(k == "leak"), s) for i, k, s in [(1, "leak", 0.9), (2, "leak", 0.4)] + [(j, "baseline", 0.1 + j / 100) for j in range(10, 50)]],
                               "network_id string, arm string, scenario_id int, seed int, sensor_coverage double, scenario_kind string, event_label int, score double")
    split = df.where("event_label = 1"), df.where("event_label = 0")
    few, many = (jobs.rare_prior_benchmark(*split, n, 42).first() for n in (4, 40))
    assert (few["n_scenarios"], few["n_positive"], many["n_scenarios"]) == (6, 2, 42)
    assert few["positive_rate"] == pytest.approx(2 / 6) and many["positive_rate"] == pytest.approx(2 / 42)
    above = sum(0.1 + j / 100 >= 0.4 for j in range(10, 50))  # equal scores share a threshold
    assert many["pooled_ap"] == many["row_ap"] == pytest.approx(0.5 + 0.5 * 2 / (2 + above))


def test_plausible_sources_that_help_more_correlate(spark):
    report = spark.createDataFrame([("f", s, p) for s, p in (("base", 0.1), ("x", 0.5), ("y", 0.9), ("z", 0.95))], "family string, source string, score_mean double")
    metrics = spark.createDataFrame([("f", s, a) for s, a in (("base", 0.3), ("x", 0.4), ("y", 0.6), ("lonely", 0.1))], "family string, source string, ap double")
    r = jobs.plausibility_vs_utility(report, metrics, ["family"], "source", "base").first()
    assert (r["rho"], r["n"], r["p"]) == (pytest.approx(1.0), 3, pytest.approx(0.0))


def test_suite_rows_hold_splits_and_seeds(spark):
    rows = [("r", "e", 1, "test", 0.5, 0.6), ("r", "e", 2, "test", 0.7, 0.8), ("r", "e", 1, "train", 0.9, 1.0), ("q", "e", 2, "test", 0.1, None)]
    found = {r["run"]: r for r in jobs.suite_table(spark.createDataFrame(rows, "run string, experiment string, seed int, split string, f1 double, ap double"), ["train", "validation", "test"], ["validation", "test"], draws=200).collect()}
    r = found["r"]
    assert (r["train_f1"], r["test_ap"], r["validation_f1"]) == (0.9, 0.6, None) and r["test_f1_n"] == 2
    assert r["test_f1_mean"] == pytest.approx(0.6) and r["test_f1_std"] == pytest.approx(0.02**0.5) and r["test_f1_lo"] >= 0.5 and r["test_f1_hi"] <= 0.7
    assert (found["q"]["test_f1"], found["q"]["test_f1_mean"], found["q"]["test_f1_std"], found["q"]["test_ap_mean"]) == (0.1, 0.1, None, None)


def test_only_successful_runs_count(spark):
    rows = [("a", 0, 0.5, None), ("a", 0, 0.7, None), ("a", 1, 0.0, 0.0), ("a", None, 0.0, 0.0), ("b", 0, 0.4, 0.2), ("c", 2, 1.0, 1.0)]
    found = jobs.validation_summary(spark.createDataFrame(rows, "arm string, return_code int, ap double, f1 double"), ["arm"], ["ap", "f1"])
    known = {(r["arm"], r["metric"]): (r["mean"], r["std"], r["n"]) for r in found.collect()}
    assert known[("a", "ap")] == (pytest.approx(0.6), pytest.approx(0.1), 2) and known[("a", "f1")] == (None, None, 0)
    assert known[("b", "ap")] == (0.4, 0.0, 1) and ("c", "ap") not in known


def test_grid_gives_differences_to_the_baseline(spark):
    df = spark.createDataFrame([(seed, f"n{i % 2}", i, float(i % 2 if i % 5 else 1 - i % 2), float(i % 7), i % 2) for seed in (1, 2) for i in range(80)], "seed int, network_id string, scenario_id int, x double, y double, event_label int")
    df = df.withColumn("event_label", (F.col("x") > 0).cast("int"))
    found = jobs.classifier_grid(df.where("scenario_id < 40"), df.where("scenario_id >= 40"), ["none", "noise"], ["logistic"], ["x", "y"], trees=3).collect()
    known = {(r["how"], r["classifier"]): r for r in found}
    assert known[("none", "logistic")]["delta"] == 0 and known[("none", "logistic")]["mean"] == pytest.approx(1.0) and known[("none", "logistic")]["n"] == 2
    assert known[("noise", "logistic")]["delta"] == pytest.approx(known[("noise", "logistic")]["mean"] - 1)


def test_rows_of_unknown_networks_are_scored(spark):
    edges = spark.createDataFrame([("n0", "a", "b"), ("n1", "a", "b")], "network_id string, src string, dst string")
    nodes = spark.createDataFrame([(n, x, h) for n, h in (("n0", 1.0), ("n1", 5.0)) for x in "ab"], "network_id string, node string, head double")
    df = spark.createDataFrame([(f"n{i % 3}", i, float(i % 4), int(i % 3 == 1)) for i in range(60)], "network_id string, i int, x double, event_label int")
    out = jobs.topology_scores(df, df, edges, nodes, ["head"], ["x"])
    assert out.columns == [*df.columns, "score__topology"] and out.count() == 60
    by = {r["network_id"]: r["s"] for r in out.groupBy("network_id").agg(F.avg("score__topology").alias("s")).collect()}
    assert by["n1"] > 0.8 > 0.3 > by["n0"] and by["n2"] is not None


def test_rows_are_scored_once_for_all_metrics(spark):
    df = spark.createDataFrame([(f"n{i % 2}", i, float(i % 2 if i % 5 else 1 - i % 2), float(i % 7), i % 2) for i in range(80)], "network_id string, i int, x double, y double, event_label int")
    made = spark.sparkContext.accumulator(0)

    def counted(v):
        made.add(1)
        return v

    test = df.withColumn("x", F.udf(counted, "double").asNondeterministic()("x"))
    arms = {"plain": ("none", "logistic"), "noise": ("noise", "logistic"), "trees": ("none", "forest")}
    scored = detect.arm_benchmark(df, test, arms, ["x", "y"], 3)
    found = detect.evaluate_networks(scored, list(arms), ["network_id"])
    assert len(found.collect()) == len(found.collect()) == 6  # as metrics in ranges read them several times
    assert made.value == 80

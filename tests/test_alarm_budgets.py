"""Alarm budgets: many budgets off one curve against the plain rule, whatever the number of ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import windows as W

STREAM, BY, STEP_BY, BUDGETS = ["seed", "network_id", "scenario_id", "sensor_coverage"], ["seed", "network_id", "sensor_coverage"], ["seed", "network_id"], [0.5, 1.0, 2.0, 50.0]


@pytest.fixture(scope="module")
def rows():
    g, out = random.Random(5), []
    for seed in (1, 2):
        for scenario in range(10):
            kind = "leak" if scenario < 4 else "baseline"
            for coverage in (0.25, 0.5):
                for t in range(40):
                    on = int(kind == "leak" and 15 <= t < 30)
                    out.append((seed, "n", scenario, coverage, kind, t * 3600.0, t, on, round(g.gauss(on, 1), 1)))
    return out


def plain(rows, budget):
    """Per group the threshold and the rates, by the definition."""
    groups, found = {}, {}
    for r in rows:
        groups.setdefault((r[0], r[1], r[3]), {}).setdefault((r[2], r[4]), []).append(r)
    for by, streams in groups.items():
        normal = [np.array([r[8] for r in x]) for (_, kind), x in streams.items() if kind == "baseline"]
        flat, days = np.concatenate(normal), sum(map(len, normal)) / 24.0
        starts = lambda x, t: int((np.diff(np.r_[0, (x >= t).astype(int)]) == 1).sum())
        fits = [t for t in np.unique(np.quantile(flat, 1 - np.geomspace(0.3, 1e-6, 400))) if sum(starts(x, t) for x in normal) / days <= budget]
        t = fits[0] if fits else flat.max() + 1e-9
        soon, inside, early = [], [], []
        for (_, kind), x in streams.items():
            if kind == "leak":
                hits = [r[5] for r in x if r[7] == 1 and r[8] >= t]
                soon.append(bool(hits) and hits[0] - 15 * 3600.0 < 10800)
                inside.append(bool(hits))
                early.append(any(r[8] >= t for r in x if r[6] < 15))
        found[by] = (t, np.mean(soon), np.mean(inside), np.mean(early))
    return found


@pytest.mark.parametrize("parts", [1, 5])
def test_rates_of_all_budgets(spark, rows, parts):
    df = spark.createDataFrame(rows, "seed int, network_id string, scenario_id int, sensor_coverage double, scenario_kind string, time_seconds double, event_id int, event_label int, score double")
    rates = W.alarm_budget(df, STREAM, BY, BUDGETS, STEP_BY, parts=parts).collect()
    assert len(rates) == 4 * len(BUDGETS)
    for budget in BUDGETS:
        want = plain(rows, budget)
        levels = {(r["seed"], r["network_id"], r["sensor_coverage"]): r["threshold"] for r in W.budget_threshold(df, STREAM, BY, budget, STEP_BY, parts=parts).collect()}
        for r in rates:
            if r["budget"] == budget:
                by = (r["seed"], r["network_id"], r["sensor_coverage"])
                assert levels[by] == pytest.approx(want[by][0], abs=1e-8)
                assert (r["within_3h"], r["in_window"], r["pre_onset"]) == pytest.approx(want[by][1:])
                assert (r["n_streams"], r["step_hours"], r["steps_3h"]) == (4, 1.0, 3)


def test_summary_pools_streams_before_it_averages_seeds(spark):
    rates = spark.createDataFrame([(1, "n", 0.25, 1.0, 1.0, 1.0, 0.0, 1), (1, "n", 0.5, 1.0, 0.0, 1.0, 0.0, 3), (2, "n", 0.25, 1.0, 0.75, 1.0, 0.0, 9)], "seed int, network_id string, sensor_coverage double, budget double, within_3h double, in_window double, pre_onset double, n_streams long")
    r = W.alarm_budget_summary(rates, STEP_BY, ["network_id"]).first()
    assert (r["within_3h_mean"], r["within_3h_std"], r["in_window_std"], r["n_runs"]) == (0.5, 0.25, 0.0, 2)


def test_scans_do_not_grow_with_budgets(spark, rows, tmp_path):
    schema = "seed int, network_id string, scenario_id int, sensor_coverage double, scenario_kind string, time_seconds double, event_id int, event_label int, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/r")
    df = spark.read.parquet(f"{tmp_path}/r")
    scans = [W.alarm_budget(df, STREAM, BY, b, STEP_BY)._jdf.queryExecution().optimizedPlan().collectLeaves().size() for b in (BUDGETS[:1], BUDGETS)]
    assert scans[0] == scans[1]
    assert W.alarm_budget(df.where(F.lit(False)), STREAM, BY, BUDGETS, STEP_BY).count() == 0

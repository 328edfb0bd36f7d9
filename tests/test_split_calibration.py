import random
from collections import defaultdict

import numpy as np
import pytest

from gaugeflow.operators import calibration
from gaugeflow.operators.sampling import halves

STREAM = ["network_id", "scenario_id", "sensor_coverage"]


def average_precision(score, label):
    score, label = np.array(score), np.array(label)
    out = 0.0
    for s in sorted(set(score.tolist()), reverse=True):
        at = score >= s
        out += label[score == s].sum() / label.sum() * label[at].sum() / at.sum()
    return out


def test_metrics_equal_plain_python(spark):
    g = random.Random(4)
    rows = []
    for net in ("n0", "n1"):
        for s in range(12):
            kind = ["baseline", "leak", "pipe_closure"][s % 3]
            for t in range(8):
                on = int(kind != "baseline" and t >= 4)
                rows.append((net, s, 0.5, kind, float(t * 3600), on, round(g.gauss(on * 1.5 + (net == "n1"), 1), 2)))
    columns = ["network_id", "scenario_id", "sensor_coverage", "scenario_kind", "time_seconds", "event_label", "x"]
    df = spark.createDataFrame(rows, columns)
    half = {(r["network_id"], r["scenario_id"]): r["half"] for r in halves(df, 7).collect()}
    want = defaultdict(list)
    for net in ("n0", "n1"):
        own = [r for r in rows if r[0] == net]
        for fold in (0, 1):
            held = [r for r in own if r[3] == "baseline" and half[net, r[1]] == fold]
            seen = [r for r in own if r not in held]
            for tag, base in (("split", held), ("full", [r for r in own if r[3] == "baseline"])):
                m, sd = np.mean([r[6] for r in base]), np.std([r[6] for r in base])
                z = lambda r: (r[6] - m) / sd  # noqa: B023, E731
                limit = np.quantile([z(r) for r in held], 1 - 1 / 8)
                streams = {s: [r for r in seen if r[1] == s] for s in {r[1] for r in seen}}
                delays = []
                for x in streams.values():
                    if x[0][3] == "leak":
                        hit = [r[4] for r in x if r[5] and z(r) >= limit]
                        delays.append(((hit[0] if hit else x[-1][4]) - 4 * 3600.0, bool(hit)))
                alarms = [sum(z(r) >= limit for r in x) for x in streams.values() if x[0][3] == "baseline"]
                want[net, tag].append((
                    average_precision([z(r) for r in seen], [r[5] for r in seen]), np.mean([r[5] for r in seen]),
                    average_precision([max(z(r) for r in x) for x in streams.values()], [max(r[5] for r in x) for x in streams.values()]),
                    np.median([d for d, _ in delays]), np.mean([h and d < 10800 for d, h in delays]), np.mean(alarms),
                ))
    found = calibration.split_metrics(calibration.split_scores(df, 7, "x"), STREAM)
    got = {(r["network_id"], r["tag"]): [r[c] for c in ("row_ap", "row_prior", "stream_ap", "median_delay", "within_3h", "false_alarm_rows")] for r in found.collect()}
    assert got.keys() == want.keys()
    for key, values in got.items():
        assert values == pytest.approx(np.mean(want[key], axis=0).tolist(), abs=1e-6), key
    diff = {n: np.mean(want[n, "split"], axis=0)[0] - np.mean(want[n, "full"], axis=0)[0] for n in ("n0", "n1")}
    for r in calibration.split_difference(found).collect():
        assert r["difference"] == pytest.approx(diff[r["network_id"]], abs=1e-6)
        assert r["mean_difference"] == pytest.approx(np.mean(list(diff.values())), abs=1e-6) and r["max_difference"] == pytest.approx(max(map(abs, diff.values())), abs=1e-6)

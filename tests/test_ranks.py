"""Ranks in ranges against ranks in one, draws in arrays against draws as rows, and both against plain Python."""

import hashlib
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import compare, graph, metrics, neighbours, ranks, windows


@pytest.fixture(scope="module")
def scored(spark):
    g = random.Random(2)
    rows = [(f"g{i % 2}", i // 20, i, float(i), "baseline" if i % 5 else "leak", int(g.random() < 0.3), round(g.gauss(0, 1) ** 3, 1) if i % 3 else 0.0) for i in range(900)]
    return spark.createDataFrame(rows, "g string, scenario_id long, event_id long, time_seconds double, scenario_kind string, event_label int, score double").cache()


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_plain_python(scored, descending):
    counts = scored.groupBy("g", "score").agg(F.count(F.lit(1)).alias("c"))
    want = []
    for name in ("g0", "g1"):
        some = sorted(((r["score"], r["c"]) for r in counts.where(F.col("g") == name).collect()), reverse=descending)
        want += [(name, s, c, sum(x for _, x in some[: i + 1]), sum(x for _, x in some)) for i, (s, c) in enumerate(some)]
    for parts in (1, 2, 7):
        got = ranks.cumulative(counts, ["g"], "score", ["c"], descending, parts=parts)
        assert rounded(got.drop("__part")) == sorted(want)
        assert parts == 1 or got.select("__part").distinct().count() > 1


def test_ranges_make_no_difference(scored):
    by = ["g"]
    ap = [rounded(metrics.ranking_metrics(scored, by, parts=p)) for p in (1, 5)]
    high = [rounded(windows.exceedance_threshold(scored, ["g", "scenario_id"], by, parts=p)) for p in (1, 5)]
    budget = [rounded(windows.budget_threshold(scored, ["g", "scenario_id"], by, 400.0, by, parts=p)) for p in (1, 5)]
    assert ap[0] == ap[1] and high[0] == high[1] and budget[0] == budget[1]
    normal = [r["score"] for r in scored.where("g = 'g0' and scenario_kind = 'baseline'").collect()]
    streams = scored.where("g = 'g0' and scenario_kind = 'baseline'").select("scenario_id").distinct().count()
    assert high[0][0][1] == pytest.approx(np.quantile(normal, 1 - streams / len(normal)))


def test_scores_that_are_no_numbers_void_a_group(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, float("nan")), ("b", 1, None), ("b", 0, 0.1), ("c", 1, 0.9), ("c", 0, 0.2)], "g string, event_label int, score double")
    for parts in (1, 3):
        assert {r["g"]: r["ap"] for r in metrics.ranking_metrics(df, ["g"], parts=parts).collect()} == {"a": None, "b": None, "c": 1.0}


def test_correlation_of_ranks(scored):
    got = compare.spearman(scored, ["g"], "score", "time_seconds").collect()
    for r in got:
        rows = [(x["score"], x["time_seconds"]) for x in scored.where(F.col("g") == r["g"]).collect()]
        rank = lambda v: np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])
        assert r["n"] == len(rows) and r["rho"] == pytest.approx(np.corrcoef(rank([a for a, _ in rows]), rank([b for _, b in rows]))[0, 1])


def test_draws_in_arrays_equal_draws_as_rows(scored, monkeypatch):
    slim = scored.groupBy("g", "scenario_id", "score", "event_label").agg(F.count(F.lit(1)).alias("rows"))
    one = rounded(compare.drawn_ap(slim, ["g"], ["g", "scenario_id"], 20, "s"))
    monkeypatch.setattr(compare, "parts_for", lambda df: 2)
    assert one == rounded(compare.drawn_ap(slim, ["g"], ["g", "scenario_id"], 20, "s")) and len(one) == 40
    monkeypatch.setattr(compare, "CELLS", 100)
    monkeypatch.setattr(compare, "parts_for", lambda df: 1)
    assert one == rounded(compare.drawn_ap(slim, ["g"], ["g", "scenario_id"], 20, "s"))


def test_draws_follow_their_hash(spark):
    df = spark.createDataFrame([(f"m{i}",) for i in range(300)], "m string")
    got = {(r["m"], r["b"]): r["times"] for r in compare.with_draws(df, ["m"], 11, "x").collect()}
    for i in range(300):
        for b in range(11):
            digest = hashlib.md5(f"x|{b // 8}|m{i}".encode()).hexdigest()
            assert got.get((f"m{i}", b), 0) == sum(int(digest[b % 8 * 4 : b % 8 * 4 + 4], 16) >= t for t in compare.TIMES)
    assert abs(sum(got.values()) / 3300 - 1) < 0.05


def test_betweenness_equals_counting_paths(spark, monkeypatch):
    g = random.Random(6)
    links = {(f"n{g.randrange(25)}", f"n{g.randrange(25)}") for _ in range(45)} | {("x1", "x2"), ("x2", "x3")}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def search(source):
        depth, paths, queue = {source: 0}, defaultdict(int, {source: 1}), deque([source])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        return depth, paths

    found = {v: search(v) for v in near}
    want = {}
    for v in near:
        through = 0.0
        for s in near:
            for t in near:
                if len({s, t, v}) == 3 and t in found[s][0] and v in found[s][0] and t in found[v][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]:
                    through += found[s][1][v] * found[v][1][t] / found[s][1][t]
        want[v] = through / ((len(near) - 1) * (len(near) - 2))
    monkeypatch.setattr(graph, "SOURCES", 4)
    df = spark.createDataFrame([("net", a, b) for a, b in links], "network_id string, src string, dst string")
    got = {r["node"]: r["centrality"] for r in graph.betweenness(df, chunk=7).collect()}
    assert got == pytest.approx(want)


def test_neighbours_of_equal_points_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    rows = [(i, [float(i % 4), 0.1 * (i % 4), 7.3]) for i in range(40)]
    got = defaultdict(list)
    for r in neighbours.knn_pairs(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 12).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    for i, v in rows:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)
        assert got[i] == [j for _, j in near[:12]]


def test_ranks_are_looked_up_without_frames_that_run_to_the_end(spark):
    values = spark.range(2_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("c"))
    ranked = ranks.cumulative(values, ["g"], "v", ["c"], parts=1)
    wanted = spark.createDataFrame([(g, k) for g in (0, 1) for k in (1, 2, 500, 1_000, 1_001)], "g long, k long")
    found = ranks.at_ranks(ranked, ["g"], "c_upto", ["v"], wanted, "k")
    assert {(r["g"], r["k"]): r["v"] for r in found.collect()} == {(g, k): 2.0 * (k - 1) + g for g in (0, 1) for k in (1, 2, 500, 1_000)}
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_equal_percentiles_of_all_values(spark, parts):
    g = np.random.default_rng(4)
    rows = [(f"g{i % 3}", float(g.integers(0, 40)) / 7 if i % 5 else None, float(g.normal())) for i in range(1_000)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {(r["g"], r["value"]): r["q"] for r in ranks.quantiles(df, ["g"], ["a", "b"], [0.0, 0.013, 0.5, 0.99], parts=parts).collect()}
    assert got.pop(("none", "a")) is None and len(got) == 7
    for (name, column), q in got.items():
        values = [r["ab".index(column) + 1] for r in rows if r[0] == name and r["ab".index(column) + 1] is not None]
        assert np.allclose(q, np.quantile(values, [0.0, 0.013, 0.5, 0.99]), rtol=0, atol=1e-12)
    whole = {r["value"]: r["q"] for r in ranks.quantiles(df.where("g = 'none'"), [], ["a", "b"], [0.5], parts=parts).collect()}
    assert whole == {"a": None, "b": [1.0]}


def test_bounds_and_histograms_hold_no_values_of_a_group_in_one_task(spark):
    from gaugeflow.operators import aggregates, detect, sampling

    df = spark.range(100).select(F.lit("N").alias("source"), F.col("id").cast("double").alias("x"), F.lit(0).alias("event_label"))
    for made in (detect.fit_bounds(df, ["x"]), aggregates.density_histogram(df, "source", "x", "N"), sampling.fit_quantile_screen(df, ["x"])):
        assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [round(r["lo"], 9) for r in detect.fit_bounds(df, ["x"]).collect()] == [24.75 - 1.5 * 49.5]

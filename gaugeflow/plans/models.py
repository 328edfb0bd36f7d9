"""Detectors, neighbours, graph operators and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import aggregates as A
from gaugeflow.operators import compare as C
from gaugeflow.operators import detect as D
from gaugeflow.operators import graph as N
from gaugeflow.operators import joins as J
from gaugeflow.operators import metrics as M
from gaugeflow.operators import neighbours as K
from gaugeflow.operators import windows as W
from gaugeflow.operators.supersteps import Supersteps
from gaugeflow.plans.aggregates import PLAUSIBLE, plausible
from gaugeflow.plans.compare import boot_ap_sql, student_sql
from gaugeflow.plans.joins import _points
from gaugeflow.plans.metrics import ap_sql
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import EDGES, KINDS, LONG, RECORDS, STEPS, STREAM, arm_records, edges, records, steps, table

FEATURES = ["pressure_mean", "demand_mean", "flow_mean", "pressure_std"]
ARMS = {"forest": ("none", "forest"), "logistic": ("none", "logistic"), "noise": ("noise", "logistic")}


def _split(spark, sf_dir):
    df = steps(spark, sf_dir)
    return df.where("floor(scenario_id / 4) % 4 <> 0"), df.where("floor(scenario_id / 4) % 4 = 0")


@query("d3_class_weights", f"WITH {STEPS}, c AS (SELECT event_label, count(*) AS c FROM steps GROUP BY event_label) SELECT event_label, {r('sum((SELECT sum(c) FROM c) / (2.0 * c.c))')} AS total FROM steps JOIN c USING (event_label) GROUP BY event_label")
def d3(spark, sf_dir):
    return D.class_weights(steps(spark, sf_dir)).groupBy("event_label").agg(F.sum("weight").alias("total"))


@query("d5_majority_detector", f"WITH {STEPS} SELECT network_id, (SELECT CASE WHEN count(*) FILTER (event_label = 1) >= count(*) FILTER (event_label = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM steps) AS score, count(*) AS n FROM steps GROUP BY network_id")
def d5(spark, sf_dir):
    df = steps(spark, sf_dir)
    return D.majority_detector(df, df).groupBy("network_id", "score").agg(F.count(F.lit(1)).alias("n"))


BOUNDS = STEPS + """, b AS (SELECT quantile_cont(pressure_mean, 0.25) AS p1, quantile_cont(pressure_mean, 0.75) AS q1, quantile_cont(demand_mean, 0.25) AS p2, quantile_cont(demand_mean, 0.75) AS q2 FROM steps WHERE event_label = 0)"""


@query("d6_d7_iqr_bounds", f"WITH {BOUNDS}, s AS (SELECT source, CASE WHEN pressure_mean NOT BETWEEN p1 - 1.5 * (q1 - p1) AND q1 + 1.5 * (q1 - p1) THEN 1 ELSE 0 END AS x, CASE WHEN demand_mean NOT BETWEEN p2 - 1.5 * (q2 - p2) AND q2 + 1.5 * (q2 - p2) THEN 1 ELSE 0 END AS y FROM steps, b) SELECT source, {r('avg((x + y) / 2.0)')} AS score, CAST(sum(CASE WHEN x + y > 0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted FROM s GROUP BY source")
def d6(spark, sf_dir):
    df = steps(spark, sf_dir)
    return D.score_bounds(df, D.fit_bounds(df, ["pressure_mean", "demand_mean"])).groupBy("source").agg(F.avg("score").alias("score"), F.sum("predicted").alias("predicted"))


@query("d6_z_bounds", f"WITH {STEPS} SELECT 'demand_mean' AS feature, {r('avg(demand_mean) - 3 * stddev_samp(demand_mean)')} AS lo, {r('avg(demand_mean) + 3 * stddev_samp(demand_mean)')} AS hi, {r('avg(demand_mean)')} AS mean FROM steps WHERE event_label = 0")
def d6_z(spark, sf_dir):
    return D.fit_bounds(steps(spark, sf_dir), ["demand_mean"], "z")


@query("d1_d2_d4_d13_arm_benchmark")
def d13(spark, sf_dir):
    scored = D.arm_benchmark(*_split(spark, sf_dir), ARMS, FEATURES)
    return D.evaluate_networks(scored, list(ARMS), ["network_id"])


@query("d8_d9_triage_records")
def d9(spark, sf_dir):
    from gaugeflow.functions import scalar as S

    df = plausible(spark, sf_dir)
    train, test = df.where("floor(scenario_id / 4) % 4 <> 0"), df.where("floor(scenario_id / 4) % 4 = 0")
    base = D.fit_logistic(train, FEATURES)
    with_base = lambda x: S.triage_features(D.score_rows(base, x, "base").withColumnRenamed("score__base", "base_score"))
    names = ["base_score", "plausibility", "mass", "energy", "pressure_range", "head_gap", "demand_flow_ratio", "score_by_plausibility", "score_by_mass"]
    out = D.score_rows(D.fit_logistic(with_base(train), names), with_base(test), "triage").withColumn("heuristic", S.heuristic_triage_score())
    return out.groupBy("network_id").agg(F.count(F.lit(1)).alias("n"), F.avg("base_score").alias("base"), F.avg("score__triage").alias("triage"), F.avg("heuristic").alias("heuristic"))


@query("d10_isolation_scores")
def d10(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return D.isolation_scores(train.where("event_label = 0"), test, FEATURES).groupBy("network_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


@query("d10_isolation_predictions")
def d10_cut(spark, sf_dir):
    found = D.isolation_predictions(*_split(spark, sf_dir), FEATURES)
    return found.select("network_id", "scenario_id", "time_seconds", "event_label", "score", "predicted")


@query("d11_reconstruction_score")
def d11(spark, sf_dir):
    seq = W.pack_sequences(records(spark, sf_dir), STREAM, "score__a", 24)
    normal = seq.join(records(spark, sf_dir).where("scenario_kind = 'baseline'").select("scenario_id").distinct(), "scenario_id", "left_semi")
    return D.reconstruction_score(normal, seq, "values").select(*STREAM, "error", "score")


@query("d12_neighbour_scores")
def d12(spark, sf_dir):
    p = _points(table(spark, sf_dir, "embeddings"))
    near = K.symmetric_edges(K.knn_pairs(p, "id", "vec", 10))
    width = p.agg(F.max(F.size("vec"))).first()[0] or 0
    names = [f"x{i}" for i in range(width)]
    wide = p.select("id", *[F.col("vec")[i].alias(x) for i, x in enumerate(names)])
    spread = K.propagate(wide, near, names).join(p.select("id", "event_label"), "id")
    return D.score_rows(D.fit_logistic(spread, names), spread, "gcn").select("id", "event_label", "score__gcn")


@query("d14_feature_ablation")
def d14(spark, sf_dir):
    return D.feature_ablation(*_split(spark, sf_dir), FEATURES, ["demand_mean"], ["network_id"])


@query("d15_leave_one_group_out")
def d15(spark, sf_dir):
    return D.leave_one_group_out(steps(spark, sf_dir), "network_id", FEATURES, {"logistic": ("none", "logistic")})


@query("j9_knn_pairs", "SELECT id, neighbour, CAST(rank AS INT) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5")
def j9(spark, sf_dir):
    return K.knn_pairs(_points(table(spark, sf_dir, "embeddings")), "id", "vec", 5).select("id", "neighbour", "rank")


TWO_WAY = EDGES + ", tw AS (SELECT network_id, src, dst FROM edges UNION SELECT network_id, dst, src FROM edges)"


def _sensors(spark, sf_dir):
    return edges(spark, sf_dir).where(F.substring("dst", 2, 20).cast("int") % 11 == 0).select("network_id", F.col("dst").alias("sensor_id")).distinct()


@query("n1_khop_observability", f"WITH {TWO_WAY}, nd AS (SELECT DISTINCT network_id, src AS node FROM tw), h0 AS (SELECT DISTINCT network_id, dst AS node FROM edges WHERE CAST(substr(dst, 2) AS INT) % 11 = 0), h1 AS (SELECT * FROM h0 UNION SELECT tw.network_id, tw.dst FROM tw JOIN h0 ON tw.network_id = h0.network_id AND tw.src = h0.node), h2 AS (SELECT * FROM h1 UNION SELECT tw.network_id, tw.dst FROM tw JOIN h1 ON tw.network_id = h1.network_id AND tw.src = h1.node)"
       f" SELECT network_id, {r('count(h2.node) / count(*)')} AS observability FROM nd LEFT JOIN h2 USING (network_id, node) GROUP BY network_id".replace("count(h2.node)", "count(CASE WHEN h2.network_id IS NOT NULL THEN 1 END)"))  # fmt: skip
def n1(spark, sf_dir):
    return N.khop_observability(edges(spark, sf_dir), _sensors(spark, sf_dir))


@query("n2_betweenness")
def n2(spark, sf_dir):
    return N.betweenness(edges(spark, sf_dir))


@query("n3_place_by_centrality", f"WITH {EDGES}, e AS (SELECT network_id, src AS node FROM edges UNION ALL SELECT network_id, dst FROM edges), c AS (SELECT network_id, node, row_number() OVER (PARTITION BY network_id ORDER BY count(*) DESC, node) AS k, count(*) OVER (PARTITION BY network_id) AS n FROM e GROUP BY network_id, node) SELECT network_id, node FROM c WHERE k <= greatest(1, floor(n * 0.1))")
def n3_degree(spark, sf_dir):
    ends = edges(spark, sf_dir).select("network_id", F.explode(F.array("src", "dst")).alias("node"))
    return N.place_by_centrality(ends.groupBy("network_id", "node").agg(F.count(F.lit(1)).cast("double").alias("centrality")), 0.1)


@query("n2_n3_centrality_placement")
def n3(spark, sf_dir):
    return N.place_by_centrality(N.betweenness(edges(spark, sf_dir)), 0.1)


@query("n4_node_degree", f"WITH {EDGES}, e AS (SELECT network_id, src AS node FROM edges UNION ALL SELECT network_id, dst FROM edges), c AS (SELECT network_id, node, count(*) AS c FROM e GROUP BY ALL) SELECT network_id, node, {r('c / greatest(1, max(c) OVER (PARTITION BY network_id))')} AS degree FROM c")
def n4(spark, sf_dir):
    return N.node_degree(edges(spark, sf_dir))


GRAPH = EDGES + """, nodes AS (SELECT DISTINCT network_id, node, CAST(substr(node, 2) AS INT) % 50 + 5.0::DOUBLE AS head, CAST(substr(node, 2) AS INT) % 7 * 1.0::DOUBLE AS demand FROM (SELECT network_id, src AS node FROM edges UNION SELECT network_id, dst FROM edges)),
 pipes AS (SELECT *, (CAST(substr(src, 2) AS INT) * 3 + CAST(substr(dst, 2) AS INT)) % 13 - 6.0::DOUBLE AS q, 100.0::DOUBLE + CAST(substr(dst, 2) AS INT) % 40 AS length, 80.0::DOUBLE + CAST(substr(src, 2) AS INT) % 60 AS roughness, 2.0::DOUBLE + CAST(substr(dst, 2) AS INT) % 3 AS diameter FROM edges)"""


def _graph(spark, sf_dir):
    e = Supersteps(spark, "edges").table(edges(spark, sf_dir))  # nodes and pipes are read off it several times
    number = lambda c: F.substring(c, 2, 20).cast("int")
    nodes = e.select("network_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = nodes.select("network_id", "node", (number("node") % 50 + 5.0).alias("head"), (number("node") % 7 * 1.0).alias("demand"))
    pipes = e.select("*", ((number("src") * 3 + number("dst")) % 13 - 6.0).alias("q"), (100.0 + number("dst") % 40).alias("length"), (80.0 + number("src") % 60).alias("roughness"), (2.0 + number("dst") % 3).alias("diameter"))
    return nodes, pipes.withColumn("pipe_id", F.concat("src", "dst"))


@query("n5_node_features", f"""WITH {GRAPH}, p AS (SELECT network_id, node, head AS p FROM nodes), d AS (SELECT network_id, node, count(*) AS c FROM (SELECT network_id, src AS node FROM edges UNION ALL SELECT network_id, dst FROM edges) GROUP BY ALL), s AS (SELECT DISTINCT network_id, dst AS node FROM edges WHERE CAST(substr(dst, 2) AS INT) % 11 = 0)
 SELECT network_id, node, c / 2.0 AS centrality, {r('(p - min(p) OVER w) / nullif(max(p) OVER w - min(p) OVER w, 0)')} AS pressure, demand, head AS elevation, CASE WHEN node[1] = 'S' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS type_code, CASE WHEN (network_id, node) IN (SELECT (network_id, node) FROM s) THEN 1 ELSE 0 END AS sensor, {r('c / greatest(1, max(c) OVER w)')} AS degree, 1.0::DOUBLE AS multiplier FROM nodes JOIN p USING (network_id, node) JOIN d USING (network_id, node) WINDOW w AS (PARTITION BY network_id)""")
def n5(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    ends = edges(spark, sf_dir).select("network_id", F.explode(F.array("src", "dst")).alias("node"))
    full = nodes.select("network_id", "node", F.col("demand").alias("base_demand"), F.col("head").alias("elevation"), F.when(F.left("node", F.lit(1)) == "S", "reservoir").otherwise("junction").alias("node_type"))
    return N.node_features(full, edges(spark, sf_dir), nodes.select("network_id", "node", F.col("head").alias("value")), _sensors(spark, sf_dir), ends.groupBy("network_id", "node").agg((F.count(F.lit(1)) / 2.0).alias("centrality")))


@query("n6_edge_features", f"WITH {GRAPH}, v AS (SELECT *, abs(q) AS flow, abs(q) / (diameter * diameter) AS velocity, q * q / diameter AS headloss FROM pipes), f AS (SELECT network_id, src, dst, {', '.join(r(f'{c} / max({c}) OVER (PARTITION BY network_id)') + ' AS ' + c for c in ('flow', 'velocity', 'headloss', 'length', 'diameter'))} FROM v) SELECT * FROM f UNION ALL SELECT network_id, dst, src, flow, velocity, headloss, length, diameter FROM f")
def n6(spark, sf_dir):
    nodes, pipes = _graph(spark, sf_dir)
    q, d = F.col("q"), F.col("diameter")
    seen = pipes.select("network_id", "pipe_id", q.alias("flow"), (q / (d * d)).alias("velocity"), (q * F.abs(q) / d).alias("headloss"))
    return N.edge_features(pipes.select("network_id", "pipe_id", "src", "dst", "length", "diameter"), nodes, seen)


@query("n7_node_mass_balance", f"WITH {GRAPH}, i AS (SELECT network_id, dst AS node, sum(q) AS q FROM pipes GROUP BY network_id, dst) SELECT network_id, {r('avg(pow(coalesce(q, 0) - demand, 2))')} AS mass FROM nodes LEFT JOIN i USING (network_id, node) GROUP BY network_id")
def n7(spark, sf_dir):
    nodes, pipes = _graph(spark, sf_dir)
    return N.node_mass_balance(pipes, nodes)


@query("n8_pipe_energy_balance", f"WITH {GRAPH} SELECT p.network_id, {r('avg(pow(a.head - b.head - 10.67 * length / (pow(roughness, 1.852) * pow(diameter, 4.87)) * pow(abs(q), 1.852) * sign(q), 2))')} AS energy FROM pipes p JOIN nodes a ON a.network_id = p.network_id AND a.node = src JOIN nodes b ON b.network_id = p.network_id AND b.node = dst GROUP BY p.network_id")
def n8(spark, sf_dir):
    nodes, pipes = _graph(spark, sf_dir)
    return N.pipe_energy_balance(pipes, nodes)


@query("n9_bound_penalty", f"WITH {GRAPH} SELECT network_id, {r('avg(pow(greatest(0, 10 - head) + greatest(0, head - 50), 2))')} AS bounds FROM nodes GROUP BY network_id")
def n9(spark, sf_dir):
    return N.bound_penalty(_graph(spark, sf_dir)[0], 10.0, 50.0)


@query("n9_physics_penalty", f"""WITH {GRAPH}, i AS (SELECT network_id, dst AS node, sum(q) AS q FROM pipes GROUP BY network_id, dst), m AS (SELECT network_id, avg(pow(coalesce(q, 0) - demand, 2)) AS mass, avg(pow(greatest(0, 10 - head) + greatest(0, head - 50), 2)) AS bounds FROM nodes LEFT JOIN i USING (network_id, node) GROUP BY network_id),
 e AS (SELECT p.network_id, avg(pow(a.head - b.head - 10.67 * length / (pow(roughness, 1.852) * pow(diameter, 4.87)) * pow(abs(q), 1.852) * sign(q), 2)) AS energy FROM pipes p JOIN nodes a ON a.network_id = p.network_id AND a.node = src JOIN nodes b ON b.network_id = p.network_id AND b.node = dst GROUP BY p.network_id)
 SELECT network_id, {r('bounds')} AS bounds, {r('mass')} AS mass, {r('energy')} AS energy, {r('0.5 * bounds + mass + energy')} AS total FROM m JOIN e USING (network_id)""")
def n9_total(spark, sf_dir):
    nodes, pipes = _graph(spark, sf_dir)
    return N.physics_penalty(nodes, pipes, 10.0, 50.0)


@query("n10_topology_propagation", f"""WITH {GRAPH}, tw AS (SELECT network_id, src, dst FROM edges UNION SELECT network_id, dst, src FROM edges UNION SELECT network_id, node, node FROM nodes), dg AS (SELECT network_id, src AS node, count(*) AS d FROM tw GROUP BY ALL), w AS (SELECT tw.*, 1 / sqrt(CAST(a.d AS DOUBLE) * b.d) AS w FROM tw JOIN dg a ON a.network_id = tw.network_id AND a.node = src JOIN dg b ON b.network_id = tw.network_id AND b.node = dst),
 r1 AS (SELECT w.network_id, src AS node, sum(w * head) AS head FROM w JOIN nodes ON nodes.network_id = w.network_id AND node = dst GROUP BY ALL), r2 AS (SELECT w.network_id, src AS node, sum(w * head) AS head FROM w JOIN r1 ON r1.network_id = w.network_id AND r1.node = dst GROUP BY ALL) SELECT network_id, {r('avg(head)')} AS head FROM r2 GROUP BY network_id""")
def n10(spark, sf_dir):
    nodes, pipes = _graph(spark, sf_dir)
    return N.topology_propagation(pipes, nodes, ["head"])


TOPS = f"{LONG}, tops AS (SELECT arm, {', '.join(STREAM)}, max(score) AS score, max(event_label) AS event_label FROM long GROUP BY ALL)"


@query("c2_scenario_evaluation", boot_ap_sql("network_id, arm", "scenario_id", 500, TOPS, "tops"))
def c2(spark, sf_dir):
    long = arm_records(records(spark, sf_dir))
    tops = M.stream_table(long, ["arm", *STREAM]).select("arm", "network_id", "scenario_id", F.col("max_score").alias("score"), F.col("label").alias("event_label"))
    return C.bootstrap_ap(tops, ["network_id", "arm"], "scenario_id", 500)


@query("c3_classifier_by_arm_grid")
def c3(spark, sf_dir):
    grid = {f"{how}_{kind}": (how, kind) for how in ("none", "noise") for kind in ("forest", "logistic")}
    found = D.evaluate_networks(D.arm_benchmark(*_split(spark, sf_dir), grid, FEATURES), list(grid), ["network_id"])
    return A.macro_equal(found, ["arm"], "ap")


@query("c4_per_kind_benchmark", f"WITH {LONG}, sl AS (SELECT k AS kind, long.* FROM long CROSS JOIN (VALUES ('leak'), ('pipe_closure'), ('pump_outage')) t(k) WHERE scenario_kind = k OR scenario_kind = 'baseline'), {ap_sql('m', 'sl', 'seed, network_id, arm, kind')} SELECT network_id, arm, kind, {r('avg(ap)')} AS mean, {r('stddev_pop(ap)')} AS std, count(ap) AS n FROM m GROUP BY network_id, arm, kind")
def c4(spark, sf_dir):
    out = None
    for kind in ("leak", "pipe_closure", "pump_outage"):
        m = M.ranking_metrics(J.disturbance_slice(arm_records(records(spark, sf_dir)), kind), ["seed", "network_id", "arm"])
        one = A.seed_summary(m, ["network_id", "arm"], "ap", 0).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("c5_per_coverage_benchmark", f"WITH {LONG}, cv AS (SELECT '0.25' AS coverage, * FROM long WHERE sensor_coverage = 0.25 UNION ALL SELECT '0.5', * FROM long WHERE sensor_coverage = 0.5 UNION ALL SELECT 'all', * FROM long), {ap_sql('m', 'cv', 'coverage, network_id, arm')} SELECT coverage, arm, {r('avg(ap)')} AS macro FROM m GROUP BY coverage, arm")
def c5(spark, sf_dir):
    long, out = arm_records(records(spark, sf_dir)), None
    for name, df in (("0.25", J.filter_coverage(long, 0.25)), ("0.5", J.filter_coverage(long, 0.5)), ("all", long)):
        one = A.macro_equal(M.ranking_metrics(df, ["network_id", "arm"]), ["arm"], "ap").withColumn("coverage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


FITTED = ["mass_residual", "energy_residual", "sensor_coverage"]


@query("c4_per_kind_fits")
def c4_fits(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    df = records(spark, sf_dir).withColumn("kinds", F.when(F.col("scenario_kind") == "baseline", kinds).otherwise(F.array("scenario_kind")))
    found = D.slice_benchmark(df, "kinds", FITTED)
    weighted = A.macro_weighted(found, ["slice"], "ap", F.col("rows")).withColumnRenamed("macro", "weighted_ap")
    return A.seed_summary(found, ["slice", "network_id"], "ap", 0).join(weighted, "slice")


@query("c5_per_coverage_fits")
def c5_fits(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("coverages", F.array(F.col("sensor_coverage").cast("string"), F.lit("all")))
    found = D.slice_benchmark(df, "coverages", FITTED, by=())
    return A.macro_weighted(found, ["slice"], "ap", F.col("rows")).join(A.seed_summary(found, ["slice"], "ap", 0), "slice")


@query("c6_randomised_copy_training")
def c6(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    noisy = train.withColumn("demand_mean", F.col("demand_mean") * 1.1)
    common = J.union_frames([train, noisy])
    return D.evaluate_networks(D.arm_benchmark(common, test, {"logistic": ("none", "logistic")}, FEATURES), ["logistic"], ["network_id"])


@query("c7_rare_prior_benchmark", f"WITH {LONG}, {ap_sql('m', 'long', 'network_id, arm')}, st AS (SELECT arm, network_id, scenario_id, max(score) AS score, max(event_label) AS event_label FROM long GROUP BY ALL), {ap_sql('p', 'st', 'network_id, arm')} SELECT network_id, arm, {r('m.ap')} AS row_ap, {r('p.ap')} AS pooled_ap FROM m JOIN p USING (network_id, arm)")
def c7(spark, sf_dir):
    long, keys = arm_records(records(spark, sf_dir)), ["network_id", "arm"]
    pooled = M.stream_table(long, [*keys, "scenario_id"])
    return M.ranking_metrics(long, keys).select(*keys, F.col("ap").alias("row_ap")).join(M.ranking_metrics(pooled, keys, "label", "max_score").select(*keys, F.col("ap").alias("pooled_ap")), keys)


@query("c8_plausibility_vs_utility", f"WITH {PLAUSIBLE}, x AS (SELECT observed_count, avg(plausibility) AS p, avg(demand_mean) AS u FROM pl GROUP BY observed_count), k AS (SELECT rank() OVER (ORDER BY p) AS a, rank() OVER (ORDER BY u) AS b FROM x) SELECT family, {r('rho')} AS rho, n, {r(student_sql('rho', 'n'))} AS p FROM (SELECT 'all' AS family, corr(a, b) AS rho, count(*) AS n FROM k)")
def c8(spark, sf_dir):
    x = plausible(spark, sf_dir).groupBy("observed_count").agg(F.avg("plausibility").alias("p"), F.avg("demand_mean").alias("u"))
    return C.spearman(x.withColumn("family", F.lit("all")), ["family"], "p", "u")


@query("c9_sequence_score_evaluation")
def c9(spark, sf_dir):
    seq = W.pack_sequences(records(spark, sf_dir), STREAM, "score__a", 24)
    label = records(spark, sf_dir).groupBy(*STREAM).agg(F.max("event_label").alias("event_label"), F.min("scenario_kind").alias("kind"))
    both = seq.join(label, STREAM)
    found = M.ranking_metrics(D.reconstruction_score(both.where("kind = 'baseline'"), both, "values"), ["seed", "network_id"])
    return A.seed_summary(found, ["network_id"], "ap", 0)


@query("c1_evaluate_networks", f"WITH {LONG}, {ap_sql('m', 'long', 'arm, network_id')}, c AS (SELECT arm, network_id, count(*) AS rows, CAST(sum(event_label) AS BIGINT) AS positive_rows FROM long GROUP BY ALL) SELECT arm, network_id, {r('ap')} AS ap, {r('auc')} AS auc, rows, positive_rows FROM m JOIN c USING (arm, network_id)")
def c1(spark, sf_dir):
    return D.evaluate_networks(records(spark, sf_dir), ["a", "b"], ["network_id"])


@query("c10_suite_table", f"WITH {LONG}, {ap_sql('m', 'long', 'seed, network_id, arm')} SELECT network_id, {r('avg(CASE WHEN arm = ' + chr(39) + 'a' + chr(39) + ' THEN ap END)')} AS a_mean, {r('stddev_samp(CASE WHEN arm = ' + chr(39) + 'a' + chr(39) + ' THEN ap END)')} AS a_std, {r('avg(CASE WHEN arm = ' + chr(39) + 'b' + chr(39) + ' THEN ap END)')} AS b_mean, {r('stddev_samp(CASE WHEN arm = ' + chr(39) + 'b' + chr(39) + ' THEN ap END)')} AS b_std FROM m GROUP BY network_id")
def c10(spark, sf_dir):
    s = A.seed_summary(M.ranking_metrics(arm_records(records(spark, sf_dir)), ["seed", "network_id", "arm"]), ["network_id", "arm"], "ap", 1)
    return s.groupBy("network_id").pivot("arm", ["a", "b"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


@query("c11_validation_summary", f"WITH {RECORDS}, st AS (SELECT seed, network_id, scenario_id, sensor_coverage, count(*) AS steps, max(score__a) AS s FROM records GROUP BY ALL) SELECT CAST(l AS INT) AS least, network_id, {r('avg(s)')} AS mean, {r('stddev_pop(s)')} AS std, count(s) AS n FROM st, (VALUES (5), (10)) t(l) WHERE steps >= l GROUP BY ALL")
def c11(spark, sf_dir):
    st = M.stream_table(records(spark, sf_dir), STREAM, score="score__a")
    each = st.withColumn("least", F.explode(F.array(F.lit(5), F.lit(10)))).where(F.col("steps") >= F.col("least"))
    return A.seed_summary(each, ["least", "network_id"], "max_score", 0)

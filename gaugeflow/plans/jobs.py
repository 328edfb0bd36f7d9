"""Whole evaluations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import aggregates as A
from gaugeflow.operators import detect as D
from gaugeflow.operators import jobs as W
from gaugeflow.operators import metrics as M
from gaugeflow.operators.supersteps import Supersteps
from gaugeflow.plans.aggregates import PLAUSIBLE, plausible
from gaugeflow.plans.compare import draws_sql, student_sql
from gaugeflow.plans.joins import NET_CRC
from gaugeflow.plans.metrics import ap_sql
from gaugeflow.plans.models import FEATURES, FITTED, _graph, _split
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import KINDS, LONG, RECORDS, STEPS, STREAM, arm_records, records, steps, table

SUMMARIES = ["mean", "std", "abs_mean", "max", "min"]
STREAM_FEATURES = [f"{c}_{s}" for c in ("pressure", "demand", "flow") for s in SUMMARIES] + ["n_steps", "n_sensors"]


def _scenario_readings(spark, sf_dir):
    """`events` as long readings of streams: event types as channels, five sensors a stream."""
    kind = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 5).alias("sensor_id"))
    channel = F.when(F.col("event_type") == "view", "pressure").when(F.col("event_type") == "click", "demand").otherwise("flow")
    return records(spark, sf_dir).join(kind, "event_id").select(*STREAM, "scenario_kind", "event_label", "time_seconds", "sensor_id", channel.alias("channel"), F.col("mass_residual").alias("value"))


@query("c2_hierarchical_evaluation")
def c2(spark, sf_dir):
    found = W.scenario_table(_scenario_readings(spark, sf_dir), STREAM)
    held = "floor(scenario_id / 4) % 3 = 0"
    return W.scenario_evaluation(found.where(f"not ({held})"), found.where(held), STREAM, STREAM_FEATURES, [0.25, 0.5], KINDS, 2)


STREAM_SQL = ", ".join(STREAM)


@query("c2_empty_split", f"WITH {RECORDS}, st AS (SELECT {STREAM_SQL}, count(*) AS n FROM records GROUP BY ALL) SELECT CAST(NULL AS VARCHAR) AS model, 'empty_test' AS status, count(*) AS n_train, CAST(0 AS BIGINT) AS n_test, CAST(NULL AS BIGINT) AS support, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("precision", "recall", "f1", "balanced_accuracy", "ap", "auc", "lo", "hi")) + ", CAST(NULL AS BIGINT) AS valid FROM st WHERE floor(scenario_id / 4) % 3 <> 0")
def c2_empty(spark, sf_dir):
    found = W.scenario_table(_scenario_readings(spark, sf_dir), STREAM)
    return W.scenario_evaluation(found.where("floor(scenario_id / 4) % 3 <> 0"), found.where("scenario_id < 0"), STREAM, STREAM_FEATURES, [0.25, 0.5], KINDS)


@query("c3_classifier_deltas")
def c3(spark, sf_dir):
    df = records(spark, sf_dir).fillna(0.0, subset=FITTED)
    held = F.floor(F.col("scenario_id") / 4) % 4 == 0
    return W.classifier_grid(df.where(~held), df.where(held), ["none", "noise"], ["forest", "logistic"], FITTED)


COPIES = f"""WITH {STEPS}, f AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '42', CAST(scenario_id AS VARCHAR), CAST(copy AS VARCHAR), 'u')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST('0x' || substr(md5(concat_ws('|', '42', CAST(scenario_id AS VARCHAR), CAST(copy AS VARCHAR), 'v')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS v FROM steps, range(1, 4) t(copy)),
 g AS (SELECT *, least(2.0, greatest(0.5, 1 + 0.2 * sqrt(-2 * ln(greatest(u, 1e-12))) * cos(2 * pi() * v))) AS m FROM f) SELECT network_id, CAST(copy AS INT) AS copy, count(*) AS n, {r('avg(demand_mean * m)')} AS demand_mean, {r('avg(demand_sum * m)')} AS demand_sum, {r('avg(pressure_mean)')} AS pressure_mean FROM g GROUP BY network_id, copy"""


@query("c6_perturbed_copies", COPIES)
def c6_copies(spark, sf_dir):
    made = W.perturbed_copies(steps(spark, sf_dir), ["demand_mean", "demand_sum"], 3, ["scenario_id"])
    return made.groupBy("network_id", "copy").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("demand_mean", "demand_sum", "pressure_mean")])


@query("c6_randomised_training")
def c6(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    both = W.randomised_training(train, W.perturbed_copies(train, ["demand_mean", "demand_sum"], 1, ["scenario_id"]))
    arms = {"clean": both.where("origin = 'clean'"), "randomised": both}
    found = None
    for arm, rows in arms.items():
        one = D.evaluate_networks(D.arm_benchmark(rows.drop("origin"), test, {arm: ("none", "logistic")}, FEATURES), [arm], ["network_id"])
        found = one if found is None else found.unionByName(one)
    return found


@query("c7_rare_prior_normals", f"""WITH {LONG}, ids AS (SELECT DISTINCT network_id, scenario_id FROM records WHERE scenario_kind = 'baseline'), dn AS (SELECT network_id, scenario_id FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY md5(concat_ws('|', '42', network_id, CAST(scenario_id AS VARCHAR))), scenario_id) AS k FROM ids) WHERE k <= 20),
 bo AS (SELECT * FROM long WHERE scenario_kind <> 'baseline' OR (network_id, scenario_id) IN (SELECT (network_id, scenario_id) FROM dn)), {ap_sql('m', 'bo', 'network_id, arm')}, st AS (SELECT arm, network_id, scenario_id, max(score) AS score, max(event_label) AS event_label FROM bo GROUP BY ALL), {ap_sql('p', 'st', 'network_id, arm')},
 ct AS (SELECT network_id, arm, count(*) AS n_scenarios, CAST(sum(event_label) AS BIGINT) AS n_positive FROM st GROUP BY ALL) SELECT network_id, arm, {r('m.ap')} AS row_ap, {r('p.ap')} AS pooled_ap, {r('p.prior')} AS positive_rate, n_scenarios, n_positive FROM m JOIN p USING (network_id, arm) JOIN ct USING (network_id, arm)""")
def c7(spark, sf_dir):
    long = arm_records(records(spark, sf_dir))
    return W.rare_prior_benchmark(long.where("scenario_kind <> 'baseline'"), long.where("scenario_kind = 'baseline'"), 20, 42)


@query("c7_drawn_normals", f"""WITH {RECORDS}, ids AS (SELECT DISTINCT network_id, scenario_id FROM records WHERE scenario_kind = 'baseline'), dn AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY md5(concat_ws('|', '42', network_id, CAST(scenario_id AS VARCHAR))), scenario_id) - 1 AS j FROM ids)
 SELECT network_id, scenario_id, concat(network_id, '__normal__', lpad(CAST(j AS VARCHAR), 4, '0')) AS drawn_id, (42 * 1000003 + CASE network_id {NET_CRC} END) % 2147483647 + 100000 + j AS demand_seed FROM dn WHERE j < 20""")
def c7_normals(spark, sf_dir):
    return W.drawn_normals(records(spark, sf_dir).where("scenario_kind = 'baseline'"), 20, 42)


@query("c8_source_plausibility", f"""WITH {PLAUSIBLE}, pm AS (SELECT network_id, observed_count, avg(plausibility) AS p FROM pl GROUP BY ALL), sc AS (SELECT network_id, observed_count, event_label, demand_mean AS score FROM steps), {ap_sql('m', 'sc', 'network_id, observed_count')},
 d AS (SELECT m.network_id, m.observed_count, m.ap - b.ap AS delta FROM m JOIN m b ON m.network_id = b.network_id AND b.observed_count = 1), x AS (SELECT pm.network_id, p, delta FROM pm JOIN d USING (network_id, observed_count) WHERE delta IS NOT NULL),
 k AS (SELECT network_id, rank() OVER (PARTITION BY network_id ORDER BY p) AS a, rank() OVER (PARTITION BY network_id ORDER BY delta) AS b FROM x), c AS (SELECT network_id, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS rho, count(*) AS n FROM k GROUP BY network_id) SELECT network_id, {r('rho')} AS rho, n, {r(student_sql('rho', 'n'))} AS p FROM c""")
def c8(spark, sf_dir):
    df, by = plausible(spark, sf_dir), ["network_id"]
    report = df.groupBy(*by, "observed_count").agg(F.avg("plausibility").alias("score_mean"))
    found = M.ranking_metrics(steps(spark, sf_dir).withColumn("score", F.col("demand_mean")), [*by, "observed_count"])
    return W.plausibility_vs_utility(report, found, by, "observed_count", 1)


SPLIT = "CASE floor(scenario_id / 4) % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def _suite_sql() -> str:
    first = ", ".join(f"{r(f'max(CASE WHEN split = {chr(39)}{s}{chr(39)} THEN {m} END)')} AS {s}_{m}" for s in ("train", "validation", "test") for m in ("f1", "ap"))
    names = [f"{s}_{m}" for s in ("validation", "test") for m in ("f1", "ap")]
    wide = ", ".join(f"{r(f'max(CASE WHEN of = {chr(39)}{x}{chr(39)} THEN {c} END)')} AS {x}_{c}" for x in names for c in ("mean", "std", "lo", "hi"))
    counts = ", ".join(f"max(CASE WHEN of = '{x}' THEN c END) AS {x}_n" for x in names)
    return f"""WITH {LONG}, sp AS (SELECT *, network_id AS run, arm AS experiment, {SPLIT} AS split FROM long), {ap_sql('m', 'sp', 'run, experiment, seed, split')},
 cf AS (SELECT run, experiment, seed, split, count(*) FILTER (score >= 0.5 AND event_label = 1) AS tp, count(*) FILTER (score >= 0.5 AND event_label = 0) AS fp, count(*) FILTER ((score < 0.5 OR score IS NULL) AND event_label = 1) AS fn FROM sp GROUP BY ALL),
 re AS (SELECT run, experiment, seed, split, ap, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM m JOIN cf USING (run, experiment, seed, split)),
 lo AS (SELECT run, experiment, seed, concat_ws('_', split, 'f1') AS of, f1 AS value FROM re WHERE split <> 'train' UNION ALL SELECT run, experiment, seed, concat_ws('_', split, 'ap'), ap FROM re WHERE split <> 'train'),
 bv AS (SELECT run, experiment, of, seed, avg(value) AS v FROM lo WHERE value IS NOT NULL GROUP BY ALL), {draws_sql('dr', 'bv', 'run, experiment, of', 'seed', 2000, 'seeds')}, bm AS (SELECT run, experiment, of, b, sum(v * times) / sum(times) AS m FROM bv JOIN dr USING (run, experiment, of, seed) GROUP BY ALL),
 en AS (SELECT run, experiment, of, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY ALL), ba AS (SELECT run, experiment, of, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS c FROM bv GROUP BY ALL), al AS (SELECT run, experiment, of, mean, std, CASE WHEN c >= 2 THEN lo END AS lo, CASE WHEN c >= 2 THEN hi END AS hi, c FROM ba JOIN en USING (run, experiment, of)),
 w1 AS (SELECT run, experiment, {first} FROM re WHERE seed = (SELECT min(seed) FROM re) GROUP BY ALL), w2 AS (SELECT run, experiment, {wide}, {counts} FROM al GROUP BY ALL) SELECT * FROM w1 LEFT JOIN w2 USING (run, experiment)"""


@query("c10_suite_splits", _suite_sql())
def c10(spark, sf_dir):
    long = arm_records(records(spark, sf_dir)).withColumn("split", F.expr(SPLIT)).withColumnsRenamed({"network_id": "run", "arm": "experiment"})
    return W.suite_table(M.binary_report(long, ["run", "experiment", "seed", "split"]), ["train", "validation", "test"], ["validation", "test"])


@query("c11_validation_runs", f"""WITH {LONG}, st AS (SELECT arm, {STREAM_SQL}, count(*) AS steps, max(score) AS score, max(event_label) AS event_label FROM long GROUP BY ALL), ea AS (SELECT CAST(l AS INT) AS least, st.* FROM st, (VALUES (1), (3)) t(l) WHERE steps >= l), {ap_sql('m', 'ea', 'arm, least, seed, network_id')},
 ru AS (SELECT *, CASE WHEN ap IS NULL OR n < 10 THEN 1 ELSE 0 END AS return_code FROM m), lo AS (SELECT arm, least, 'ap' AS metric, ap AS value FROM ru WHERE return_code = 0 UNION ALL SELECT arm, least, 'auc', auc FROM ru WHERE return_code = 0) SELECT arm, least, metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, count(value) AS n FROM lo GROUP BY ALL""")
def c11(spark, sf_dir):
    st = M.stream_table(arm_records(records(spark, sf_dir)), ["arm", *STREAM])
    each = st.withColumn("least", F.explode(F.array(F.lit(1), F.lit(3)))).where(F.col("steps") >= F.col("least"))
    runs = M.ranking_metrics(each, ["arm", "least", "seed", "network_id"], "label", "max_score")
    return W.validation_summary(runs.withColumn("return_code", F.when(F.col("ap").isNull() | (F.col("n") < 10), 1).otherwise(0)), ["arm", "least"], ["ap", "auc"])


@query("d8_triage_all_features")
def d8(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    base = D.fit_logistic(train, FEATURES)
    sides = [W.triage_frame(D.score_rows(base, x, "base").withColumnRenamed("score__base", "base_score"), train.where("event_label = 0")) for x in (train, test)]
    scored = D.score_rows(D.fit_logistic(sides[0], W.triage_columns(sides[0])), sides[1], "triage")
    scored = Supersteps(spark, "triage").table(scored.select("network_id", "event_label", "score__triage"))
    return M.ranking_metrics(scored, ["network_id"], score="score__triage").join(A.confusion_free_mean(scored, ["network_id"], "score__triage"), "network_id")


@query("n10_topology_scores")
def n10(spark, sf_dir):
    nodes, pipes = _graph(spark, sf_dir)
    scored = W.topology_scores(*_split(spark, sf_dir), pipes, nodes, ["head", "demand"], FEATURES)
    return D.evaluate_networks(scored, ["topology"], ["network_id"])

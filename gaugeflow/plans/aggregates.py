"""Aggregations, scalar functions and plausibility over readings, steps and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions import scalar as S
from gaugeflow.operators import aggregates as A
from gaugeflow.operators import metrics as M
from gaugeflow.plans.metrics import ap_sql
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import LONG, READINGS, RECORDS, STEPS, arm_records, readings, records, steps, table


def _sensor_sql(source: str) -> str:
    z = lambda e: r(f"coalesce({e}, 0)")
    f = lambda fn, c: f"{fn}(value) FILTER (channel = '{c}')"
    return (f"SELECT network_id, time_seconds, {z(f('avg', 'pressure'))} AS pressure_mean, {z(f('min', 'pressure'))} AS pressure_min, {z(f('max', 'pressure'))} AS pressure_max, {z(f('stddev_samp', 'pressure'))} AS pressure_std,"
            f" {z(f('avg', 'demand'))} AS demand_mean, {z(f('sum', 'demand'))} AS demand_sum, {z(f('stddev_samp', 'demand'))} AS demand_std, {z(f('avg', 'flow'))} AS flow_mean, {z('avg(abs(value)) FILTER (channel = ' + chr(39) + 'flow' + chr(39) + ')')} AS flow_abs_mean, {z(f('stddev_samp', 'flow'))} AS flow_std,"
            f" {z(f('avg', 'tank_head'))} AS tank_head_mean, {z(f('stddev_samp', 'tank_head'))} AS tank_head_std FROM {source} GROUP BY network_id, time_seconds")  # fmt: skip


@query("a1_sensor_aggregates", f"WITH {READINGS} {_sensor_sql('readings')}")
def a1(spark, sf_dir):
    return A.sensor_aggregates(readings(spark, sf_dir))


@query("a2_sensor_aggregates_for", f"WITH {READINGS} {_sensor_sql('(SELECT * FROM readings WHERE sensor_id % 3 = 0)')}")
def a2(spark, sf_dir):
    df = readings(spark, sf_dir)
    return A.sensor_aggregates_for(df, df.where("sensor_id % 3 = 0").select("network_id", "sensor_id").distinct())


def _arm_ap(spark, sf_dir):
    return M.ranking_metrics(arm_records(records(spark, sf_dir)), ["seed", "network_id", "arm"])


ARM_AP = f"{LONG}, {ap_sql('m', 'long', 'seed, network_id, arm')}"


@query("a13_seed_summary", f"WITH {ARM_AP} SELECT network_id, arm, {r('avg(ap)')} AS mean, {r('stddev_pop(ap)')} AS std, count(ap) AS n FROM m GROUP BY network_id, arm")
def a13(spark, sf_dir):
    return A.seed_summary(_arm_ap(spark, sf_dir), ["network_id", "arm"], "ap", 0)


@query("a13_seed_summary_sample", f"WITH {ARM_AP} SELECT network_id, arm, {r('avg(ap)')} AS mean, {r('stddev_samp(ap)')} AS std, count(ap) AS n FROM m GROUP BY network_id, arm")
def a13b(spark, sf_dir):
    return A.seed_summary(_arm_ap(spark, sf_dir), ["network_id", "arm"], "ap", 1)


@query("a14_macro_equal", f"WITH {ARM_AP}, n AS (SELECT network_id, arm, avg(ap) AS x FROM m GROUP BY network_id, arm) SELECT arm, {r('avg(x)')} AS macro FROM n GROUP BY arm")
def a14(spark, sf_dir):
    return A.macro_equal(_arm_ap(spark, sf_dir), ["arm"], "ap")


@query("a15_macro_weighted", f"WITH {ARM_AP}, nodes AS (SELECT network_id, count(DISTINCT scenario_id) AS w FROM records GROUP BY network_id) SELECT arm, {r('sum(w * ap) / sum(w)')} AS macro FROM m JOIN nodes USING (network_id) WHERE ap IS NOT NULL GROUP BY arm")
def a15(spark, sf_dir):
    nodes = records(spark, sf_dir).groupBy("network_id").agg(F.count_distinct("scenario_id").cast("double").alias("w"))
    return A.macro_weighted(_arm_ap(spark, sf_dir).join(nodes, "network_id", "left"), ["arm"], "ap", F.col("w"))


@query("a16_macro_row_weighted", f"WITH {ARM_AP} SELECT arm, {r('sum(n * ap) / sum(n)')} AS macro FROM m WHERE ap IS NOT NULL GROUP BY arm")
def a16(spark, sf_dir):
    return A.macro_weighted(_arm_ap(spark, sf_dir), ["arm"], "ap", F.col("n"))


PLAUSIBLE = STEPS + """, res AS (SELECT *, abs(demand_sum - flow_abs_mean * greatest(observed_count, 1)) / (abs(demand_sum) + abs(flow_abs_mean * greatest(observed_count, 1)) + 1e-9) * 2 AS mass,
  least(10.0, abs(pressure_std / (flow_std + 1e-9) - ratio) / (ratio + 1e-9)) AS energy, CASE WHEN pressure_min < 10 OR pressure_max > 105 THEN 1 ELSE 0 END AS violation
  FROM steps, (SELECT coalesce(median(least(1e6, greatest(0.0, pressure_std / (flow_std + 1e-9)))), 1.0) AS ratio FROM steps WHERE source = 'N') q),
pl AS (SELECT *, exp(-mass - energy) * (1 - violation) AS plausibility FROM res)"""


def plausible(spark, sf_dir):
    df = steps(spark, sf_dir)
    return S.with_plausibility(df.join(F.broadcast(S.expected_ratio(df.where("source = 'N'")))), F.col("ratio"))


@query("f1_f4_plausibility", f"WITH {PLAUSIBLE} SELECT network_id, source, observed_count, {r('sum(mass)')} AS mass, {r('sum(energy)')} AS energy, CAST(sum(violation) AS BIGINT) AS violations, {r('sum(plausibility)')} AS plausibility FROM pl GROUP BY ALL")
def f1_f4(spark, sf_dir):
    return plausible(spark, sf_dir).groupBy("network_id", "source", "observed_count").agg(F.sum("mass").alias("mass"), F.sum("energy").alias("energy"), F.sum("violation").alias("violations"), F.sum("plausibility").alias("plausibility"))


REPORT = f"{r('avg(mass)')} AS mass_mean, {r('stddev_pop(mass)')} AS mass_std, {r('avg(energy)')} AS energy_mean, {r('stddev_pop(energy)')} AS energy_std, {r('avg(violation)')} AS violation_rate, {r('avg(plausibility)')} AS score_mean, count(*) FILTER (plausibility > 0.5) AS n_plausible, {r('avg(CASE WHEN plausibility > 0.5 THEN 1.0 ELSE 0.0 END)')} AS pass_rate"


@query("a17_plausibility_report", f"WITH {PLAUSIBLE.replace('ratio FROM steps WHERE', 'unused, 1.0 AS ratio FROM steps WHERE')} SELECT network_id, {REPORT} FROM pl GROUP BY network_id")
def a17(spark, sf_dir):
    return A.plausibility_report(steps(spark, sf_dir), ["network_id"])


@query("a18_compare_sources", f"WITH {PLAUSIBLE} SELECT source AS origin, {REPORT} FROM pl GROUP BY source")
def a18(spark, sf_dir):
    df = steps(spark, sf_dir)
    return A.compare_sources({s: df.where(F.col("source") == s) for s in ("A", "N", "R")}, df.where("source = 'N'"))


@query("a19_residual_summary", f"WITH {PLAUSIBLE}, s AS (SELECT source, avg(mass) AS m, stddev_pop(mass) AS sd, quantile_cont(mass, 0.9) AS q FROM pl GROUP BY source) SELECT source, {r('m')} AS mean, {r('sd')} AS std, {r('q')} AS p90, {r('m / (SELECT m FROM s WHERE source = ' + chr(39) + 'N' + chr(39) + ')')} AS inflation FROM s")
def a19(spark, sf_dir):
    return A.residual_summary(steps(spark, sf_dir), "source", "N")


def _stream_features_sql() -> str:
    cols = []
    for c in ("pressure", "demand", "flow"):
        f = f"FILTER (channel = '{c}')"
        cols += [f"{r(f'coalesce({e} {f}, 0)')} AS {c}_{n}" for n, e in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("abs_mean", "avg(abs(value))"), ("max", "max(value)"), ("min", "min(value)"))]
    return f"WITH {READINGS} SELECT network_id, count(DISTINCT time_seconds) AS n_steps, count(DISTINCT sensor_id) AS n_sensors, {', '.join(cols)} FROM readings GROUP BY network_id"


@query("a20_stream_features", _stream_features_sql())
def a20(spark, sf_dir):
    return A.stream_features(readings(spark, sf_dir), ["network_id"])


@query("a21_density_histogram", f"""WITH {STEPS}, e AS (SELECT quantile_cont(demand_mean, 0.01) AS lo, quantile_cont(demand_mean, 0.99) AS hi FROM steps WHERE source = 'N'),
 i AS (SELECT source, CAST(least(38, floor((demand_mean - lo) / ((hi - lo) / 39))) AS INT) AS bin, (hi - lo) / 39 AS w FROM steps, e WHERE demand_mean >= lo AND demand_mean <= hi), t AS (SELECT source, count(*) AS n FROM i GROUP BY source)
 SELECT source, bin, {r('count(*) / max(n) / max(w)')} AS density FROM i JOIN t USING (source) GROUP BY source, bin""")
def a21(spark, sf_dir):
    return A.density_histogram(steps(spark, sf_dir), "source", "demand_mean", "N")


@query("a23_relative_utility", f"WITH {ARM_AP}, p AS (SELECT seed, network_id, max(CASE WHEN arm = 'a' THEN ap END) AS a, max(CASE WHEN arm = 'b' THEN ap END) AS b, max(prior) AS prior FROM m GROUP BY seed, network_id) SELECT seed, network_id, {r('(a - greatest(b, prior)) / nullif(greatest(b, prior), 0)')} AS utility FROM p")
def a23(spark, sf_dir):
    side = lambda x: F.max(F.when(F.col("arm") == x, F.col("ap"))).alias(x)
    wide = _arm_ap(spark, sf_dir).groupBy("seed", "network_id").agg(side("a"), side("b"), F.max("prior").alias("prior"))
    return wide.select("seed", "network_id", A.relative_utility(wide, "a", ["b", "prior"]).alias("utility"))


@query("a25_filter_acceptance", f"WITH {STEPS} SELECT source, sensor_coverage, count(*) AS generated, count(*) FILTER (pressure_max <= 80) AS kept, {r('1 - avg(CASE WHEN pressure_max <= 80 THEN 1.0 ELSE 0.0 END)')} AS rejection_rate FROM steps GROUP BY ALL")
def a25(spark, sf_dir):
    return A.filter_acceptance(steps(spark, sf_dir).withColumn("ok", F.col("pressure_max") <= 80), ["source", "sensor_coverage"], "ok")


@query("p11_range_violations", f"WITH {STEPS} SELECT source, {r('avg(CASE WHEN pressure_min < 10 THEN 1.0 ELSE 0.0 END)')} AS below, {r('avg(CASE WHEN pressure_max > 80 THEN 1.0 ELSE 0.0 END)')} AS above, {r('avg(CASE WHEN pressure_min > pressure_max THEN 1.0 ELSE 0.0 END)')} AS crossed, {r('avg(CASE WHEN pressure_mean < pressure_min OR pressure_mean > pressure_max THEN 1.0 ELSE 0.0 END)')} AS mean_outside FROM steps GROUP BY source")
def p11(spark, sf_dir):
    return A.range_violations(steps(spark, sf_dir), ["source"], high=80.0)


@query("p2_prepare_features", f"WITH x AS (SELECT o_orderkey, coalesce(try_cast(replace(o_orderpriority, '-', '.') AS DOUBLE), 0.0) AS a, coalesce(try_cast(substr(o_clerk, 7) AS DOUBLE), 0.0) AS b, greatest(0, least(1, coalesce(o_shippriority, 0))) AS y FROM (SELECT o_orderkey, o_orderpriority, cast(o_custkey AS VARCHAR) AS o_clerk, CAST(o_custkey % 3 AS INT) AS o_shippriority FROM orders)) SELECT CAST(y AS INT) AS y, count(*) AS n, {r('sum(a)')} AS a, {r('sum(b)')} AS b FROM x GROUP BY y")
def p2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.regexp_replace("o_orderpriority", "-", ".").alias("a"), F.substring(F.col("o_custkey").cast("string"), 7, 100).alias("b"), (F.col("o_custkey") % 3).cast("string").alias("y"))
    return o.select(S.number("a").alias("a"), S.number("b").alias("b"), S.label("y").alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


TRIAGE = PLAUSIBLE + ", tr AS (SELECT *, demand_mean / 100.0 AS base_score FROM pl)"


@query("f5_f6_p12_triage", f"""WITH {TRIAGE}, b AS (SELECT *, CASE WHEN base_score >= 0.5 AND plausibility >= 0.5 THEN 'likely_physical' WHEN base_score >= 0.5 THEN 'suspicious_implausible' ELSE 'likely_false_alarm' END AS bucket FROM tr)
 SELECT bucket, count(*) AS n, {r('avg(pressure_max - pressure_min)')} AS pressure_range, {r('avg(demand_sum / greatest(abs(flow_abs_mean), 1e-6)) / 1000')} AS demand_flow_ratio, {r('avg(mass / greatest(sensor_coverage, 1e-6))')} AS mass_by_coverage, {r('avg(base_score * plausibility)')} AS score_by_plausibility,
 {r('avg(0.45 * base_score + 0.25 * plausibility - 0.15 * mass - 0.10 * energy + 0.05 * sensor_coverage)')} AS heuristic FROM b GROUP BY bucket""")
def f5_f6(spark, sf_dir):
    t = S.triage_features(plausible(spark, sf_dir).withColumn("base_score", F.col("demand_mean") / 100.0)).withColumn("heuristic", S.heuristic_triage_score())
    t = t.withColumn("demand_flow_ratio", F.col("demand_flow_ratio") / 1000)
    sums = [F.avg(c).alias(c) for c in ("pressure_range", "demand_flow_ratio", "mass_by_coverage", "score_by_plausibility", "heuristic")]
    return t.groupBy(S.triage_bucket(F.col("base_score"), F.col("plausibility")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


@query("f7_pipe_resistance", f"SELECT p_partkey, {r('10.67 * CAST(p_retailprice AS DOUBLE) / (pow(greatest(coalesce(nullif(CAST(p_size AS DOUBLE), 0), 100.0), 1e-3), 1.852) * pow(greatest(coalesce(nullif(p_size / 100.0, 0), 0.001), 1e-6), 4.87)) / 1e9')} AS resistance FROM part")
def f7(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (S.pipe_resistance(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"), F.col("p_size") / 100.0) / 1e9).alias("resistance"))


@query("f8_f9_event_window", """WITH d AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 - 1 <= 0 THEN 86400 ELSE (o_custkey % 7 - 1) * 40000 END AS duration, CASE WHEN o_custkey % 5 * 1000 <= 0 OR o_custkey % 5 * 1000 > 3600 THEN 3600 ELSE o_custkey % 5 * 1000 END AS step FROM orders)
 SELECT o_orderkey, CAST(duration AS BIGINT) AS duration, CAST(step AS BIGINT) AS step, CAST(floor(duration / 3) AS BIGINT) AS start_time, CAST(greatest(floor(duration / 3) + 1, floor(duration * 2 / 3)) AS BIGINT) AS end_time FROM d""")
def f8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 7 - 1) * 40000).alias("d"), (F.col("o_custkey") % 5 * 1000).alias("s"))
    o = o.select("o_orderkey", S.effective_duration(F.col("d")).cast("long").alias("duration"), S.effective_step(F.col("s")).cast("long").alias("step"))
    w = S.event_window(F.col("duration"), F.col("step"))
    return o.select("*", w["start"].alias("start_time"), w["end"].cast("long").alias("end_time"))


@query("f8_event_window_sampled")
def f8_sampled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(86400).alias("duration"), F.lit(3600).alias("step"))
    w = S.event_window(F.col("duration"), F.col("step"), S.unit_hash(F.lit("r1"), F.col("o_orderkey").cast("string")), S.unit_hash(F.lit("r2"), F.col("o_orderkey").cast("string")))
    return o.select("*", w["start"].alias("start_time"), w["end"].alias("end_time"))


HASH = lambda parts: f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / 4294967296.0)"


@query("f10_demand_multiplier", f"WITH h AS (SELECT o_orderkey, o_custkey % 4 AS d, greatest({HASH('CAST(o_orderkey AS VARCHAR), ' + chr(39) + 'u' + chr(39))}, 1e-12) AS u, {HASH('CAST(o_orderkey AS VARCHAR), ' + chr(39) + 'v' + chr(39))} AS v FROM orders) SELECT o_orderkey, {r('CASE WHEN d > 0 THEN least(2.0, greatest(0.5, 1 + 0.2 * sqrt(-2 * ln(u)) * cos(2 * pi() * v))) ELSE 1.0 END')} AS multiplier FROM h")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.demand_multiplier(F.col("o_custkey") % 4, F.col("o_orderkey").cast("string")).alias("multiplier"))


@query("f11_f12_emitter_sigmoid", f"WITH {RECORDS} SELECT event_id, {r('0.75 * mass_residual * sqrt(2 * 9.81)')} AS emitter, {r('1 / (1 + exp(-(score__a - 0.2) / 0.2))')} AS sigmoid FROM records")
def f11_f12(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", S.emitter_coefficient(F.col("mass_residual")).alias("emitter"), S.sigmoid_score(F.col("score__a"), F.lit(0.2)).alias("sigmoid"))

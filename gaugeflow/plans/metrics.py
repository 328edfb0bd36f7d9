"""Ranking metrics and reports over the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import metrics as M
from gaugeflow.operators import windows as W
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import KINDS, LONG, RECORDS, STREAM, arm_records, records

BY = ["seed", "network_id"]
STREAM_SQL = "seed, network_id, scenario_id, sensor_coverage"


def ap_sql(name: str, source: str, by: str, label: str = "event_label", score: str = "score", weight: str = "1.0") -> str:
    """CTE `name` (by, ap, auc, prior, n) of a CTE `source`."""
    return f"""{name}_g AS (SELECT {by}, {score} AS s, sum(CAST({weight} AS DOUBLE) * {label}) AS pos, sum(CAST({weight} AS DOUBLE) * (1 - {label})) AS neg FROM {source} GROUP BY {by}, {score}),
{name}_c AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER w AS p, sum(neg) OVER w AS n FROM {name}_g
  WINDOW d AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY {by})),
{name} AS (SELECT {by}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CASE WHEN p > 0 AND tp + fp > 0 THEN pos / p * tp / (tp + fp) END) END AS ap,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CASE WHEN p > 0 AND n > 0 THEN pos * (n - fp + neg / 2) / p / n END) END AS auc, max(p) / (max(p) + max(n)) AS prior, max(p + n) AS n FROM {name}_c GROUP BY {by})"""


def streams_sql(name: str, source: str, by: str, score: str = "score") -> str:
    return f"{name} AS (SELECT {by}, max({score}) AS max_score, round(avg({score}), 12) AS mean_score, max(event_label) AS label, min(scenario_kind) AS kind, count(*) AS steps FROM {source} GROUP BY {by})"


#: The residual arm: references by (network, coverage), past-only standardisation, trailing mean.
RESIDUAL = RECORDS + f""", ref AS (SELECT network_id, sensor_coverage, avg(mass_residual) AS mm, stddev_pop(mass_residual) AS ms, avg(energy_residual) AS em, stddev_pop(energy_residual) AS es
  FROM records WHERE scenario_kind = 'baseline' GROUP BY network_id, sensor_coverage),
blend AS (SELECT records.*, (mass_residual - mm) / (CASE WHEN ms > 0 THEN ms ELSE 1.0 END) + (energy_residual - em) / (CASE WHEN es > 0 THEN es ELSE 1.0 END) AS x FROM records JOIN ref USING (network_id, sensor_coverage)),
zed AS (SELECT *, CASE WHEN row_number() OVER w <= 4 THEN 0.0 ELSE (x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-9) END AS z FROM blend
  WINDOW w AS (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id), p AS (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
resid AS (SELECT * EXCLUDE (x, z), avg(z) OVER (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS score FROM zed)"""

#: All three arms in long form.
ARMS3 = RESIDUAL + """, long3 AS (SELECT 'a' AS arm, score__a AS score, * EXCLUDE (score__a, score__b, score) FROM resid UNION ALL SELECT 'b', score__b, * EXCLUDE (score__a, score__b, score) FROM resid
  UNION ALL SELECT 'resid', score, * EXCLUDE (score__a, score__b, score) FROM resid)"""


def with_residual_arm(spark, sf_dir):
    """Long records of arms a, b and resid."""
    base = W.residual_arm(records(spark, sf_dir), STREAM, ["network_id", "sensor_coverage"]).withColumnRenamed("score", "score__resid")
    return arm_records(base, ["a", "b", "resid"])


@query("flagship_arm_metrics", f"WITH {ARMS3}, {ap_sql('row', 'long3', 'seed, network_id, arm')}, {streams_sql('st', 'long3', 'arm, ' + STREAM_SQL)}, {ap_sql('top', 'st', 'seed, network_id, arm', 'label', 'max_score')}"
       f" SELECT seed, network_id, arm, {r('row.ap')} AS row_ap, {r('row.prior')} AS row_prior, {r('top.ap')} AS stream_ap, {r('top.prior')} AS stream_prior FROM row JOIN top USING (seed, network_id, arm)")  # fmt: skip
def flagship(spark, sf_dir):
    long = with_residual_arm(spark, sf_dir).repartition(*STREAM)
    keys = [*BY, "arm"]
    rows = M.ranking_metrics(long, keys).select(*keys, F.col("ap").alias("row_ap"), F.col("prior").alias("row_prior"))
    return rows.join(M.stream_metrics(long, STREAM, keys).select(*keys, "stream_ap", "stream_prior"), keys)


@query("m1_average_precision", f"WITH {LONG}, {ap_sql('m', 'long', 'seed, network_id, arm')} SELECT seed, network_id, arm, {r('ap')} AS ap FROM m")
def m1(spark, sf_dir):
    return M.average_precision(arm_records(records(spark, sf_dir)), [*BY, "arm"])


@query("m1_average_precision_ranged", f"WITH {LONG}, {ap_sql('m', 'long', 'arm')} SELECT arm, {r('ap')} AS ap FROM m")
def m1_ranged(spark, sf_dir):
    return M.average_precision(arm_records(records(spark, sf_dir)), ["arm"], parts=64)


@query("m2_roc_auc", f"WITH {LONG}, {ap_sql('m', 'long', 'seed, network_id, arm')} SELECT seed, network_id, arm, {r('auc')} AS auc FROM m")
def m2(spark, sf_dir):
    return M.roc_auc(arm_records(records(spark, sf_dir)), [*BY, "arm"])


@query("m3_weighted_average_precision", f"WITH {LONG}, w AS (SELECT *, event_id % 4 AS w FROM long), {ap_sql('m', '(SELECT * FROM w WHERE w > 0)', 'network_id, arm', weight='w')} SELECT network_id, arm, {r('ap')} AS ap FROM m")
def m3(spark, sf_dir):
    return M.weighted_average_precision(arm_records(records(spark, sf_dir)).withColumn("w", F.col("event_id") % 4), ["network_id", "arm"], "w")


@query("m4_row_metrics", f"WITH {LONG}, {ap_sql('m', 'long', 'network_id, arm')} SELECT network_id, arm, {r('ap')} AS row_ap, {r('prior')} AS row_prior FROM m")
def m4(spark, sf_dir):
    return M.ranking_metrics(arm_records(records(spark, sf_dir)), ["network_id", "arm"]).select("network_id", "arm", F.col("ap").alias("row_ap"), F.col("prior").alias("row_prior"))


def _stream_sql(pool: str) -> str:
    return (f"WITH {LONG}, {streams_sql('st', 'long', 'arm, ' + STREAM_SQL)}, {ap_sql('m', 'st', 'seed, network_id, arm', 'label', pool + '_score')}, c AS (SELECT seed, network_id, arm, count(*) AS n_streams, count(DISTINCT CASE WHEN kind = 'baseline' THEN scenario_id END) AS n_normal FROM st GROUP BY ALL)"
            f" SELECT seed, network_id, arm, {r('ap')} AS stream_ap, {r('prior')} AS stream_prior, n_streams, n_normal FROM m JOIN c USING (seed, network_id, arm)")  # fmt: skip


@query("m5_stream_metrics_max", _stream_sql("max"))
def m5_max(spark, sf_dir):
    return M.stream_metrics(arm_records(records(spark, sf_dir)), STREAM, [*BY, "arm"])


@query("m5_stream_metrics_mean", _stream_sql("mean"))
def m5_mean(spark, sf_dir):
    return M.stream_metrics(arm_records(records(spark, sf_dir)), STREAM, [*BY, "arm"], "mean")


@query("m6_slice_metrics", f"WITH {LONG}, sl AS (SELECT k AS slice, long.* FROM long CROSS JOIN (VALUES ('leak'), ('pipe_closure'), ('pump_outage')) t(k) WHERE scenario_kind = k OR scenario_kind = 'baseline'), {ap_sql('m', 'sl', 'network_id, arm, slice')},"
       f" pr AS (SELECT network_id, arm, scenario_kind AS slice, count(DISTINCT CASE WHEN event_label = 1 THEN scenario_id END) AS n_positive FROM long WHERE scenario_kind <> 'baseline' GROUP BY ALL) SELECT network_id, arm, slice, {r('ap')} AS ap, {r('prior')} AS prior, n_positive FROM m JOIN pr USING (network_id, arm, slice)")  # fmt: skip
def m6(spark, sf_dir):
    return M.slice_metrics(arm_records(records(spark, sf_dir)), ["network_id", "arm"], KINDS)


@query("m7_leak_stream_metrics", f"WITH {LONG}, t AS (SELECT arm, {STREAM_SQL}, max(score) AS whole, coalesce(max(CASE WHEN event_label = 1 THEN score END), max(score)) AS active, max(CASE WHEN scenario_kind = 'leak' THEN 1 ELSE 0 END) AS label FROM long WHERE scenario_kind IN ('leak', 'baseline') GROUP BY arm, {STREAM_SQL}),"
       f" {ap_sql('f', 't', 'network_id, arm', 'label', 'whole')}, {ap_sql('g', 't', 'network_id, arm', 'label', 'active')} SELECT network_id, arm, {r('f.ap')} AS full_ap, {r('g.ap')} AS active_ap FROM f JOIN g USING (network_id, arm)")  # fmt: skip
def m7(spark, sf_dir):
    return M.leak_stream_metrics(arm_records(records(spark, sf_dir)), STREAM, ["network_id", "arm"])


@query("m8_top_tie_fraction", f"WITH {LONG}, {streams_sql('st', 'long', 'arm, ' + STREAM_SQL)}, t AS (SELECT *, max(max_score) OVER (PARTITION BY network_id, arm) AS top FROM st) SELECT network_id, arm, {r('avg(CASE WHEN max_score = top THEN 1.0 ELSE 0.0 END)')} AS top_tie_fraction FROM t GROUP BY network_id, arm")
def m8(spark, sf_dir):
    return M.top_tie_fraction(arm_records(records(spark, sf_dir)), STREAM, ["network_id", "arm"])


@query("m9_within_stream_ap", f"WITH {LONG}, {ap_sql('m', '''(SELECT * FROM long WHERE scenario_kind = 'leak')''', 'arm, ' + STREAM_SQL)} SELECT network_id, arm, {r('avg(ap)')} AS within_ap, {r('avg(prior)')} AS chance, count(*) AS n_streams FROM m WHERE ap IS NOT NULL GROUP BY network_id, arm")
def m9(spark, sf_dir):
    return M.within_stream_ap(arm_records(records(spark, sf_dir)), STREAM, ["network_id", "arm"])


def _rsi_sql(source: str, by: str, pool: str = "max") -> str:
    return (f"{ap_sql('row', source, by + ', arm')}, {streams_sql('st', source, by + ', arm, ' + ', '.join(c for c in STREAM if c not in by.split(', ')))}, {ap_sql('top', 'st', by + ', arm', 'label', pool + '_score')},"
            f" rsi AS (SELECT {by}, max(CASE WHEN arm = 'a' THEN row.ap - top.ap END) - max(CASE WHEN arm = 'b' THEN row.ap - top.ap END) AS rsi FROM row JOIN top USING ({by}, arm) GROUP BY {by})")  # fmt: skip


@query("m10_rsi", f"WITH {LONG}, {_rsi_sql('long', 'seed, network_id')} SELECT seed, network_id, {r('rsi')} AS rsi FROM rsi")
def m10(spark, sf_dir):
    return M.rsi(arm_records(records(spark, sf_dir)), STREAM, BY, "a", "b")


@query("m10_rsi_mean_pool", f"WITH {LONG}, {_rsi_sql('long', 'seed, network_id', 'mean')} SELECT seed, network_id, {r('rsi')} AS rsi FROM rsi")
def m10_mean(spark, sf_dir):
    return M.rsi(arm_records(records(spark, sf_dir)), STREAM, BY, "a", "b", "mean")


LEVELS = [5, 10, 1000000]
LEVEL_SQL = LONG + """, nid AS (SELECT network_id, scenario_id, row_number() OVER (PARTITION BY network_id ORDER BY scenario_id) AS k FROM (SELECT DISTINCT network_id, scenario_id FROM records WHERE scenario_kind = 'baseline')),
lev AS (SELECT CAST(l AS INT) AS level, long.* FROM long CROSS JOIN (VALUES (5), (10), (1000000)) t(l) LEFT JOIN nid USING (network_id, scenario_id) WHERE scenario_kind <> 'baseline' OR k <= l)"""


def _levels(spark, sf_dir):
    long = arm_records(records(spark, sf_dir))
    out = None
    for n in LEVELS:
        one = M.keep_first_normals(long, n).withColumn("level", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("m11_rsi_by_prior", f"WITH {LEVEL_SQL}, {_rsi_sql('lev', 'level, seed, network_id')}, pr AS (SELECT level, avg(CAST(event_label AS DOUBLE)) AS prior FROM lev GROUP BY level), s AS (SELECT level, seed, avg(rsi) AS x FROM rsi GROUP BY level, seed) SELECT level, {r('max(prior)')} AS prior, {r('avg(x)')} AS rsi FROM s JOIN pr USING (level) GROUP BY level")
def m11(spark, sf_dir):
    long = _levels(spark, sf_dir)
    each = M.rsi(long, STREAM, ["level", *BY], "a", "b").groupBy("level", "seed").agg(F.avg("rsi").alias("x")).groupBy("level").agg(F.avg("x").alias("rsi"))
    return each.join(long.groupBy("level").agg(F.avg(F.col("event_label").cast("double")).alias("prior")), "level").select("level", "prior", "rsi")


@query("m12_prior_sweep", f"WITH {LEVEL_SQL}, {ap_sql('m', 'lev', 'level, network_id, arm')} SELECT level, network_id, arm, {r('ap')} AS row_ap, {r('prior')} AS row_prior FROM m")
def m12(spark, sf_dir):
    keys = ["level", "network_id", "arm"]
    return M.ranking_metrics(_levels(spark, sf_dir), keys).select(*keys, F.col("ap").alias("row_ap"), F.col("prior").alias("row_prior"))


@query("m13_scenario_report", f"WITH {LONG}, {streams_sql('st', 'long', 'arm, ' + STREAM_SQL)}, {ap_sql('m', 'st', 'network_id, arm', 'label', 'max_score')} SELECT network_id, arm, {r('ap')} AS ap, {r('auc')} AS auc, CAST(n AS BIGINT) AS n_streams, CAST(round(n * prior) AS BIGINT) AS n_positive FROM m")
def m13(spark, sf_dir):
    t = M.stream_table(arm_records(records(spark, sf_dir)), ["arm", *STREAM])
    return M.ranking_metrics(t, ["network_id", "arm"], "label", "max_score").select("network_id", "arm", "ap", "auc", F.col("n").cast("long").alias("n_streams"), F.round(F.col("n") * F.col("prior")).cast("long").alias("n_positive"))


@query("m14_lift_over_prior", f"WITH {LONG}, {ap_sql('m', 'long', 'network_id, arm')} SELECT network_id, arm, {r('ap - prior')} AS lift FROM m")
def m14(spark, sf_dir):
    return M.lift_over_prior(arm_records(records(spark, sf_dir)), ["network_id", "arm"])


@query("a5_stream_table", f"WITH {RECORDS}, {streams_sql('st', 'records', STREAM_SQL, 'score__a')} SELECT {STREAM_SQL}, {r('max_score')} AS max_score, {r('mean_score')} AS mean_score, label, kind, steps FROM st")
def a5(spark, sf_dir):
    return M.stream_table(records(spark, sf_dir), STREAM, score="score__a")


@query("a6_pool_by_scenario", f"WITH {RECORDS}, {streams_sql('st', 'records', 'scenario_id', 'score__a')} SELECT scenario_id, {r('max_score')} AS max_score, {r('mean_score')} AS mean_score, label, kind, steps FROM st")
def a6(spark, sf_dir):
    return M.stream_table(records(spark, sf_dir), ["scenario_id"], score="score__a")


@query("a7_prevalence", f"WITH {RECORDS} SELECT CASE WHEN grouping(network_id) = 1 THEN 'ALL' ELSE network_id END AS network_id, {r('avg(event_label)')} AS rate, count(*) AS n FROM records GROUP BY ROLLUP (network_id)")
def a7(spark, sf_dir):
    return M.prevalence(records(spark, sf_dir))


@query("a8_prevalence_by_slice", f"WITH {RECORDS} SELECT CASE WHEN grouping(scenario_kind) = 1 THEN 'ALL' ELSE scenario_kind END AS scenario_kind, CASE WHEN grouping(network_id) = 1 THEN 'ALL' ELSE network_id END AS network_id, {r('avg(event_label)')} AS rate, count(*) AS n FROM records GROUP BY CUBE (scenario_kind, network_id)")
def a8(spark, sf_dir):
    return M.prevalence_by_slice(records(spark, sf_dir))


def confusion_sql(name: str, source: str, by: str) -> str:
    return f"{name} AS (SELECT {by}, count(*) FILTER (score >= 0.5 AND event_label = 1) AS tp, count(*) FILTER (score >= 0.5 AND event_label = 0) AS fp, count(*) FILTER (score < 0.5 AND event_label = 0) AS tn, count(*) FILTER (score < 0.5 AND event_label = 1) AS fn FROM {source} GROUP BY {by})"


def report_sql(source: str, by: str) -> str:
    return (f"{confusion_sql('c', source, by)}, rt AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS re, coalesce(tn / nullif(tn + fp, 0), 0.0) AS sp, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0) AS acc FROM c), {ap_sql('m', source, by)}"
            f" SELECT {by}, tp, fp, tn, fn, {r('pr')} AS precision, {r('re')} AS recall, {r('sp')} AS specificity, {r('acc')} AS accuracy, tp + fp + tn + fn AS support, {r('coalesce(2 * pr * re / nullif(pr + re, 0), 0.0)')} AS f1, {r('(re + sp) / 2')} AS balanced_accuracy, {r('ap')} AS ap, {r('auc')} AS auc FROM rt JOIN m USING ({by})")  # fmt: skip


@query("a9_confusion", f"WITH {LONG}, {confusion_sql('c', 'long', 'network_id, arm')} SELECT * FROM c")
def a9(spark, sf_dir):
    return M.confusion(arm_records(records(spark, sf_dir)), ["network_id", "arm"])


@query("a10_binary_report", f"WITH {LONG}, {report_sql('long', 'network_id, arm')}")
def a10(spark, sf_dir):
    return M.binary_report(arm_records(records(spark, sf_dir)), ["network_id", "arm"])


@query("a11_report_by_coverage", f"WITH {LONG}, cov AS (SELECT 'all' AS slice, * FROM long UNION ALL SELECT CASE WHEN sensor_coverage = 0.25 THEN '0.25' ELSE '0.5' END, * FROM long), {report_sql('cov', 'arm, slice')}")
def a11(spark, sf_dir):
    return M.report_by_coverage(arm_records(records(spark, sf_dir)), ["arm"])


@query("a12_report_by_kind", f"WITH {LONG}, {report_sql('long', 'arm, scenario_kind')}")
def a12(spark, sf_dir):
    return M.binary_report(arm_records(records(spark, sf_dir)), ["arm", "scenario_kind"])

"""Time-ordered operators over the records and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import windows as W
from gaugeflow.plans.metrics import RESIDUAL, STREAM_SQL
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import RECORDS, STEPS, STREAM, records, steps

GROUP = ["seed", "network_id", "sensor_coverage"]
GROUP_SQL = "seed, network_id, sensor_coverage"
STEP_STREAM, STEP_ORDER = ["network_id", "scenario_id"], ["time_seconds", "demand_mean", "pressure_mean"]


def scored(spark, sf_dir):
    """Records with score__a as the score."""
    return records(spark, sf_dir).withColumn("score", F.col("score__a"))


SCORED = RECORDS + ", scored AS (SELECT *, score__a AS score FROM records)"
#: Thresholds by group: the quantile 1 - 1/L of the normal scores.
THRESHOLD = SCORED + f""", tn AS (SELECT {GROUP_SQL}, count(*) AS n, count(DISTINCT scenario_id) AS streams FROM scored WHERE scenario_kind = 'baseline' GROUP BY {GROUP_SQL}),
th AS (SELECT *, greatest(0.0, 1 - CAST(streams AS DOUBLE) / n) * (n - 1) AS h FROM tn),
tk AS (SELECT {GROUP_SQL}, score AS sc, row_number() OVER (PARTITION BY {GROUP_SQL} ORDER BY score) AS k FROM scored WHERE scenario_kind = 'baseline'),
thr AS (SELECT {GROUP_SQL}, min(sc) + (max(h) - floor(max(h))) * (max(sc) - min(sc)) AS threshold FROM tk JOIN th USING ({GROUP_SQL}) WHERE k = floor(h) + 1 OR k = ceil(h) + 1 GROUP BY {GROUP_SQL}),
held AS (SELECT scored.*, threshold FROM scored JOIN thr USING ({GROUP_SQL}))"""
ONSET = f""", ons AS (SELECT *, min(CASE WHEN event_label = 1 THEN time_seconds END) OVER s AS onset, max(CASE WHEN event_label = 1 THEN time_seconds END) OVER s AS last_on, max(time_seconds) OVER s AS last FROM held WINDOW s AS (PARTITION BY {STREAM_SQL}))"""
DELAY = ONSET + f""", delay AS (SELECT {STREAM_SQL}, CASE WHEN min(CASE WHEN score >= threshold THEN time_seconds END) IS NULL THEN 0 ELSE 1 END AS detected, coalesce(min(CASE WHEN score >= threshold THEN time_seconds END), max(last_on)) - max(onset) AS delay
  FROM ons WHERE onset IS NOT NULL AND time_seconds >= onset AND time_seconds <= last_on GROUP BY {STREAM_SQL})"""


def held(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.join(F.broadcast(W.exceedance_threshold(df, STREAM, GROUP)), GROUP)


@query("w1_trends", f"WITH {STEPS}, t AS (SELECT *, coalesce(pressure_mean - lag(pressure_mean) OVER w, 0.0) AS pt, coalesce(demand_mean - lag(demand_mean) OVER w, 0.0) AS dt FROM steps WINDOW w AS (PARTITION BY network_id, scenario_id ORDER BY time_seconds, demand_mean, pressure_mean))"
       f" SELECT network_id, scenario_id, time_seconds, {r('pt')} AS pressure_trend, {r('sum(pt) OVER (PARTITION BY network_id, scenario_id ORDER BY time_seconds, demand_mean, pressure_mean ROWS UNBOUNDED PRECEDING)')} AS pressure_trend_cumsum, {r('dt')} AS demand_trend FROM t")  # fmt: skip
def w1(spark, sf_dir):
    out = W.trends(steps(spark, sf_dir), STEP_STREAM, STEP_ORDER, {"pressure_mean": "pressure_trend", "demand_mean": "demand_trend"})
    return out.select(*STEP_STREAM, "time_seconds", "pressure_trend", "pressure_trend_cumsum", "demand_trend")


@query("a3_normal_reference", f"WITH {RECORDS} SELECT network_id, sensor_coverage, count(*) AS n_reference, {r('avg(mass_residual)')} AS mean__mass_residual, {r('stddev_pop(mass_residual)')} AS sd__mass_residual FROM records WHERE scenario_kind = 'baseline' GROUP BY ALL")
def a3(spark, sf_dir):
    return W.normal_reference(records(spark, sf_dir), ["network_id", "sensor_coverage"], ["mass_residual"])


@query("a4_normalise", f"WITH {RECORDS}, ref AS (SELECT network_id, sensor_coverage, avg(mass_residual) AS m, stddev_pop(mass_residual) AS s FROM records WHERE scenario_kind = 'baseline' GROUP BY ALL) SELECT event_id, {r('CASE WHEN s > 0 THEN (mass_residual - m) / s ELSE 0 END')} AS z__mass_residual FROM records JOIN ref USING (network_id, sensor_coverage)")
def a4(spark, sf_dir):
    df, by = records(spark, sf_dir), ["network_id", "sensor_coverage"]
    return W.normalise(df, W.normal_reference(df, by, ["mass_residual"]), by, ["mass_residual"]).select("event_id", "z__mass_residual")


@query("w2_causal_residual_score", f"WITH {RESIDUAL} SELECT event_id, {r('score')} AS score FROM resid")
def w2(spark, sf_dir):
    df, by = records(spark, sf_dir), ["network_id", "sensor_coverage"]
    return W.causal_residual_score(df, STREAM, W.normal_reference(df, by, ["mass_residual", "energy_residual"]), by).select("event_id", "score")


@query("w3_residual_arm", f"WITH {RESIDUAL} SELECT {STREAM_SQL}, {r('max(score)')} AS max_score FROM resid GROUP BY {STREAM_SQL}")
def w3(spark, sf_dir):
    return W.residual_arm(records(spark, sf_dir), STREAM, ["network_id", "sensor_coverage"]).groupBy(*STREAM).agg(F.max("score").alias("max_score"))


@query("w4_causal_residual_self", f"""WITH {RECORDS}, b AS (SELECT *, (mass_residual - avg(mass_residual) OVER s) / (stddev_pop(mass_residual) OVER s + 1e-9) + (energy_residual - avg(energy_residual) OVER s) / (stddev_pop(energy_residual) OVER s + 1e-9) AS x, count(*) OVER s AS c FROM records WINDOW s AS (PARTITION BY {STREAM_SQL})),
 z AS (SELECT *, CASE WHEN row_number() OVER w <= 4 THEN 0.0 ELSE (x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-9) END AS z FROM b WINDOW w AS (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id), p AS (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_id, {r(f'avg(z) OVER (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS score FROM z""")
def w4(spark, sf_dir):
    return W.causal_residual_self(records(spark, sf_dir), STREAM).select("event_id", "score")


@query("w5_detection_delay", f"WITH {THRESHOLD}{DELAY} SELECT {STREAM_SQL}, detected, {r('round(delay, 3)')} AS delay FROM delay")
def w5(spark, sf_dir):
    return W.detection_delay(held(spark, sf_dir), STREAM, "threshold").withColumn("delay", F.round("delay", 3))


@query("w6_detection_delay_open", f"WITH {THRESHOLD}{ONSET} SELECT {STREAM_SQL}, CASE WHEN min(CASE WHEN score >= threshold THEN time_seconds END) IS NULL THEN 0 ELSE 1 END AS detected, {r('round(coalesce(min(CASE WHEN score >= threshold THEN time_seconds END), max(last)) - max(onset), 3)')} AS delay FROM ons WHERE onset IS NOT NULL AND time_seconds >= onset GROUP BY {STREAM_SQL}")
def w6(spark, sf_dir):
    return W.detection_delay(held(spark, sf_dir), STREAM, "threshold", closed=False).withColumn("delay", F.round("delay", 3))


@query("w7_early_warning", f"WITH {THRESHOLD}{DELAY} SELECT {GROUP_SQL}, {r('round(median(delay), 3)')} AS median_delay, {r('avg(CASE WHEN detected = 1 AND delay < 10800 THEN 1.0 ELSE 0.0 END)')} AS within_3h, {r('avg(detected)')} AS in_window, count(*) AS n_streams FROM delay JOIN (SELECT DISTINCT scenario_id FROM scored WHERE scenario_kind = 'leak') USING (scenario_id) GROUP BY {GROUP_SQL}")
def w7(spark, sf_dir):
    return W.early_warning(held(spark, sf_dir), STREAM, GROUP, "threshold").withColumn("median_delay", F.round("median_delay", 3))


@query("w8_exceedance_threshold", f"WITH {THRESHOLD} SELECT {GROUP_SQL}, {r('threshold')} AS threshold FROM thr")
def w8(spark, sf_dir):
    return W.exceedance_threshold(scored(spark, sf_dir), STREAM, GROUP)


@query("w9_false_alarm_rows", f"WITH {THRESHOLD}, e AS (SELECT {STREAM_SQL}, count(*) FILTER (score >= threshold) AS x FROM held WHERE scenario_kind = 'baseline' GROUP BY {STREAM_SQL}) SELECT {GROUP_SQL}, {r('avg(x)')} AS false_alarm_rows FROM e GROUP BY {GROUP_SQL}")
def w9(spark, sf_dir):
    return W.false_alarm_rows(held(spark, sf_dir), STREAM, GROUP, "threshold")


EPISODES = f""", onn AS (SELECT *, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS o FROM held), st AS (SELECT *, CASE WHEN o = 1 AND coalesce(lag(o) OVER (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id), 0) = 0 THEN 1 ELSE 0 END AS s FROM onn),
ep AS (SELECT {STREAM_SQL}, min(scenario_kind) AS kind, CAST(sum(s) AS BIGINT) AS episodes, count(*) AS rows FROM st GROUP BY {STREAM_SQL})"""
STEP_BY = ["seed", "network_id"]
STEP_LEN = """, tm AS (SELECT DISTINCT seed, network_id, time_seconds FROM scored), gp AS (SELECT *, time_seconds - lag(time_seconds) OVER (PARTITION BY seed, network_id ORDER BY time_seconds) AS gap FROM tm), sl AS (SELECT seed, network_id, median(gap) AS step FROM gp GROUP BY seed, network_id)"""


@query("w10_alarm_episodes", f"WITH {THRESHOLD}{EPISODES} SELECT {STREAM_SQL}, episodes FROM ep")
def w10(spark, sf_dir):
    return W.alarm_episodes(held(spark, sf_dir), STREAM, "threshold")


@query("w11_episodes_per_day", f"WITH {THRESHOLD}{EPISODES}{STEP_LEN} SELECT {GROUP_SQL}, {r('sum(episodes) / (sum(rows) * max(step) / 86400.0)')} AS per_day FROM ep JOIN sl USING (seed, network_id) WHERE kind = 'baseline' GROUP BY {GROUP_SQL}")
def w11(spark, sf_dir):
    return W.episodes_per_day(held(spark, sf_dir), STREAM, GROUP, "threshold", STEP_BY)


@query("a22_step_length", f"WITH {SCORED}{STEP_LEN} SELECT seed, network_id, {r('step')} AS step FROM sl")
def a22(spark, sf_dir):
    return W.step_length(records(spark, sf_dir), STEP_BY)


def budget_sql(*budgets: float) -> str:
    """The plain rule, over each candidate and row and each budget."""
    return f""", bt AS (SELECT {GROUP_SQL}, score, CASE WHEN lag(score) OVER (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id) IS NOT NULL THEN least(score, lag(score) OVER (PARTITION BY {STREAM_SQL} ORDER BY time_seconds, event_id)) END AS low, row_number() OVER (PARTITION BY {GROUP_SQL} ORDER BY score) AS k FROM scored WHERE scenario_kind = 'baseline'),
bn AS (SELECT {GROUP_SQL}, count(*) AS n, max(score) AS most FROM bt GROUP BY {GROUP_SQL}), bg AS (SELECT bn.*, step, round((1 - exp(ln(0.3) + i / 399.0 * (ln(1e-6) - ln(0.3)))) * (n - 1), 9) AS h FROM bn JOIN sl USING (seed, network_id) CROSS JOIN range(400) t(i)),
bc AS (SELECT DISTINCT {', '.join('bg.' + c for c in GROUP)}, bg.n, step, most, lo.score + (h - floor(h)) * (hi.score - lo.score) AS t FROM bg JOIN bt lo ON lo.k = floor(h) + 1 AND {' AND '.join(f'lo.{c} = bg.{c}' for c in GROUP)} JOIN bt hi ON hi.k = ceil(h) + 1 AND {' AND '.join(f'hi.{c} = bg.{c}' for c in GROUP)}),
be AS (SELECT {', '.join('bc.' + c for c in GROUP)}, t, max(bc.n) AS n, max(step) AS step, max(most) AS most, count(*) FILTER (score >= t) - count(*) FILTER (low >= t) AS episodes FROM bc JOIN bt USING ({GROUP_SQL}) GROUP BY ALL),
budget AS (SELECT {GROUP_SQL}, b AS budget, max(step) AS step, coalesce(min(CASE WHEN episodes <= b * n * step / 86400.0 THEN t END), max(most) + 1e-9) AS threshold FROM be CROSS JOIN (VALUES {', '.join(f'({b}::DOUBLE)' for b in budgets)}) v(b) GROUP BY {GROUP_SQL}, b)"""


@query("w12_budget_threshold", f"WITH {SCORED}{STEP_LEN}{budget_sql(1.0)} SELECT {GROUP_SQL}, {r('threshold')} AS threshold FROM budget")
def w12(spark, sf_dir):
    return W.budget_threshold(scored(spark, sf_dir), STREAM, GROUP, 1.0, STEP_BY)


BUDGETS = [0.5, 1.0, 2.0]
RATES = f"""{SCORED}{STEP_LEN}{budget_sql(*BUDGETS)}, lk AS (SELECT * FROM scored WHERE scenario_kind = 'leak'),
os AS (SELECT {STREAM_SQL}, min(CASE WHEN event_label = 1 THEN time_seconds END) AS onset, max(CASE WHEN event_label = 1 THEN time_seconds END) AS last_on FROM lk GROUP BY {STREAM_SQL}),
hit AS (SELECT {STREAM_SQL}, budget, max(step) AS step, max(onset) AS onset, min(CASE WHEN time_seconds BETWEEN onset AND last_on AND score >= threshold THEN time_seconds END) AS first, max(CASE WHEN time_seconds < onset AND score >= threshold THEN 1.0 ELSE 0.0 END) AS e
  FROM lk JOIN os USING ({STREAM_SQL}) JOIN budget USING ({GROUP_SQL}) WHERE onset IS NOT NULL GROUP BY {STREAM_SQL}, budget),
rates AS (SELECT {GROUP_SQL}, budget, avg(CASE WHEN first - onset < 10800 THEN 1.0 ELSE 0.0 END) AS within_3h, avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END) AS in_window, avg(e) AS pre_onset, count(*) AS n_streams, max(step) AS step FROM hit GROUP BY {GROUP_SQL}, budget)"""


@query("w13_alarm_budget", f"WITH {RATES} SELECT {GROUP_SQL}, budget, {r('within_3h')} AS within_3h, {r('in_window')} AS in_window, {r('pre_onset')} AS pre_onset, n_streams, {r('step / 3600.0')} AS step_hours, CAST(round_even(10800.0 / step, 0) AS BIGINT) AS steps_3h FROM rates")
def w13(spark, sf_dir):
    return W.alarm_budget(scored(spark, sf_dir), STREAM, GROUP, BUDGETS, STEP_BY)


@query("w13_alarm_budget_seeds", f"WITH {RATES}, pooled AS (SELECT seed, network_id, budget, {', '.join(f'sum({c} * n_streams) / sum(n_streams) AS {c}' for c in ('within_3h', 'in_window', 'pre_onset'))} FROM rates GROUP BY seed, network_id, budget)"
       f" SELECT network_id, budget, {', '.join(r(f'{f}({c})') + f' AS {c}_{n}' for c in ('within_3h', 'in_window', 'pre_onset') for f, n in (('avg', 'mean'), ('stddev_pop', 'std')))}, count(*) AS n_runs FROM pooled GROUP BY network_id, budget")  # fmt: skip
def w13_seeds(spark, sf_dir):
    return W.alarm_budget_summary(W.alarm_budget(scored(spark, sf_dir), STREAM, GROUP, BUDGETS, STEP_BY), STEP_BY, ["network_id"])


@query("w14_pre_onset_alarm", f"WITH {THRESHOLD}{ONSET} SELECT {STREAM_SQL}, max(CASE WHEN time_seconds < onset AND score >= threshold THEN 1 ELSE 0 END) AS early FROM ons WHERE onset IS NOT NULL GROUP BY {STREAM_SQL}")
def w14(spark, sf_dir):
    return W.pre_onset_alarm(held(spark, sf_dir), STREAM, "threshold")


@query("w15_pack_sequences", f"WITH {SCORED}, p AS (SELECT {STREAM_SQL}, list(score ORDER BY time_seconds, event_id) AS v FROM scored GROUP BY {STREAM_SQL}) SELECT {STREAM_SQL}, unnest(range(24)) AS i, {r('coalesce(v[unnest(range(24)) + 1], 0.0)')} AS value FROM p")
def w15(spark, sf_dir):
    return W.pack_sequences(scored(spark, sf_dir), STREAM, "score").select(*STREAM, F.posexplode("values").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("w16_broadcast_stream_score", f"WITH {SCORED} SELECT event_id, {r(f'max(score) OVER (PARTITION BY {STREAM_SQL})')} AS stream_score, max(event_label) OVER (PARTITION BY {STREAM_SQL}) AS stream_label, CASE WHEN max(score) OVER (PARTITION BY {STREAM_SQL}) >= 0.5 THEN 1 ELSE 0 END AS stream_predicted FROM scored")
def w16(spark, sf_dir):
    return W.broadcast_stream_score(scored(spark, sf_dir), STREAM).select("event_id", "stream_score", "stream_label", "stream_predicted")


@query("w17_sequence_dataset", f"WITH {SCORED} SELECT {STREAM_SQL}, count(*) AS steps, max(event_label) AS label, {r('sum(CAST(score__b AS FLOAT))')} AS checksum FROM scored GROUP BY {STREAM_SQL} HAVING min(scenario_kind) = 'baseline' OR max(event_label) = 1")
def w17(spark, sf_dir):
    out = W.sequence_dataset(scored(spark, sf_dir), STREAM, ["score__a", "score__b"])
    return out.select(*STREAM, "steps", "label", F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x[1].cast("double")).alias("checksum"))


@query("w18_channel_width_gate", f"WITH {STEPS} SELECT network_id, CASE WHEN count(DISTINCT observed_count) = 1 THEN 1 ELSE 0 END AS usable FROM steps WHERE source <> 'R' GROUP BY network_id")
def w18(spark, sf_dir):
    return W.channel_width_gate(steps(spark, sf_dir).withColumn("scenario_kind", F.when(F.col("source") == "R", "leak").otherwise("baseline")), ["network_id"])

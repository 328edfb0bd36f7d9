"""Paired comparisons, tests and resampling over per-group metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import compare as C
from gaugeflow.operators import metrics as M
from gaugeflow.plans.aggregates import ARM_AP, HASH
from gaugeflow.plans.metrics import ap_sql
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import LONG, STEPS, STREAM, arm_records, records, steps


def arm_ap(spark, sf_dir, by=("seed", "network_id", "arm")):
    return M.ranking_metrics(arm_records(records(spark, sf_dir)), list(by))


def deltas(spark, sf_dir):
    """Arm b minus arm a per seed and network, as twelve pairs."""
    return C.paired_baseline(arm_ap(spark, sf_dir), ["seed", "network_id"], "a", "ap")


DELTAS = ARM_AP + ", dl AS (SELECT x.arm, x.seed, x.network_id, x.ap - y.ap AS delta FROM m x JOIN m y ON x.seed = y.seed AND x.network_id = y.network_id AND y.arm = 'a' WHERE x.arm <> 'a' AND x.ap IS NOT NULL AND y.ap IS NOT NULL)"
#: Exact two-sided p of signed ranks over untied, nonzero differences, by all sign patterns.
WILCOXON = """, wr AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY abs(delta)) AS k FROM {source}),
ws AS (SELECT {by}, count(*) AS n, least(sum(CASE WHEN delta > 0 THEN k ELSE 0 END), sum(CASE WHEN delta < 0 THEN k ELSE 0 END)) AS w FROM wr GROUP BY {by}),
wp AS (SELECT {by}, n, w, bits, list_sum([CASE WHEN (bits >> (i - 1)) & 1 = 1 THEN i ELSE 0 END FOR i IN range(1, n + 1)]) AS t FROM ws, range(65536) b(bits) WHERE bits < CAST(pow(2, n) AS BIGINT)),
wx AS (SELECT {by}, n, w, least(1.0, 2 * avg(CASE WHEN t <= w THEN 1.0 ELSE 0.0 END)) AS p FROM wp GROUP BY {by}, n, w)"""


FLAG = "CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS significant, CAST(NULL AS VARCHAR) AS error"


def student_sql(rho: str, n: str) -> str:
    """Two-sided p of a correlation by the finite sums that Student's distribution is for whole degrees of freedom."""
    even = f"abs({rho}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * ln(1 - {rho} * {rho}))))"
    odd = f"2 / pi() * (asin(abs({rho})) + coalesce(abs({rho}) * sqrt(1 - {rho} * {rho}) * list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln(1 - {rho} * {rho})))), 0))"
    return f"CASE WHEN {n} < 3 THEN NULL WHEN abs({rho}) >= 1 THEN 0 WHEN {n} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


def normal_sql(t: str) -> str:
    """Twice the normal tail above t, by the power series of the integral."""
    return f"(1 - 2 * exp(-{t} * {t} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest({t}, 1e-30)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))))"


@query("j10_paired_baseline", f"WITH {DELTAS} SELECT arm, seed, network_id, {r('delta')} AS delta FROM dl")
def j10(spark, sf_dir):
    return deltas(spark, sf_dir)


@query("a24_delta_vs_baseline", f"WITH {DELTAS} SELECT network_id, {r('avg(delta)')} AS delta FROM dl GROUP BY network_id")
def a24(spark, sf_dir):
    return deltas(spark, sf_dir).groupBy("network_id").agg(F.avg("delta").alias("delta"))


@query("t1_wilcoxon", f"WITH {DELTAS}{WILCOXON.format(by='arm', source='dl')} SELECT arm, n, CAST(w AS DOUBLE) AS statistic, {r('p')} AS p, {r('1 - 2 * w / (n * (n + 1) / 2)')} AS effect, {FLAG} FROM wx")
def t1(spark, sf_dir):
    return C.wilcoxon(deltas(spark, sf_dir), ["arm"])


@query("t2_holm", f"WITH {DELTAS}, nd AS (SELECT network_id AS arm, delta FROM dl){WILCOXON.format(by='arm', source='nd')}, h AS (SELECT arm, p, (count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1) * p AS x FROM wx), g AS (SELECT arm, p, least(1.0, max(x) OVER (ORDER BY p, arm)) AS q FROM h) SELECT arm, {r('p')} AS p, {r('q')} AS p_holm, CASE WHEN q < 0.05 THEN 1 ELSE 0 END AS reject FROM g")
def t2(spark, sf_dir):
    p = C.wilcoxon(deltas(spark, sf_dir).drop("arm").withColumnRenamed("network_id", "arm"), ["arm"]).withColumn("family", F.lit("all"))
    return C.holm(p, ["family"]).select("arm", "p", "p_holm", "reject")


@query("t3_spearman", f"WITH {ARM_AP}, w AS (SELECT seed, network_id, max(CASE WHEN arm = 'a' THEN ap END) AS x, max(CASE WHEN arm = 'b' THEN ap END) AS y FROM m GROUP BY seed, network_id), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM w WHERE x IS NOT NULL AND y IS NOT NULL) SELECT family, {r('rho')} AS rho, n, {r(student_sql('rho', 'n'))} AS p FROM (SELECT 'all' AS family, corr(a, b) AS rho, count(*) AS n FROM k)")
def t3(spark, sf_dir):
    return C.spearman(_wide(spark, sf_dir), ["family"], "x", "y")


def _wide(spark, sf_dir):
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("ap")))
    return arm_ap(spark, sf_dir).groupBy("seed", "network_id").agg(side("a").alias("x"), side("b").alias("y")).withColumn("family", F.lit("all")).withColumn("id", F.concat("network_id", "seed"))


@query("t3_spearman_rows", f"WITH {STEPS}, k AS (SELECT network_id, rank() OVER (PARTITION BY network_id ORDER BY pressure_mean) + (count(*) OVER (PARTITION BY network_id, pressure_mean) - 1) / 2.0 AS a, rank() OVER (PARTITION BY network_id ORDER BY demand_mean) + (count(*) OVER (PARTITION BY network_id, demand_mean) - 1) / 2.0 AS b FROM steps) SELECT network_id, {r('rho')} AS rho, n, {r(student_sql('rho', 'n'))} AS p FROM (SELECT network_id, corr(a, b) AS rho, count(*) AS n FROM k GROUP BY network_id)")
def t3_rows(spark, sf_dir):
    return C.spearman(steps(spark, sf_dir), ["network_id"], "pressure_mean", "demand_mean")


@query("t4_spearman_ordinal", f"WITH {ARM_AP}, w AS (SELECT concat(network_id, CAST(seed AS VARCHAR)) AS id, max(CASE WHEN arm = 'a' THEN ap END) AS x, max(CASE WHEN arm = 'b' THEN ap END) AS y FROM m GROUP BY seed, network_id), k AS (SELECT row_number() OVER (ORDER BY x, id) AS a, row_number() OVER (ORDER BY y, id) AS b FROM w WHERE x IS NOT NULL AND y IS NOT NULL) SELECT family, {r('rho')} AS rho, n, {r(normal_sql('t'))} AS p FROM (SELECT *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM (SELECT 'all' AS family, corr(a, b) AS rho, count(*) AS n FROM k))")
def t4(spark, sf_dir):
    return C.spearman(_wide(spark, sf_dir), ["family"], "x", "y", ordinal=True, tie="id")


@query("t5_t6_paired_deltas", f"WITH {DELTAS}{WILCOXON.format(by='network_id', source='dl')}, pd AS (SELECT network_id, avg(delta) AS d, count(*) FILTER (delta > 0) AS wins, count(*) AS n, 2.5 * stddev_samp(delta) / sqrt(count(*)) AS mde FROM dl GROUP BY network_id HAVING count(*) >= 3) SELECT network_id, {r('d')} AS mean_delta, wins, pd.n, {r('mde')} AS mde, CASE WHEN pd.n >= 6 THEN {r('p')} END AS p FROM pd JOIN wx USING (network_id)")
def t5(spark, sf_dir):
    return C.paired_deltas(deltas(spark, sf_dir), ["network_id"])


@query("t7_family_deltas", f"WITH {DELTAS}, f AS (SELECT seed, CASE WHEN network_id IN ('net0', 'net1') THEN 'small' ELSE network_id END AS member, avg(delta) AS delta FROM dl GROUP BY 1, 2){WILCOXON.format(by='seed', source='f')}, pd AS (SELECT seed, avg(delta) AS d, count(*) FILTER (delta > 0) AS wins, count(*) AS n, 2.5 * stddev_samp(delta) / sqrt(count(*)) AS mde FROM f GROUP BY seed HAVING count(*) >= 3) SELECT seed, {r('d')} AS mean_delta, wins, pd.n, {r('mde')} AS mde, CASE WHEN pd.n >= 6 THEN {r('p')} END AS p FROM pd JOIN wx USING (seed)")
def t7(spark, sf_dir):
    f = C.family_deltas(deltas(spark, sf_dir), F.when(F.col("network_id").isin("net0", "net1"), "small"), ["seed"])
    return C.paired_deltas(f, ["seed"])


@query("t8_leave_one_out", f"WITH {DELTAS}, lo AS (SELECT d.network_id AS dropped, dl.delta FROM dl, (SELECT DISTINCT network_id FROM dl) d WHERE d.network_id <> dl.network_id){WILCOXON.format(by='dropped', source='lo')} SELECT dropped, n, CAST(w AS DOUBLE) AS statistic, {r('p')} AS p, {r('1 - 2 * w / (n * (n + 1) / 2)')} AS effect, {FLAG} FROM wx")
def t8(spark, sf_dir):
    return C.wilcoxon(C.leave_one_out(deltas(spark, sf_dir), "network_id"), ["dropped"])


@query("t9_regression_check", f"WITH {LONG}, {ap_sql('m', 'long', 'network_id, arm')}, {ap_sql('e', 'long', 'network_id, arm', score='round(score, 1)')} SELECT network_id, arm, {r('m.ap - e.ap')} AS difference FROM m FULL JOIN e USING (network_id, arm)")
def t9(spark, sf_dir):
    long, keys = arm_records(records(spark, sf_dir)), ["network_id", "arm"]
    return C.regression_check(M.average_precision(long, keys), M.average_precision(long.withColumn("score", F.round("score", 1)), keys), keys, "ap")


def draws_sql(name: str, members: str, by: str, member: str, count: int, salt: str) -> str:
    """CTE `name` (by, b, member, times) of resamples by hash."""
    cast = ", ".join(f"CAST({c} AS VARCHAR)" for c in by.split(", "))
    pick = HASH(f"'{salt}', CAST(b AS VARCHAR), {cast}, CAST(k AS VARCHAR)")
    return (f"{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {member}) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, {member} FROM {members})),"
            f" {name}_s AS (SELECT {by}, b, CAST(floor({pick} * n) AS BIGINT) AS k FROM {name}_o, range({count}) t(b)), {name} AS (SELECT {by}, b, {member}, count(*) AS times FROM {name}_s JOIN {name}_o USING ({by}, k) GROUP BY {by}, b, {member})")  # fmt: skip


def weighted_sql(name: str, rows: str, members: str, count: int, salt: str) -> str:
    """CTE `name`: the rows once for each draw in which their member counts, with b and times."""
    cast = ", ".join(f"CAST({c} AS VARCHAR)" for c in members.split(", "))
    times = " + ".join(f"CAST(x >= {t} AS INT)" for t in C.TIMES)
    return (f"{name} AS (SELECT *, {times} AS times FROM (SELECT * EXCLUDE (h, k, i), k * {C.DRAWS} + i AS b, CAST('0x' || substr(h, CAST(i * 4 + 1 AS INT), 4) AS INT) AS x FROM (SELECT {rows}.*, k, md5(concat_ws('|', '{salt}', CAST(k AS VARCHAR), {cast})) AS h FROM {rows}, range({-(-count // C.DRAWS)}) t(k)) q, range({C.DRAWS}) u(i)) v"
            f" WHERE b < {count} AND x >= {C.TIMES[0]})")  # fmt: skip


def boot_ap_sql(by: str, member: str, count: int, base: str = LONG, rows: str = "long") -> str:
    return (f"WITH {base}, {ap_sql('pt', rows, by)}, {weighted_sql('wt', rows, by + ', ' + member, count, 'ap')}, {ap_sql('bm', 'wt', by + ', b', weight='times')},"
            f" en AS (SELECT {by}, avg(ap) AS mean, quantile_cont(ap, 0.025) AS lo, quantile_cont(ap, 0.975) AS hi, count(*) AS valid FROM bm WHERE ap IS NOT NULL GROUP BY {by}) SELECT {by}, {r('pt.ap')} AS point, {r('mean')} AS mean, {r('lo')} AS lo, {r('hi')} AS hi, coalesce(valid, 0) AS valid FROM pt LEFT JOIN en USING ({by})")  # fmt: skip


@query("b1_bootstrap_ap_rows", boot_ap_sql("network_id, arm", "event_id", 1000))
def b1(spark, sf_dir):
    return C.bootstrap_ap(arm_records(records(spark, sf_dir)), ["network_id", "arm"], "event_id", 1000)


@query("b2_bootstrap_ap_scenarios", boot_ap_sql("network_id, arm", "scenario_id", 1000))
def b2(spark, sf_dir):
    return C.bootstrap_ap(arm_records(records(spark, sf_dir)), ["network_id", "arm"], "scenario_id", 1000)


def _boot_rsi_sql(count: int, group: str = "network_id") -> str:
    top = f"tp AS (SELECT arm, {', '.join(STREAM)}, max(score) AS score, max(event_label) AS event_label FROM long GROUP BY ALL)"
    rsi = lambda name, more: f"{name} AS (SELECT {group}{more}, max(CASE WHEN arm = 'a' THEN x.ap - y.ap END) - max(CASE WHEN arm = 'b' THEN x.ap - y.ap END) AS rsi FROM {name}_r x JOIN {name}_t y USING ({group}, arm{more}) GROUP BY {group}{more})"
    return (f"WITH {LONG}, {top}, {ap_sql('p_r', 'long', group + ', arm')}, {ap_sql('p_t', 'tp', group + ', arm')}, {rsi('p', '')},"
            f" {weighted_sql('lw', 'long', group + ', scenario_id', count, 'rsi')}, {weighted_sql('tw', 'tp', group + ', scenario_id', count, 'rsi')}, {ap_sql('b_r', 'lw', group + ', arm, b', weight='times')}, {ap_sql('b_t', 'tw', group + ', arm, b', weight='times')}, {rsi('b', ', b')},"
            f" en AS (SELECT {group}, quantile_cont(rsi, 0.025) AS lo, quantile_cont(rsi, 0.975) AS hi, count(*) AS valid FROM b WHERE rsi IS NOT NULL GROUP BY {group}) SELECT {group}, {r('rsi')} AS point, {r('lo')} AS lo, {r('hi')} AS hi, valid FROM p LEFT JOIN en USING ({group})")  # fmt: skip


@query("b3_bootstrap_rsi", _boot_rsi_sql(500))
def b3(spark, sf_dir):
    return C.bootstrap_rsi(arm_records(records(spark, sf_dir)), STREAM, "network_id", "a", "b", 500)


@query("b4_bootstrap_rsi_one_seed", _boot_rsi_sql(2000).replace("FROM records\n  UNION", "FROM records WHERE seed = 42\n  UNION").replace("(score__a, score__b) FROM records, tp", "(score__a, score__b) FROM records, tp").replace("long AS (", "long AS (SELECT * FROM (", 1).replace("FROM records), tp AS", "FROM records) WHERE seed = 42), tp AS"))
def b4(spark, sf_dir):
    return C.bootstrap_rsi(arm_records(records(spark, sf_dir).where("seed = 42")), STREAM, "network_id", "a", "b", 2000)


def _boot_mean_sql(source: str, by: str, member: str, column: str, count: int, salt: str) -> str:
    return (f"bv AS (SELECT {by}, {member}, avg({column}) AS v FROM {source} WHERE {column} IS NOT NULL GROUP BY {by}, {member}), {draws_sql('dr', 'bv', by, member, count, salt)}, bm AS (SELECT {by}, b, sum(v * times) / sum(times) AS m FROM bv JOIN dr USING ({by}, {member}) GROUP BY {by}, b),"
            f" en AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY {by}), ba AS (SELECT {by}, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS c FROM bv GROUP BY {by}) SELECT {by}, {r('mean')} AS mean, {r('std')} AS std, {r('CASE WHEN c >= 2 THEN lo END')} AS lo, {r('CASE WHEN c >= 2 THEN hi END')} AS hi FROM ba JOIN en USING ({by})")  # fmt: skip


@query("b5_bootstrap_networks", f"WITH {ARM_AP}, {_boot_mean_sql('m', 'arm', 'network_id', 'ap', 2000, 'nets')}")
def b5(spark, sf_dir):
    return C.bootstrap_mean(arm_ap(spark, sf_dir), ["arm"], "network_id", "ap", 2000, "nets")


@query("b5_bootstrap_network_deltas", f"WITH {DELTAS}, {_boot_mean_sql('dl', 'arm', 'network_id', 'delta', 2000, 'nets')}")
def b5_delta(spark, sf_dir):
    return C.bootstrap_mean(deltas(spark, sf_dir), ["arm"], "network_id", "delta", 2000, "nets")


@query("b6_multi_seed_ci", f"WITH {ARM_AP}, {_boot_mean_sql('m', 'network_id, arm', 'seed', 'ap', 2000, 'seeds')}")
def b6(spark, sf_dir):
    return C.bootstrap_mean(arm_ap(spark, sf_dir), ["network_id", "arm"], "seed", "ap", 2000, "seeds")


@query("o6_best_arm", f"WITH {LONG}, {ap_sql('m', 'long', 'network_id, arm')} SELECT network_id, arm, CASE WHEN round(ap, 3) = max(round(ap, 3)) OVER (PARTITION BY network_id) THEN 1 ELSE 0 END AS best FROM m")
def o6(spark, sf_dir):
    from gaugeflow.operators.joins import best_arm

    return best_arm(arm_ap(spark, sf_dir, ("network_id", "arm")), ["network_id"], "ap").select("network_id", "arm", "best")



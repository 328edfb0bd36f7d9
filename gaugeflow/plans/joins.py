"""Projections, guards, joins, set operations, catalogs and sampling."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from gaugeflow.functions.scalar import net_seed, unit_hash
from gaugeflow.operators import calibration as K
from gaugeflow.operators import joins as J
from gaugeflow.operators import sampling as G
from gaugeflow.plans.aggregates import HASH
from gaugeflow.plans.metrics import ap_sql
from gaugeflow.plans.registry import query, r
from gaugeflow.sources.adapters import RECORDS, STEPS, STREAM, records, steps, table


@query("s3_projected_read", f"SELECT event_id, {r('value')} AS value FROM events WHERE event_type = 'view'")
def s3(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "value")


@query("s14_pending_keys", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def s14(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return J.pending_keys(o.select(F.col("o_custkey").alias("key")).distinct(), o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key")), ["key"])


@query("s12_extract_paths", """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(concat('see "', p_name, '.INP", and ', p_brand, '/net.inp; none'), '(?i)[^\\s"'';,]+\\.inp')) AS path FROM part) SELECT path FROM t WHERE path IN (SELECT concat(p_brand, '/net.inp') FROM part WHERE p_size % 2 = 0)""")
def s12(spark, sf_dir):
    from gaugeflow.sources.files import extract_paths

    part = table(spark, sf_dir, "part")
    text = part.select(F.concat(F.lit('see "'), "p_name", F.lit('.INP", and '), "p_brand", F.lit("/net.inp; none")).alias("text"))
    return extract_paths(text, "text", part.where("p_size % 2 = 0").select(F.concat("p_brand", F.lit("/net.inp")).alias("path")))


@query("p5_hash_split", f"WITH {RECORDS} SELECT CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT scenario_id) AS scenarios FROM (SELECT *, {HASH(chr(39) + 'split' + chr(39) + ', CAST(scenario_id AS VARCHAR)')} AS u FROM records) q GROUP BY 1")
def p5(spark, sf_dir):
    return J.hash_split(records(spark, sf_dir), "scenario_id", {"train": 0.6, "validation": 0.2, "test": 0.2}).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_id").alias("scenarios"))


@query("p6_restrict_normals", f"WITH {RECORDS} SELECT event_id FROM records WHERE scenario_kind <> 'baseline' OR scenario_id % 3 = 0")
def p6(spark, sf_dir):
    df = records(spark, sf_dir)
    return J.restrict_normals(df, df.where("scenario_id % 3 = 0").select("scenario_id")).select("event_id")


@query("p7_disturbance_slice", f"WITH {RECORDS} SELECT event_id FROM records WHERE scenario_kind IN ('pump_outage', 'baseline')")
def p7(spark, sf_dir):
    return J.disturbance_slice(records(spark, sf_dir), "pump_outage").select("event_id")


@query("p8_filter_coverage", f"WITH {RECORDS} SELECT event_id FROM records WHERE round(sensor_coverage, 2) = 0.25")
def p8(spark, sf_dir):
    return J.filter_coverage(records(spark, sf_dir), 0.251).select("event_id")


@query("p9_filter_streams", f"WITH {RECORDS}, st AS (SELECT seed, network_id, scenario_id, sensor_coverage, min(scenario_kind) AS kind, count(*) AS steps FROM records GROUP BY ALL) SELECT scenario_id, seed, kind, steps FROM st WHERE sensor_coverage IN (0.25) AND kind IN ('leak', 'baseline') AND steps >= 5")
def p9(spark, sf_dir):
    index = records(spark, sf_dir).groupBy(*STREAM).agg(F.min("scenario_kind").alias("kind"), F.count(F.lit(1)).alias("steps"))
    return J.filter_streams(index, [0.25], ["leak"], 5).select("scenario_id", "seed", "kind", "steps")


@query("p10_empty_split_status", f"WITH {RECORDS}, c AS (SELECT count(*) FILTER (seed = 42) AS n_train, count(*) FILTER (seed = 99) AS n_test FROM records) SELECT *, CASE WHEN n_train = 0 THEN 'empty_train' WHEN n_test = 0 THEN 'empty_test' ELSE 'ok' END AS status FROM c")
def p10(spark, sf_dir):
    df = records(spark, sf_dir)
    return J.empty_split_status(df.where("seed = 42"), df.where("seed = 99"))


@query("p13_p14_relabel_tags", "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS status, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'now' WHEN contains(lower(o_orderpriority), 'high') THEN 'soon' ELSE 'later' END AS tag, count(*) AS n FROM orders GROUP BY ALL")
def p13(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(J.relabel("o_orderstatus", {"O": "open", "F": "final"}).alias("status"), J.infer_tags(F.col("o_orderpriority"), [("urgent", "now"), ("high", "soon")], "later").alias("tag"))
    return o.groupBy("status", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("p15_staleness", "SELECT c_custkey AS key, CASE WHEN max(CASE WHEN o_orderkey IS NULL THEN 1 WHEN o_orderdate < DATE '1995-01-01' THEN 2 ELSE 0 END) = 2 THEN 'STALE' WHEN max(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) = 1 THEN 'MISSING' ELSE 'CURRENT' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def p15(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("mtime"))
    bounds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("1995-01-01").cast("date").alias("bound"))
    return J.staleness(files, bounds, "key")


@query("j1_resolve_splits", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j1(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("id"))
    return J.resolve_splits(n, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), "r_name"), "id").select("n_nationkey", "n_name", "r_name")


@query("j2_select_entries", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def j2(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return J.select_entries(table(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey")


SPECS = "specs AS (SELECT scenario_id, min(scenario_kind) AS kind, min(time_seconds) + 86400 AS a, min(time_seconds) + 864000 AS b FROM records GROUP BY scenario_id)"


@query("j3_label_events", f"WITH {RECORDS}, {SPECS} SELECT event_id, CASE WHEN kind = 'leak' THEN CASE WHEN time_seconds >= a AND time_seconds <= b THEN 1 ELSE 0 END WHEN kind = 'baseline' THEN 0 ELSE 1 END AS label FROM records JOIN specs USING (scenario_id)")
def j3(spark, sf_dir):
    df = records(spark, sf_dir)
    specs = df.groupBy("scenario_id").agg(F.min("scenario_kind").alias("scenario_kind"), (F.min("time_seconds") + 86400).alias("start_time"), (F.min("time_seconds") + 864000).alias("end_time"))
    return J.label_events(df, specs).select("event_id", "label")


@query("j5_threshold_join", f"WITH {RECORDS}, t AS (SELECT network_id, avg(score__a) AS t FROM records WHERE scenario_kind = 'baseline' GROUP BY network_id) SELECT network_id, count(*) FILTER (score__a >= t) AS n FROM records JOIN t USING (network_id) GROUP BY network_id")
def j5(spark, sf_dir):
    df = records(spark, sf_dir)
    t = df.where("scenario_kind = 'baseline'").groupBy("network_id").agg(F.avg("score__a").alias("t"))
    return df.join(F.broadcast(t), "network_id").groupBy("network_id").agg(F.count_if(F.col("score__a") >= F.col("t")).alias("n"))


@query("j6_score_parity", f"WITH {RECORDS}, a AS (SELECT * FROM records WHERE event_id % 7 <> 0), b AS (SELECT event_id, score__a + 0.001 AS score__a FROM records WHERE event_id % 5 <> 0), j AS (SELECT a.event_id AS l, b.event_id AS r, abs(a.score__a - b.score__a) AS d FROM a FULL JOIN b USING (event_id)), s AS (SELECT count(*) FILTER (r IS NULL) AS only_a, count(*) FILTER (l IS NULL) AS only_b, max(d) AS m FROM j) SELECT only_a, only_b, {r('m')} AS max_difference, CASE WHEN only_a = 0 AND only_b = 0 AND m <= 0.01 THEN 1 ELSE 0 END AS equal FROM s")
def j6(spark, sf_dir):
    df = records(spark, sf_dir)
    return J.score_parity(df.where("event_id % 7 <> 0"), df.where("event_id % 5 <> 0").withColumn("score__a", F.col("score__a") + 0.001), ["event_id"], ["score__a"], 0.01)


RANGES = "ro AS (SELECT l_orderkey AS id, CONCAT('k', CAST(l_orderkey % 1000 AS VARCHAR)) AS key, min(CAST(l_quantity AS DOUBLE)) AS lo, max(CAST(l_quantity AS DOUBLE)) AS hi FROM lineitem GROUP BY l_orderkey), si AS (SELECT CONCAT('k', CAST(p_partkey % 1000 AS VARCHAR)) AS key, CAST(p_size AS DOUBLE) AS lo, CAST(p_size AS DOUBLE) + 1 AS hi FROM part)"


def _ranges(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(q).alias("lo"), F.max(q).alias("hi")).withColumn("key", F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
    size = F.col("p_size").cast("double")
    return rows, table(spark, sf_dir, "part").select(F.concat(F.lit("k"), (F.col("p_partkey") % 1000).cast("string")).alias("key"), size.alias("lo"), (size + 1).alias("hi"))


@query("j7_interval_overlap", f"WITH {RANGES} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM si WHERE si.key = ro.key AND si.lo * 0.95 <= ro.hi AND si.hi * 1.05 >= ro.lo) THEN 1 ELSE 0 END AS feasible FROM ro")
def j7(spark, sf_dir):
    return J.interval_overlap(*_ranges(spark, sf_dir), "key", "id")


@query("j8_feasibility_rate", f"WITH {RANGES}, sa AS (SELECT * FROM ro ORDER BY {HASH(chr(39) + 'feas' + chr(39) + ', CAST(id AS VARCHAR)')}, id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM ro)) SELECT {r('avg(CASE WHEN EXISTS (SELECT 1 FROM si WHERE si.key = sa.key AND si.lo * 0.95 <= sa.hi AND si.hi * 1.05 >= sa.lo) THEN 1.0 ELSE 0.0 END)')} AS rate, count(*) AS n FROM sa")
def j8(spark, sf_dir):
    return J.feasibility_rate(*_ranges(spark, sf_dir), "key", "id", 0.2, "feas")


@query("o1_top_k_nodes", f"SELECT c_nationkey, c_custkey, {r('c_acctbal')} AS demand FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WHERE c_acctbal > 0) WHERE k <= 5")
def o1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return J.top_k(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double").alias("demand"))


PRESS = "pr AS (SELECT CONCAT('net', CAST(l_suppkey % 4 AS VARCHAR)) AS network_id, l_suppkey AS pipe_id, max(abs(CAST(l_quantity AS DOUBLE))) AS n, max(abs(CAST(l_extendedprice AS DOUBLE) / 700)) AS c FROM lineitem GROUP BY ALL), ok AS (SELECT network_id, pipe_id FROM pr WHERE c <= greatest(3 * n, 100.0))"


def _screened(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("net"), (F.col("l_suppkey") % 4).cast("string")).alias("network_id"), F.col("l_suppkey").alias("pipe_id"), F.col("l_quantity").cast("double").alias("normal"), (F.col("l_extendedprice").cast("double") / 700).alias("closed"))
    return J.closure_screen(p, ["network_id", "pipe_id"])


@query("o4_closure_screen", f"WITH {PRESS} SELECT * FROM ok")
def o4(spark, sf_dir):
    return _screened(spark, sf_dir)


@query("o2_top_k_pipes", f"WITH {PRESS} SELECT network_id, pipe_id FROM (SELECT ok.*, row_number() OVER (PARTITION BY network_id ORDER BY s_acctbal DESC, pipe_id) AS k FROM ok JOIN supplier ON s_suppkey = pipe_id) WHERE k <= 3")
def o2(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pipe_id"), "s_acctbal")
    return J.top_k(_screened(spark, sf_dir).join(s, "pipe_id"), ["network_id"], [F.desc("s_acctbal"), F.col("pipe_id")], 3).select("network_id", "pipe_id")


@query("o3_first_k_pumps", f"WITH {PRESS} SELECT network_id, pipe_id FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY pipe_id) AS k FROM ok) WHERE k <= 3")
def o3(spark, sf_dir):
    return J.top_k(_screened(spark, sf_dir), ["network_id"], [F.col("pipe_id")], 3)


@query("o5_stream_order", f"WITH {RECORDS} SELECT seed, network_id, scenario_id, sensor_coverage, event_id, row_number() OVER (PARTITION BY seed, network_id, scenario_id, sensor_coverage ORDER BY time_seconds, event_id) AS place FROM records")
def o5(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(*STREAM).orderBy("time_seconds", "event_id")
    return records(spark, sf_dir).select(*STREAM, "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("o7_union_frames", f"SELECT s_suppkey AS key, {r('s_acctbal')} AS acctbal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, {r('c_acctbal')}, c_mktsegment FROM customer")
def o7(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").cast("double").alias("acctbal"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return J.union_frames([s, c])


@query("o8_union_labelled_sources", f"SELECT CAST(c_nationkey AS DOUBLE) AS nationkey, {r('c_acctbal')} AS acctbal, 'customer' AS origin FROM customer UNION ALL SELECT CAST(s_nationkey AS DOUBLE), {r('s_acctbal')}, 'supplier' FROM supplier")
def o8(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c = c.select("c_nationkey", "c_acctbal", "c_name").toDF("nationkey", "acctbal", "name")
    s = s.select("s_nationkey", "s_acctbal", "s_name").toDF("nationkey", "acctbal", "name")
    return J.union_labelled_sources(c, s, "customer", "supplier")


@query("o9_time_ordered_holdout", f"WITH {RECORDS}, nb AS (SELECT event_id, row_number() OVER (ORDER BY time_seconds, event_id) AS k, count(*) OVER () AS n FROM records WHERE scenario_kind = 'baseline') SELECT event_id, CASE WHEN k <= greatest(1, floor(n * 0.7)) THEN 'train' ELSE 'evaluate' END AS part FROM records LEFT JOIN nb USING (event_id)")
def o9(spark, sf_dir):
    return J.time_ordered_holdout(records(spark, sf_dir), 0.7, ["time_seconds", "event_id"]).select("event_id", "part")


@query("o10_distinct_first_scenario", f"WITH {RECORDS} SELECT scenario_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY time_seconds, event_id) AS k FROM records) WHERE k = 1")
def o10(spark, sf_dir):
    return J.top_k(records(spark, sf_dir), ["scenario_id"], [F.col("time_seconds"), F.col("event_id")], 1).select("scenario_id", "event_id")


@query("o11_scenario_catalog", """WITH n AS (SELECT CONCAT('net', CAST(c_nationkey % 4 AS VARCHAR)) AS network_id, CONCAT('J', CAST(c_custkey AS VARCHAR)) AS node_id, CAST(c_acctbal AS DOUBLE) AS d FROM customer), p AS (SELECT CONCAT('net', CAST(s_nationkey % 4 AS VARCHAR)) AS network_id, CONCAT('P', CAST(s_suppkey AS VARCHAR)) AS pipe_id, CAST(s_acctbal AS DOUBLE) AS d FROM supplier),
 u AS (SELECT CONCAT('net', CAST(n_nationkey % 4 AS VARCHAR)) AS network_id, CONCAT('U', CAST(n_nationkey AS VARCHAR)) AS pump_id FROM nation), tn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY d DESC, node_id) AS k FROM n WHERE d > 0) WHERE k <= 5), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY d DESC, pipe_id) AS k FROM p) WHERE k <= 3), tu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY pump_id) AS k FROM u) WHERE k <= 3),
 c AS (SELECT network_id, 'baseline' AS kind, '' AS target, 0.0::DOUBLE AS area FROM (SELECT network_id FROM n UNION SELECT network_id FROM p UNION SELECT network_id FROM u) UNION ALL SELECT network_id, 'leak', node_id, a FROM tn, (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) t(a) UNION ALL SELECT network_id, 'pipe_closure', pipe_id, 0.0 FROM tp UNION ALL SELECT network_id, 'pump_outage', pump_id, 0.0 FROM tu UNION ALL SELECT network_id, 'demand_surge', node_id, 0.0 FROM tn WHERE k = 1 UNION ALL SELECT network_id, 'partial_valve_closure', pipe_id, 0.0 FROM tp WHERE k = 1)
 SELECT *, concat_ws('__', network_id, kind, nullif(target, ''), CASE WHEN area > 0 THEN printf('%.4f', area) END) AS scenario_id FROM c""")
def o11(spark, sf_dir):
    net = lambda c: F.concat(F.lit("net"), (F.col(c) % 4).cast("string")).alias("network_id")
    nodes = table(spark, sf_dir, "customer").select(net("c_nationkey"), F.concat(F.lit("J"), "c_custkey").alias("node_id"), F.col("c_acctbal").cast("double").alias("base_demand"))
    pipes = table(spark, sf_dir, "supplier").select(net("s_nationkey"), F.concat(F.lit("P"), "s_suppkey").alias("pipe_id"), F.col("s_acctbal").cast("double").alias("diameter"))
    pumps = table(spark, sf_dir, "nation").select(net("n_nationkey"), F.concat(F.lit("U"), "n_nationkey").alias("pump_id"))
    return J.scenario_catalog(nodes, pipes, pumps, [0.01, 0.05])


NET_CRC = " ".join(f"WHEN 'net{i}' THEN {zlib.crc32(b'net' + str(i).encode())}" for i in range(4))


@query("o12_normal_catalog", f"WITH {RECORDS} SELECT network_id, concat(network_id, '__normal__', lpad(CAST(j AS VARCHAR), 4, '0')) AS scenario_id, (42 * 1000003 + CASE network_id {NET_CRC} END) % 2147483647 + 100000 + j AS demand_seed FROM (SELECT DISTINCT network_id FROM records), range(20) t(j)")
def o12(spark, sf_dir):
    return J.normal_catalog(records(spark, sf_dir).select("network_id"), 20, 42)


SENSORS = "sn AS (SELECT CONCAT('net', CAST(c_nationkey % 4 AS VARCHAR)) AS network_id, c_custkey AS sensor_id FROM customer)"


def _sensors(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("net"), (F.col("c_nationkey") % 4).cast("string")).alias("network_id"), F.col("c_custkey").alias("sensor_id"))


@query("g1_place_sensors", f"WITH {SENSORS}, k AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY md5(concat_ws('|', '42', network_id, '0.25', CAST(sensor_id AS VARCHAR)))) AS k, count(*) OVER (PARTITION BY network_id) AS n FROM sn) SELECT network_id, sensor_id FROM k WHERE k <= greatest(1, ceil(n * 0.25))")
def g1(spark, sf_dir):
    return G.place_sensors(_sensors(spark, sf_dir), 0.25, 42)


@query("g2_place_sensors_stride", f"WITH {SENSORS}, k AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY sensor_id) - 1 AS k, count(*) OVER (PARTITION BY network_id) AS n FROM sn), c AS (SELECT *, greatest(1, CAST(ceil(n * 0.25) AS BIGINT)) AS c FROM k), s AS (SELECT *, greatest(1, n // c) AS s FROM c) SELECT network_id, sensor_id FROM s WHERE k % s = 0 AND k // s < c")
def g2(spark, sf_dir):
    return G.place_sensors_stride(_sensors(spark, sf_dir), 0.25)


@query("g3_halves", f"WITH {RECORDS}, i AS (SELECT DISTINCT network_id, scenario_id FROM records WHERE scenario_kind = 'baseline'), k AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY md5(concat_ws('|', '42', CAST(scenario_id AS VARCHAR))), scenario_id) AS k, count(*) OVER (PARTITION BY network_id) AS n FROM i) SELECT network_id, scenario_id, CASE WHEN k <= n // 2 THEN 0 ELSE 1 END AS half FROM k")
def g3(spark, sf_dir):
    return G.halves(records(spark, sf_dir), 42)


@query("g4_split_calibration", f"""WITH {RECORDS}, i AS (SELECT DISTINCT network_id, scenario_id FROM records WHERE scenario_kind = 'baseline'), k AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY md5(concat_ws('|', '42', CAST(scenario_id AS VARCHAR))), scenario_id) AS k, count(*) OVER (PARTITION BY network_id) AS n FROM i), hf AS (SELECT network_id, scenario_id, CASE WHEN k <= n // 2 THEN 0 ELSE 1 END AS half FROM k),
 rf AS (SELECT fold, network_id, avg(mass_residual) AS m, stddev_pop(mass_residual) AS s FROM records JOIN hf USING (network_id, scenario_id), (VALUES (0), (1)) f(fold) WHERE half = fold GROUP BY fold, network_id),
 ev AS (SELECT fold, r.network_id, event_label, CASE WHEN s > 0 THEN (mass_residual - m) / s ELSE 0 END AS score FROM records r LEFT JOIN hf USING (network_id, scenario_id) JOIN rf ON rf.network_id = r.network_id WHERE scenario_kind <> 'baseline' OR half <> fold) SELECT fold, network_id, count(*) AS n, {r('avg(score)')} AS mean_z, {r('avg(event_label)')} AS prior FROM ev GROUP BY fold, network_id""")
def g4(spark, sf_dir):
    ev = G.split_calibration(records(spark, sf_dir), 42, ["mass_residual"])
    return ev.groupBy("fold", "network_id").agg(F.count(F.lit(1)).alias("n"), F.avg("z__mass_residual").alias("mean_z"), F.avg(F.col("event_label").cast("double")).alias("prior"))


SPLIT = f"""WITH {RECORDS}, i AS (SELECT DISTINCT network_id, scenario_id FROM records WHERE scenario_kind = 'baseline'), k AS (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY md5(concat_ws('|', '42', CAST(scenario_id AS VARCHAR))), scenario_id) AS k, count(*) OVER (PARTITION BY network_id) AS n FROM i), hf AS (SELECT network_id, scenario_id, CASE WHEN k <= n // 2 THEN 0 ELSE 1 END AS half FROM k),
 rf AS (SELECT fold, network_id, avg(mass_residual) AS m, stddev_pop(mass_residual) AS s FROM records JOIN hf USING (network_id, scenario_id), (VALUES (0), (1)) f(fold) WHERE half = fold GROUP BY fold, network_id),
 af AS (SELECT network_id, avg(mass_residual) AS m, stddev_pop(mass_residual) AS s FROM records WHERE scenario_kind = 'baseline' GROUP BY network_id),
 ev AS (SELECT rf.fold, r.network_id, r.event_label, CASE WHEN rf.s > 0 THEN (mass_residual - rf.m) / rf.s ELSE 0 END AS x, CASE WHEN af.s > 0 THEN (mass_residual - af.m) / af.s ELSE 0 END AS y FROM records r LEFT JOIN hf USING (network_id, scenario_id) JOIN rf ON rf.network_id = r.network_id JOIN af ON af.network_id = r.network_id WHERE scenario_kind <> 'baseline' OR half <> fold),
 tg AS (SELECT fold, network_id, event_label, 'split' AS tag, x AS score FROM ev UNION ALL SELECT fold, network_id, event_label, 'full', y FROM ev), {ap_sql('m', 'tg', 'network_id, fold, tag')},
 d AS (SELECT network_id, avg(ap) FILTER (tag = 'full') AS f, avg(ap) FILTER (tag = 'split') AS s FROM m GROUP BY network_id)"""


@query("g4_split_difference", SPLIT + f" SELECT network_id, {r('f')} AS full, {r('s')} AS split, {r('s - f')} AS difference, {r('avg(s - f) OVER ()')} AS mean_difference, {r('max(abs(s - f)) OVER ()')} AS max_difference FROM d".replace(" AS full", ' AS "full"'))
def g4_difference(spark, sf_dir):
    return K.split_difference(K.split_metrics(K.split_scores(records(spark, sf_dir), 42, "mass_residual"), STREAM))


@query("g4_split_metrics")
def g4_metrics(spark, sf_dir):
    return K.split_metrics(K.split_scores(records(spark, sf_dir), 42, "mass_residual"), STREAM)


BOUNDS = STEPS + """, q AS (SELECT quantile_cont(pressure_mean, 0.01) AS a1, quantile_cont(pressure_mean, 0.99) AS b1, quantile_cont(demand_mean, 0.01) AS a2, quantile_cont(demand_mean, 0.99) AS b2 FROM steps WHERE event_label = 1)"""


@query("g9_fit_quantile_screen", f"WITH {BOUNDS} SELECT 'pressure_mean' AS feature, {r('a1 - 0.1 * (b1 - a1)')} AS lo, {r('b1 + 0.1 * (b1 - a1)')} AS hi, CASE WHEN b1 - a1 > 1e-9 THEN 1 ELSE 0 END AS screened FROM q UNION ALL SELECT 'demand_mean', {r('a2 - 0.1 * (b2 - a2)')}, {r('b2 + 0.1 * (b2 - a2)')}, CASE WHEN b2 - a2 > 1e-9 THEN 1 ELSE 0 END FROM q")
def g9(spark, sf_dir):
    return G.fit_quantile_screen(steps(spark, sf_dir).where("event_label = 1"), ["pressure_mean", "demand_mean"])


@query("g10_apply_quantile_screen", f"WITH {BOUNDS} SELECT source, count(*) AS kept FROM steps, q WHERE pressure_mean BETWEEN a1 - 0.1 * (b1 - a1) AND b1 + 0.1 * (b1 - a1) AND demand_mean BETWEEN a2 - 0.1 * (b2 - a2) AND b2 + 0.1 * (b2 - a2) GROUP BY source")
def g10(spark, sf_dir):
    df, names = steps(spark, sf_dir), ["pressure_mean", "demand_mean"]
    return G.apply_quantile_screen(df, G.fit_quantile_screen(df.where("event_label = 1"), names), names).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query("g5_noise_augment")
def g5(spark, sf_dir):
    return G.noise_augment(steps(spark, sf_dir), ["pressure_mean", "demand_mean"], 2).groupBy("event_label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"), F.avg("pressure_mean").alias("pressure_mean"))


@query("g6_gmm_augment")
def g6(spark, sf_dir):
    return G.gmm_augment(steps(spark, sf_dir), ["pressure_mean", "demand_mean"], 2, 1000).groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("g7_smote_augment")
def g7(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return G.smote_augment(_points(e), "vec", 5).groupBy("event_label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("g8_adasyn_augment")
def g8(spark, sf_dir):
    return G.adasyn_augment(_points(table(spark, sf_dir, "embeddings")), "vec", 5).groupBy("event_label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


def _points(e):
    """Points with a rare label from the embeddings."""
    key, vec = e.columns[0], next(c for c, t in e.dtypes if t.startswith("array"))
    label = next((c for c in e.columns if c == "label"), None)
    y = (F.col(label) % 4 == 0).cast("int") if label else (F.col(key) % 4 == 0).cast("int")
    return e.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"), y.alias("event_label"))


@query("f13_net_seed", f"WITH {RECORDS} SELECT event_id, (CAST(seed AS BIGINT) * 1000003 + CASE network_id {NET_CRC} END + event_id) % 2147483647 AS net_seed FROM records")
def f13(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", net_seed(F.col("seed"), F.col("network_id"), F.col("event_id")).alias("net_seed"))


@query("g11_augment")
def g11(spark, sf_dir):
    names, out = ["pressure_mean", "demand_mean"], None
    for arm in ("none", "noise", "gmm"):
        one = G.augment(steps(spark, sf_dir), arm, names).select(F.lit(arm).alias("arm"), "event_label", "is_synthetic", *names)
        out = one if out is None else out.unionByName(one)
    return out


def _magnitudes(spark, sf_dir):
    return steps(spark, sf_dir).withColumn("u", unit_hash(F.lit("m"), F.col("scenario_id").cast("string")))


@query("g12_sensitivity_grid", f"WITH {STEPS}, g AS (SELECT c, co, steps.* FROM steps, (VALUES (10.0), (30.0)) a(c), (VALUES (0.25), (0.5)) b(co) WHERE pressure_mean <= c AND sensor_coverage = co) SELECT CAST(c AS DOUBLE) AS most, CAST(co AS DOUBLE) AS coverage, count(*) AS n, {r('avg(event_label)')} AS prior FROM g GROUP BY 1, 2")
def g12(spark, sf_dir):
    configs = [{"most": m, "coverage": c} for m in (10.0, 30.0) for c in (0.25, 0.5)]
    grid = G.sensitivity_grid(steps(spark, sf_dir), configs, lambda c: (F.col("pressure_mean") <= c["most"]) & (F.col("sensor_coverage") == c["coverage"]))
    return grid.groupBy("most", "coverage").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("event_label").cast("double")).alias("prior"))

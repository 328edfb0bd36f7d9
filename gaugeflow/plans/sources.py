"""Readers and writers, schema guards and streaming twins: each query writes what it derives from a given table to the
shared folder, or streams a given table, and reads the outcome back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators import joins as J
from gaugeflow.operators import metrics as M
from gaugeflow.plans.metrics import ap_sql
from gaugeflow.plans.registry import query, r
from gaugeflow.sources import files
from gaugeflow.sources.adapters import LONG, READINGS, RECORDS, STEPS, arm_records, records, steps, table
from gaugeflow.sources.shared import shared_folder
from gaugeflow.streaming import causal, ordered


@query("s1_s2_records_round_trip", f"WITH {RECORDS} SELECT event_id, seed, network_id, {r('score__a')} AS score__a FROM records")
def s1(spark, sf_dir):
    path = shared_folder(spark, "records")
    files.write_records(records(spark, sf_dir), path)
    return files.read_records(spark, path, ["event_id", "seed", "network_id", "score__a"])


@query("s4_s5_csv_round_trip", f"WITH {LONG} SELECT event_id, network_id, arm, {r('score')} AS score FROM long WHERE arm = 'b' AND network_id IN ('net0', 'net2')")
def s4(spark, sf_dir):
    path = shared_folder(spark, "csv")
    files.write_csv_gz(arm_records(records(spark, sf_dir)).select("event_id", "network_id", "arm", "score"), path)
    return files.read_csv_records(spark, path, "event_id long, network_id string, arm string, score double", ["b"], ["net0", "net2"])


@query("s6_s7_nested_results", f"WITH {LONG}, {ap_sql('m', 'long', 'seed, network_id, arm')} SELECT seed, arm, network_id AS network, metric, {r('value')} AS value FROM (SELECT seed, network_id, arm, 'ap' AS metric, ap AS value FROM m UNION ALL SELECT seed, network_id, arm, 'auc', auc FROM m UNION ALL SELECT seed, network_id, arm, 'rows', n FROM m) WHERE value IS NOT NULL")
def s6(spark, sf_dir):
    found = M.ranking_metrics(arm_records(records(spark, sf_dir)), ["seed", "network_id", "arm"])
    of_network = F.map_from_arrays(F.array(*map(F.lit, ("ap", "auc", "rows"))), F.array("ap", "auc", "n"))
    arms = found.groupBy("seed", "arm").agg(F.map_from_entries(F.collect_list(F.struct("network_id", of_network))).alias("m"))
    runs = arms.groupBy("seed").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("arm", "m")))).alias("value"))
    path = shared_folder(spark, "results")
    runs.write.partitionBy("seed").text(path)
    flat = files.flatten_results(files.read_results_json(spark, path), ["arm", "network", "metric"])
    return flat.select(F.regexp_extract("file", r"seed=(\d+)", 1).cast("int").alias("seed"), "arm", "network", "metric", "value")


#: Sectioned files, one per nation: customers as junctions in two sections, suppliers as pipes, and options of which one is set twice.
PLACES = """places AS (SELECT c_nationkey AS nation, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END AS part, c_custkey AS k, 'JUNCTIONS' AS section, concat('J', CAST(c_custkey AS VARCHAR), ' ', c_mktsegment) AS line FROM customer
 UNION ALL SELECT s_nationkey, 2, s_suppkey, 'PIPES', concat('P', CAST(s_suppkey AS VARCHAR)) FROM supplier
 UNION ALL SELECT n_nationkey, 4, i, 'OPTIONS', CASE i WHEN 1 THEN 'Units GPM' WHEN 2 THEN 'Headloss Model H-W' WHEN 3 THEN concat('units R', CAST(n_regionkey AS VARCHAR)) ELSE 'Headloss D-W' END FROM nation, (VALUES (1), (2), (3), (4)) t(i))"""


def _section_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Writes a file per nation; the folder, and (nation, value) as written."""
    row = lambda nation, part, k, line: (nation.alias("nation"), part.cast("int").alias("part"), k.cast("long").alias("k"), line.alias("line"))
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    options = F.array(F.lit("Units GPM ; first"), F.lit("Headloss Model H-W"), F.concat(F.lit("units R"), "n_regionkey"), F.lit("  Headloss D-W  "))
    lines = c.select(*row(F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(3), F.col("c_custkey"), F.concat(F.lit(" J"), "c_custkey", F.lit(" "), "c_mktsegment", F.lit(" ; customer"))))
    lines = lines.union(s.select(*row(F.col("s_nationkey"), F.lit(2), F.col("s_suppkey"), F.concat(F.lit("P"), "s_suppkey", F.lit("\n\n;nothing")))))
    lines = lines.union(n.select("n_nationkey", F.posexplode(options).alias("i", "line")).select(*row(F.col("n_nationkey"), F.lit(4), F.col("i"), F.col("line"))))
    lines = lines.union(n.select(*row(F.col("n_nationkey"), F.lit(0), F.lit(0), F.lit("lost before the first header"))))
    heads = F.element_at(F.array(*map(F.lit, ("[junctions]", "[Pipes]", "[JUNCTIONS] ; more", "[OPTIONS]"))), F.greatest("part", F.lit(1)))
    parts = lines.groupBy("nation", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = parts.withColumn("body", F.when(F.col("part") == 0, F.col("body")).otherwise(F.concat(heads, F.lit("\n"), "body")))
    texts = parts.groupBy("nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda x: x["body"]), "\n").alias("value"))
    path = shared_folder(spark, "sections")
    texts.write.partitionBy("nation").text(path)
    return path, texts


def _nation(column: str):
    return F.regexp_extract(column, r"nation=(\d+)", 1).cast("int").alias("nation")


@query("s8_section_lines", f"WITH {PLACES} SELECT CAST(nation AS INT) AS nation, section, line FROM places")
def s8(spark, sf_dir):
    return files.section_lines(spark, _section_files(spark, sf_dir)[0]).select(_nation("file"), "section", "line")


@query("s9_section_options", "SELECT CAST(n_nationkey AS INT) AS nation, key, value FROM (SELECT n_nationkey, 'UNITS' AS key, concat('R', CAST(n_regionkey AS VARCHAR)) AS value FROM nation UNION ALL SELECT n_nationkey, 'HEADLOSS MODEL', 'H-W' FROM nation UNION ALL SELECT n_nationkey, 'HEADLOSS', 'D-W' FROM nation)")
def s9(spark, sf_dir):
    found = files.section_options(files.section_lines(spark, _section_files(spark, sf_dir)[0]))
    return found.select(_nation("file"), "key", "value")


@query("s10_section_inventory", f"WITH {PLACES} SELECT CAST(nation AS INT) AS nation, string_agg(DISTINCT section, ',' ORDER BY section) AS sections, count(*) FILTER (section = 'JUNCTIONS') AS junctions, count(*) FILTER (section = 'PIPES') AS pipes, max(CASE WHEN line LIKE 'units R%' THEN substr(line, 7) END) AS units, 'D-W' AS headloss FROM places GROUP BY nation")
def s10(spark, sf_dir):
    found = files.section_inventory(files.section_lines(spark, _section_files(spark, sf_dir)[0]))
    return found.select(_nation("file"), F.array_join("sections", ",").alias("sections"), "junctions", "pipes", "units", "headloss")


@query("s11_discover_files", f"WITH {PLACES} SELECT CAST(nation AS INT) AS nation, 1::BIGINT AS n FROM places GROUP BY nation")
def s11(spark, sf_dir):
    found = files.discover_files(spark, _section_files(spark, sf_dir)[0], ["*.txt", "part-*"])
    return found.groupBy(_nation("path")).agg(F.count(F.lit(1)).alias("n"))


@query("s13_file_provenance", """WITH f AS (SELECT c_nationkey AS nation, string_agg(concat(CAST(c_custkey AS VARCHAR), ' ', c_name), chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY c_nationkey)
 SELECT CAST(nation AS INT) AS nation, sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS size FROM f""")
def s13(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.struct("c_custkey", F.concat_ws(" ", "c_custkey", "c_name").alias("line")).alias("x"))
    texts = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("value"))
    path = shared_folder(spark, "artifacts")
    texts.write.partitionBy("nation").text(path)
    return files.file_provenance(spark, path, "*.txt").select(_nation("path"), "sha256", "size")


FEATURE_NAMES = ["pressure_mean", "pressure_max", "pressure_min", "pressure_std", "demand_mean", "demand_sum", "flow_mean", "flow_abs_mean", "flow_std", "observed_count"]


@query("p1_select_numeric_features", f"WITH {STEPS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean FROM steps" for c in FEATURE_NAMES))
def p1(spark, sf_dir):
    df = steps(spark, sf_dir)
    names = J.select_numeric_features(df, "event_label", ["scenario_id", "time_seconds", "sensor_coverage"])
    means = df.agg(*[F.avg(c).alias(c) for c in names])
    return means.unpivot([], names, "feature", "mean")


#: Columns of the records, and which of them the guard lets through as features.
GUARDED = {"seed": 1, "network_id": 1, "scenario_id": 0, "scenario_kind": 0, "sensor_coverage": 1, "time_seconds": 1, "event_id": 1, "event_label": 0, "score__a": 1, "score__b": 1, "mass_residual": 1, "energy_residual": 1}


@query("p3_guard_no_metadata", f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {ok} AS allowed, count({c}) AS n FROM records" for c, ok in GUARDED.items()))
def p3(spark, sf_dir):
    df = records(spark, sf_dir)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "feature", "n")
    return counts.select("feature", F.col("feature").isin(_allowed(df.columns)).cast("int").alias("allowed"), "n")


def _allowed(columns: list[str]) -> list[str]:
    out = []
    for c in columns:
        try:
            out += J.guard_no_metadata([c])
        except ValueError:
            pass
    return out


@query("p4_validate_schema", "SELECT t.*, (SELECT count(*) FROM lineitem) AS n FROM (VALUES ('ok', ''), ('missing', 'missing: flow_max'), ('twice', 'a feature is named twice'), ('target', 'the target is a feature')) t(test, error)")
def p4(spark, sf_dir):
    df = steps(spark, sf_dir)
    tests = {"ok": (["pressure_mean"], ["flow_mean"]), "missing": (["pressure_mean", "flow_max"], []), "twice": (["pressure_mean"], ["pressure_mean"]), "target": (["event_label"], [])}
    errors = []
    for name, (required, optional) in tests.items():
        try:
            J.validate_schema(df, required, optional, "event_label")
            errors.append((name, ""))
        except ValueError as e:
            errors.append((name, str(e)))
    found = F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.lit(e).alias("error")) for n, e in errors]))
    return df.agg(F.count(F.lit(1)).alias("n")).select(found.alias("x"), "n").select("x.*", "n")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of events: a folder's, or the one file of that name (streams are read from folders)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _streamed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """What the stream has put out once all files that are there were read."""
    path = shared_folder(spark, name)
    run = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("r1_stream_sensor_aggregates", f"WITH {READINGS}, done AS (SELECT max(epoch(ts)) - 3600 AS t FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')) SELECT network_id, time_seconds, {r('coalesce(avg(CASE WHEN channel = ' + chr(39) + 'pressure' + chr(39) + ' THEN value END), 0)')} AS pressure_mean, {r('coalesce(sum(CASE WHEN channel = ' + chr(39) + 'demand' + chr(39) + ' THEN value END), 0)')} AS demand_sum FROM readings, done WHERE time_seconds + 21600 <= t GROUP BY network_id, time_seconds")
def r1(spark, sf_dir):
    e = _events_stream(spark, sf_dir)
    channel = F.when(F.col("event_type") == "view", "pressure").when(F.col("event_type") == "click", "demand").when(F.col("event_type") == "purchase", "flow").when(F.col("event_type") == "signup", "tank_head")
    # Times are read as UTC whatever the session's time zone, as the windows count from the epoch.
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    rows = e.select(F.concat(F.lit("net"), (F.col("user_id") % 4).cast("string")).alias("network_id"), at.alias("ts"), channel.alias("channel"), "value").where("channel is not null")
    out = _streamed(spark, causal.stream_sensor_aggregates(rows), "aggregates")
    return out.select("network_id", F.unix_timestamp("window_start").cast("double").alias("time_seconds"), "pressure_mean", "demand_sum")


PAST = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id), p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("r2_stream_causal_score", f"WITH z AS (SELECT user_id, event_id, CASE WHEN row_number() OVER w <= 4 THEN 0.0 ELSE (value - avg(value) OVER p) / (stddev_pop(value) OVER p + 1e-9) END AS z FROM events {PAST}) SELECT user_id, event_id, round(avg(z) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS score FROM z")
def r2(spark, sf_dir):
    rows = _events_stream(spark, sf_dir).select("user_id", "event_id", "value")
    return _streamed(spark, causal.stream_causal_score(rows, "user_id", "event_id", "value", None), "scores").withColumn("score", F.round("score", 6) + 0.0)


@query("r3_stream_alarm_episodes", """WITH m AS (SELECT user_id, event_id, value >= 60 AS up, lag(value >= 60) OVER w AS was, lead(value >= 60) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(CASE WHEN up AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM m)
 SELECT user_id, CAST(min(event_id) AS DOUBLE) AS started, CAST(max(event_id) AS DOUBLE) AS ended FROM g WHERE up GROUP BY user_id, g HAVING bool_and(next IS NOT NULL)""")
def r3(spark, sf_dir):
    rows = _events_stream(spark, sf_dir).select("user_id", "event_id", "value")
    return _streamed(spark, causal.stream_alarm_episodes(rows, "user_id", "event_id", "value", 60.0, None), "episodes")


#: Rows that the last watermark has passed, an hour before the latest row.
ORDERED = "ev AS (SELECT user_id, event_id, value, ts FROM events WHERE ts IS NOT NULL AND value IS NOT NULL), ez AS (SELECT *, epoch_us(ts) <= (max(epoch_us(ts)) OVER () // 1000 - 3600000) * 1000 AS passed FROM ev)"


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered.use_rocksdb(spark)
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    return _events_stream(spark, sf_dir).select("user_id", "event_id", "value", at.alias("at"))


@query("r2_event_time_scores", f"WITH {ORDERED}, z AS (SELECT *, CASE WHEN row_number() OVER w <= 4 THEN 0.0 ELSE (value - avg(value) OVER p) / (stddev_pop(value) OVER p + 1e-9) END AS z FROM ez WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s AS (SELECT *, avg(z) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS score FROM z) SELECT user_id, event_id, round(score, 6) + 0.0 AS score FROM s WHERE passed")
def r2_ordered(spark, sf_dir):
    out = _streamed(spark, ordered.event_time_scores(_timed_events(spark, sf_dir), ["user_id"], "at", "event_id", "value"), "scores")
    return out.select("user_id", "event_id", (F.round("score", 6) + 0.0).alias("score"))


@query("r3_event_time_episodes", """WITH """ + ORDERED + """, m AS (SELECT user_id, ts, event_id, value >= 60 AS up, lag(value >= 60) OVER w AS was, lead(value) OVER w AS next FROM ez WHERE passed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(CASE WHEN up AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m)
 SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM g WHERE up GROUP BY user_id, g HAVING bool_and(next IS NOT NULL)""")
def r3_ordered(spark, sf_dir):
    out = _streamed(spark, ordered.event_time_episodes(_timed_events(spark, sf_dir), ["user_id"], "at", "event_id", "value", 60.0), "episodes")
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"))

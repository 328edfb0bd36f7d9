"""The driver's tables in the shapes that the operators take. Each adapter has its DuckDB twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stream: one scenario as one set of sensors saw it.
STREAM = ["seed", "network_id", "scenario_id", "sensor_coverage"]
KINDS = ["leak", "pipe_closure", "pump_outage"]
ARMS = ["a", "b"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records from `events`: one row per step of a stream."""
    e = table(spark, sf_dir, "events")
    u = F.floor(F.col("user_id") / 4).cast("long") % 10
    kind = F.when(u.isin(1, 5), "leak").when(u == 2, "pipe_closure").when(u == 3, "pump_outage").otherwise("baseline")
    k = F.get_json_object("props", "$.k").cast("double")
    day = F.dayofmonth("ts")
    return e.select(
        (42 + F.floor(F.col("event_id") / 2).cast("long") % 3).cast("int").alias("seed"),
        F.concat(F.lit("net"), (F.col("user_id") % 4).cast("string")).alias("network_id"),
        F.col("user_id").alias("scenario_id"),
        kind.alias("scenario_kind"),
        F.when(F.col("event_id") % 2 == 0, 0.25).otherwise(0.5).alias("sensor_coverage"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("time_seconds"),
        "event_id",
        F.when(kind == "baseline", 0).when((kind == "leak") & ~day.between(10, 19), 0).otherwise(1).cast("int").alias("event_label"),
        (F.col("value") / 500.0).alias("score__a"),
        (k / 100.0).alias("score__b"),
        F.col("value").alias("mass_residual"),
        k.alias("energy_residual"),
    )


RECORDS = """records AS (
  SELECT CAST(42 + CAST(floor(event_id/2) AS BIGINT) % 3 AS INT) AS seed, concat('net', CAST(user_id % 4 AS VARCHAR)) AS network_id,
    user_id AS scenario_id, scenario_kind, CASE WHEN event_id % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS sensor_coverage,
    epoch(ts) AS time_seconds, event_id,
    CAST(CASE WHEN scenario_kind = 'baseline' THEN 0 WHEN scenario_kind = 'leak' AND day(ts) NOT BETWEEN 10 AND 19 THEN 0 ELSE 1 END AS INT) AS event_label,
    value / CAST(500.0 AS DOUBLE) AS score__a, k / CAST(100.0 AS DOUBLE) AS score__b, value AS mass_residual, k AS energy_residual
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
          CASE WHEN CAST(floor(user_id/4) AS BIGINT) % 10 IN (1,5) THEN 'leak' WHEN CAST(floor(user_id/4) AS BIGINT) % 10 = 2 THEN 'pipe_closure'
               WHEN CAST(floor(user_id/4) AS BIGINT) % 10 = 3 THEN 'pump_outage' ELSE 'baseline' END AS scenario_kind FROM events))"""


def arm_records(df: DataFrame, arms: list[str] = ARMS) -> DataFrame:
    """Long form: a row per record and arm, with `arm` and `score`."""
    kept = [c for c in df.columns if not c.startswith("score__")]
    return df.unpivot(kept, [f"score__{a}" for a in arms], "arm", "score").withColumn("arm", F.substring("arm", 8, 100))


LONG = RECORDS + """, long AS (SELECT 'a' AS arm, score__a AS score, * EXCLUDE (score__a, score__b) FROM records
  UNION ALL SELECT 'b', score__b, * EXCLUDE (score__a, score__b) FROM records)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sensor readings from `events`: six-hour steps, users as sensors, event types as channels."""
    e = table(spark, sf_dir, "events")
    channel = F.when(F.col("event_type") == "view", "pressure").when(F.col("event_type") == "click", "demand").when(F.col("event_type") == "purchase", "flow").when(F.col("event_type") == "signup", "tank_head")
    step = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6 / 21600) * 21600
    return e.select(F.concat(F.lit("net"), (F.col("user_id") % 4).cast("string")).alias("network_id"), step.cast("double").alias("time_seconds"), channel.alias("channel"), F.col("user_id").alias("sensor_id"), "value").where("channel is not null")


READINGS = """readings AS (SELECT * FROM (SELECT concat('net', CAST(user_id % 4 AS VARCHAR)) AS network_id, CAST(floor(epoch(ts) / 21600) * 21600 AS DOUBLE) AS time_seconds,
  CASE event_type WHEN 'view' THEN 'pressure' WHEN 'click' THEN 'demand' WHEN 'purchase' THEN 'flow' WHEN 'signup' THEN 'tank_head' END AS channel,
  user_id AS sensor_id, value FROM events) WHERE channel IS NOT NULL)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with plain channels from `lineitem`: orders as streams, lines as steps."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat(F.lit("net"), (F.col("l_orderkey") % 4).cast("string")).alias("network_id"), F.col("l_orderkey").alias("scenario_id"), F.col("l_linenumber").cast("double").alias("time_seconds"),
        F.col("l_quantity").cast("double").alias("pressure_mean"), (F.col("l_quantity") * 2).cast("double").alias("pressure_max"), (F.col("l_quantity") / 2).cast("double").alias("pressure_min"),
        F.col("l_discount").cast("double").alias("pressure_std"), (F.col("l_extendedprice") / 1000).cast("double").alias("demand_mean"), (F.col("l_extendedprice") / 500).cast("double").alias("demand_sum"),
        (F.col("l_tax") * 10).cast("double").alias("flow_mean"), (F.col("l_tax") * 10 + 1).cast("double").alias("flow_abs_mean"), (F.col("l_tax") + 0.01).cast("double").alias("flow_std"),
        (1 + F.col("l_linenumber") % 5).cast("int").alias("observed_count"), (F.col("l_returnflag") == "R").cast("int").alias("event_label"),
        F.when(F.col("l_orderkey") % 2 == 0, 0.25).otherwise(0.5).alias("sensor_coverage"), F.col("l_returnflag").alias("source"),
    )


STEPS = """steps AS (SELECT concat('net', CAST(l_orderkey % 4 AS VARCHAR)) AS network_id, l_orderkey AS scenario_id, CAST(l_linenumber AS DOUBLE) AS time_seconds,
  CAST(l_quantity AS DOUBLE) AS pressure_mean, CAST(l_quantity * 2 AS DOUBLE) AS pressure_max, CAST(l_quantity / 2 AS DOUBLE) AS pressure_min, CAST(l_discount AS DOUBLE) AS pressure_std,
  CAST(l_extendedprice / 1000 AS DOUBLE) AS demand_mean, CAST(l_extendedprice / 500 AS DOUBLE) AS demand_sum, CAST(l_tax * 10 AS DOUBLE) AS flow_mean, CAST(l_tax * 10 + 1 AS DOUBLE) AS flow_abs_mean, CAST(l_tax + 0.01 AS DOUBLE) AS flow_std,
  CAST(1 + l_linenumber % 5 AS INT) AS observed_count, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event_label,
  CASE WHEN l_orderkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS sensor_coverage, l_returnflag AS source FROM lineitem)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network links from `lineitem`: suppliers and parts."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("net"), (F.col("l_suppkey") % 4).cast("string")).alias("network_id"), F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")).distinct()


EDGES = """edges AS (SELECT DISTINCT concat('net', CAST(l_suppkey % 4 AS VARCHAR)) AS network_id, concat('S', CAST(l_suppkey AS VARCHAR)) AS src, concat('P', CAST(l_partkey AS VARCHAR)) AS dst FROM lineitem)"""

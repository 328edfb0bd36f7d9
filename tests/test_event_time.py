"""Event-time twins: shuffled rows over several batches give what the batch operators give on sorted ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.streaming import causal, ordered

SCHEMA = "s string, id int, x double, at timestamp"
#: Seconds after the epoch, which is the watermark of a query that has seen nothing.
BEGIN = 1_000_000


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _stream(spark, tmp_path, batches):
    """Rows (s, id, x, second); a file a batch, read in this order."""
    for i, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "s string, id int, x double, sec double").withColumn("at", F.timestamp_micros(((F.col("sec") + BEGIN) * 1_000_000).cast("long"))).drop("sec")
        made.coalesce(1).write.parquet(f"{tmp_path}/in/b={i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def _out(spark, df, tmp_path):
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/out")


def plain_scores(x):
    z = [0.0 if t < 4 else (x[t] - np.mean(x[:t])) / (np.std(x[:t]) + 1e-9) for t in range(len(x))]
    return [np.mean(z[max(0, t - 2) : t + 1]) for t in range(len(x))]


@pytest.fixture(scope="module")
def rows():
    g = random.Random(2)
    return [(f"s{k}", i, 1e6 + g.gauss(0, 1), 1000.0 * (i // 2)) for i in range(60) for k in range(2)]


def test_shuffled_rows_score_as_sorted_ones(spark, tmp_path, rows):
    mixed = random.Random(4).sample(rows[:-2], len(rows) - 2)  # within an hour late of each other by the wide lateness
    batches = [mixed[i : i + 40] for i in range(0, len(mixed), 40)] + [[("end", 0, 0.0, 200_000.0)]]
    df = _stream(spark, tmp_path, batches)
    got = {(r["s"], r["id"]): r["score"] for r in _out(spark, ordered.event_time_scores(df, ["s"], "at", "id", "x", "40 hours"), tmp_path).collect()}
    assert len(got) == len(mixed) == 118
    for k in range(2):
        want = plain_scores([r[2] for r in rows[:-2] if r[0] == f"s{k}"])
        assert all(got[f"s{k}", i] == pytest.approx(w, abs=1e-5) for i, w in enumerate(want))


def test_rows_wait_for_the_watermark_and_late_ones_are_dropped(spark, tmp_path):
    on = lambda sec, i, x=1.0: ("s", i, x, float(sec))
    batches = [[on(100, 1), on(300, 3), on(200, 2)], [on(250, 9), on(400, 4)], [on(150, 8), on(1000, 5)], [on(940, 6), on(940.001, 7)]]
    df = _stream(spark, tmp_path, batches)
    got = sorted(r["id"] for r in _out(spark, ordered.event_time_scores(df, ["s"], "at", "id", "x", "60 seconds"), tmp_path).collect())
    # Rows are late for the watermark before the last one: 250 is in time, 150 (240 by then) is not. 940 is the last watermark
    # itself, which 940.001 waits behind.
    assert got == [1, 2, 3, 4, 6, 9]


@pytest.mark.parametrize("idle", [None, 5_000_000_000])
def test_episodes_of_shuffled_rows(spark, tmp_path, idle):
    g = random.Random(8)
    rows = [(f"s{k}", i, float(g.random() < 0.6), 1000.0 * i + (20_000 if i >= 25 else 0)) for i in range(50) for k in range(3)]
    mixed = random.Random(1).sample(rows, len(rows))
    df = _stream(spark, tmp_path, [mixed[i : i + 50] for i in range(0, 150, 50)] + [[("end", 0, 0.0, 500_000.0)]])
    got = sorted((r["s"], r["a"], r["b"]) for r in _out(spark, ordered.event_time_episodes(df, ["s"], "at", "id", "x", 1.0, "40 hours", idle), tmp_path).select("s", (F.unix_seconds("started") - BEGIN).alias("a"), (F.unix_seconds("ended") - BEGIN).alias("b")).collect())
    want = []
    for k in range(3):
        begun = last = None
        for _, _, x, t in [r for r in rows if r[0] == f"s{k}"] + ([] if idle is None else [(0, 0, 0.0, 0.0)]):
            gap = idle is not None and last is not None and t - last > idle / 1e6
            if begun is not None and (x < 1.0 or gap):
                want.append((f"s{k}", int(begun), int(last)))
                begun = None
            if x >= 1.0:
                begun, last = (t if begun is None else begun), t
    assert got == sorted(want)


def test_late_readings_are_not_aggregated(spark, tmp_path):
    schema = "network_id string, ts timestamp, channel string, value double"
    for i, rows in enumerate([[("n", 1000, "pressure", 2.0), ("n", 90_000, "pressure", 9.0)], [("n", 95_000, "pressure", 9.0)], [("n", 2000, "pressure", 50.0)], [("n", 900_000, "pressure", 1.0)]]):
        spark.createDataFrame(rows, "network_id string, s long, channel string, value double").select("network_id", F.timestamp_seconds("s").alias("ts"), "channel", "value").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = _out(spark, causal.stream_sensor_aggregates(df), tmp_path)
    assert sorted(r["pressure_mean"] for r in out.collect()) == [2.0, 9.0]

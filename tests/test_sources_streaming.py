"""Files, and streaming operators against their batch twins."""

import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from gaugeflow.sources import files
from gaugeflow.streaming import causal


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(42, "n", 1.0), (43, "m", 2.0)], "seed int, network_id string, score double")
    files.write_records(df, f"{tmp_path}/r")
    assert sorted(map(tuple, files.read_records(spark, f"{tmp_path}/r", ["score", "seed"]).collect())) == [(1.0, 42), (2.0, 43)]
    files.write_csv_gz(df.withColumn("arm", F.lit("a")), f"{tmp_path}/c")
    got = files.read_csv_records(spark, f"{tmp_path}/c", "seed int, network_id string, score double, arm string", arms=["a"], networks=["m"])
    assert [tuple(r) for r in got.collect()] == [(43, "m", 2.0, "a")]


def test_nested_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rf": {"n1": {"auprc": 0.5, "rows": 7}, "n2": {"auprc": None}}}))
    flat = files.flatten_results(files.read_results_json(spark, str(tmp_path / "r.json")), ["arm", "network", "metric"])
    assert sorted(tuple(r)[1:] for r in flat.collect()) == [("rf", "n1", "auprc", 0.5), ("rf", "n1", "rows", 7.0)]


def test_sections(spark, tmp_path):
    (tmp_path / "a.inp").write_text("lost\n[junctions]\nJ1 10 ; c\n\n;only\nJ2 5\n[OPTIONS]\nUnits LPS\nHeadloss H-W\nunits GPM\n[JUNCTIONS]\nJ3 1\n")
    lines = files.section_lines(spark, str(tmp_path / "a.inp"))
    assert [(r["section"], r["line"]) for r in lines.orderBy("pos").collect()][:2] == [("JUNCTIONS", "J1 10"), ("JUNCTIONS", "J2 5")]
    r = files.section_inventory(lines).first()
    assert (r["junctions"], r["units"], r["headloss"], r["sections"]) == (3, "GPM", "H-W", ["JUNCTIONS", "OPTIONS"])
    p = files.file_provenance(spark, str(tmp_path)).first()
    assert p["sha256"] == hashlib.sha256((tmp_path / "a.inp").read_bytes()).hexdigest()
    assert files.discover_files(spark, str(tmp_path), ["*.inp", "*.i*"]).count() == 1


def _stream(spark, tmp_path, rows, schema):
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i : i + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def _run(spark, df, name, tmp_path, rows):
    """Runs until so many rows are out; queries with timeouts never fall idle."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    end = time.time() + 240
    while time.time() < end and q.isActive and spark.table(name).count() < rows:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None


def test_causal_score_streams_as_in_batch(spark, tmp_path):
    g = random.Random(1)
    rows = [(f"s{k}", t, g.gauss(0, 1)) for t in range(30) for k in range(2)]
    df = _stream(spark, tmp_path, rows, "s string, t int, x double")
    _run(spark, causal.stream_causal_score(df, "s", "t", "x"), "scores", tmp_path, len(rows))
    got = {(r["s"], r["t"]): r["score"] for r in spark.table("scores").collect()}
    import numpy as np

    for k in range(2):
        x = [r[2] for r in rows if r[0] == f"s{k}"]
        z = [0.0 if t < 4 else (x[t] - np.mean(x[:t])) / (np.std(x[:t]) + 1e-9) for t in range(30)]
        for t in range(30):
            assert abs(got[f"s{k}", t] - np.mean(z[max(0, t - 2) : t + 1])) < 1e-6


def test_episodes_close_when_the_score_falls(spark, tmp_path):
    rows = [("s", t, float(t % 10 in (3, 4, 5))) for t in range(40)]
    df = _stream(spark, tmp_path, rows, "s string, t int, x double")
    _run(spark, causal.stream_alarm_episodes(df, "s", "t", "x", 1.0), "episodes", tmp_path, 4)
    assert sorted((r["started"], r["ended"]) for r in spark.table("episodes").collect()) == [(10.0 * i + 3, 10.0 * i + 5) for i in range(4)]

"""How often a fit reads what it is fitted on."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugeflow.operators import detect


def counted(spark, n=400):
    g = np.random.default_rng(6)
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def look(v: pd.Series) -> pd.Series:
        seen.add(len(v))
        return v

    rows = [(int(y), float(y + g.normal()), float(g.normal())) for y in g.random(n) < 0.3]
    df = spark.createDataFrame(rows, "event_label int, a double, b double")
    return rows, df.withColumn("a", look("a")), df, seen


def test_a_logistic_fit_reads_its_rows_once(spark):
    rows, watched, plain, seen = counted(spark)
    model = detect.fit_logistic(watched, ["a", "b"])
    assert seen.value == len(rows)
    share = sum(y for y, _, _ in rows) / len(rows)
    weights = detect._weighted(plain, ["a", "b"], "event_label", True).groupBy("event_label").agg(F.first("weight").alias("w"))
    assert all(abs(r["w"] - 1 / (2 * (share if r["event_label"] else 1 - share))) < 1e-12 for r in weights.collect())
    scored = detect.score_rows(model, plain, "x").groupBy("event_label").agg(F.avg("score__x").alias("m"))
    means = {r["event_label"]: r["m"] for r in scored.collect()}
    assert means[1] > means[0] + 0.1


def test_a_forest_fit_reads_its_rows_once(spark):
    rows, watched, _, seen = counted(spark)
    detect.fit_forest(watched, ["a", "b"], trees=3)
    assert seen.value == len(rows)

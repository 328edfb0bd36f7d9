"""What normalising by half of the normal scenarios changes: scores under the half's and under the full reference, side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.metrics import ranking_metrics, stream_metrics
from gaugeflow.operators.sampling import folds
from gaugeflow.operators.windows import early_warning, exceedance_threshold, false_alarm_rows, normal_reference, normalise

#: References: one half's normal rows, and all of them.
SPLIT, FULL = "split", "full"


def split_scores(df: DataFrame, seed: int, column: str) -> DataFrame:
    """df's rows once per fold and reference (tag), with half, fold, role and score, the column normalised by that reference.

    role is "reference" for the half that the fold normalises by, else "evaluation". Networks whose half has no rows are left
    out of that fold, under both references, so that both are compared on the same rows.
    """
    both, by = folds(df, seed), ["network_id", "fold"]
    half = normal_reference(both.where("half = fold"), by, [column], 1)
    split = normalise(both, half, by, [column]).withColumnRenamed(f"z__{column}", SPLIT).join(half.select(*by), by, "left_semi")
    full = normalise(split, normal_reference(df, ["network_id"], [column], 1), ["network_id"], [column]).withColumnRenamed(f"z__{column}", FULL)
    role = F.when((F.col("scenario_kind") == "baseline") & (F.col("half") == F.col("fold")), "reference").otherwise("evaluation")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("score")) for t in (SPLIT, FULL)]))
    return full.withColumn("role", role).withColumn("__each", each).select(*[c for c in full.columns if c not in (SPLIT, FULL)], "role", "__each.tag", "__each.score")


def split_metrics(scored: DataFrame, stream: list[str], unit: list[str] = ["network_id"]) -> DataFrame:  # noqa: B006
    """(unit, tag, row_ap, row_prior, stream_ap, median_delay, within_3h, false_alarm_rows): means over both folds.

    Metrics are those of the evaluation rows; alarm thresholds come from the reference half alone, per sensor coverage.
    """
    by = [*unit, "fold", "tag"]
    seen, held = scored.where("role = 'evaluation'"), scored.where("role = 'reference'")
    rows = ranking_metrics(seen, by).select(*by, F.col("ap").alias("row_ap"), F.col("prior").alias("row_prior"))
    keys = list(dict.fromkeys([*by, *stream]))
    streams = stream_metrics(seen, stream, by).select(*by, "stream_ap")
    limits = exceedance_threshold(held, list(dict.fromkeys(stream)), [*by, "sensor_coverage"])
    timed = seen.join(limits, [*by, "sensor_coverage"])
    parts = [streams, early_warning(timed, keys, by, "threshold").select(*by, "median_delay", "within_3h"), false_alarm_rows(timed, keys, by, "threshold")]
    both = reduce(lambda a, b: a.join(b, by, "left"), parts, rows)
    return both.groupBy(*unit, "tag").agg(*[F.avg(c).alias(c) for c in both.columns if c not in by])


def split_difference(metrics: DataFrame, unit: list[str] = ["network_id"], metric: str = "row_ap") -> DataFrame:  # noqa: B006
    """(unit, full, split, difference, mean_difference, max_difference): the metric under the split reference less that under
    the full one, with the mean and the largest absolute difference over all units."""
    side = lambda tag: F.max(F.when(F.col("tag") == tag, F.col(metric))).alias(tag)
    each = metrics.groupBy(*unit).agg(side(FULL), side(SPLIT)).withColumn("difference", F.col(SPLIT) - F.col(FULL))
    over = each.agg(F.avg("difference").alias("mean_difference"), F.max(F.abs("difference")).alias("max_difference"))
    return each.join(F.broadcast(over))  # one row

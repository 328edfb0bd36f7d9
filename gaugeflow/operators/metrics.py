"""Exact, tie-aware ranking metrics and confusion counts, per group.

Everything is grouped by (group, score) first, so that window functions see each distinct score once; ranks come from
cumulative(), in ranges of scores where the input is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.ranks import cumulative


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def ranked(df: DataFrame, by: list[str], label: str = "event_label", score: str = "score", weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """(by, score, pos, neg, tp, fp, total_pos, total_neg, bad): cumulative counts from the largest score downwards.

    A group is ranked in `parts` score ranges, by default as many as the size of the input asks for.
    """
    w = weight if weight is not None else F.lit(1.0)
    y = F.col(label).cast("double")
    each = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"))
    each = each.withColumn("bad", (~finite(F.col("score"))).cast("int"))
    out = cumulative(each, by, "score", ["pos", "neg"], True, ("bad",), parts)
    return out.select(*by, "score", "pos", "neg", "bad", F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.col("pos_total").alias("total_pos"), F.col("neg_total").alias("total_neg"))


def _one_class() -> Column:
    return (F.col("total_pos") <= 0) | (F.col("total_neg") <= 0) | (F.col("bad") == 1)


def ranking_metrics(df: DataFrame, by: list[str], label: str = "event_label", score: str = "score", weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """(by, ap, auc, prior, n): average precision by steps, ROC area with half credit for ties; null for a single class or
    where a score is null, NaN or infinite."""
    r = ranked(df, by, label, score, weight, parts)
    p, n = F.greatest(F.col("total_pos"), F.lit(1e-300)), F.greatest(F.col("total_neg"), F.lit(1e-300))
    gain = F.when(_one_class(), None).otherwise(F.col("pos") / p * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    below = F.col("total_neg") - F.col("fp")
    area = F.when(_one_class(), None).otherwise(F.col("pos") * (below + F.col("neg") / 2) / p / n)
    return r.groupBy(*by).agg(F.sum(gain).alias("ap"), F.sum(area).alias("auc"), F.try_divide(F.max("total_pos"), F.max("total_pos") + F.max("total_neg")).alias("prior"), F.max(F.col("total_pos") + F.col("total_neg")).alias("n"))


def average_precision(df: DataFrame, by: list[str], label: str = "event_label", score: str = "score", parts: int | None = None) -> DataFrame:
    return ranking_metrics(df, by, label, score, parts=parts).select(*by, "ap")


def roc_auc(df: DataFrame, by: list[str], label: str = "event_label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, by, label, score).select(*by, "auc")


def weighted_average_precision(df: DataFrame, by: list[str], weight: str, label: str = "event_label", score: str = "score") -> DataFrame:
    """Average precision in which each row counts `weight` times; rows of weight 0 don't count."""
    return ranking_metrics(df.where(F.col(weight) > 0), by, label, score, F.col(weight).cast("double")).select(*by, "ap")


def stream_table(df: DataFrame, by: list[str], label: str = "event_label", score: str = "score") -> DataFrame:
    """One row per stream (by): max_score, mean_score (to 12 digits, so that equal means tie), label (any positive), kind and steps."""
    return df.groupBy(*by).agg(F.max(score).alias("max_score"), F.round(F.avg(score), 12).alias("mean_score"), F.max(label).alias("label"), F.min("scenario_kind").alias("kind"), F.count(F.lit(1)).alias("steps"))


def stream_metrics(df: DataFrame, stream: list[str], by: list[str], pool: str = "max") -> DataFrame:
    """(by, stream_ap, stream_prior, n_streams, n_normal): streams ranked by their max or mean score."""
    t = stream_table(df, list(dict.fromkeys([*by, *stream])))
    ap = ranking_metrics(t, by, "label", f"{pool}_score").select(*by, F.col("ap").alias("stream_ap"), F.col("prior").alias("stream_prior"))
    counts = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_streams"), F.count_distinct(F.when(F.col("kind") == "baseline", F.col("scenario_id"))).alias("n_normal"))
    return ap.join(counts, by)


def slice_metrics(df: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """(by, kind, ap, prior, n_positive): each kind that is present against all normal rows."""
    sides = df.withColumn("slice", F.explode(F.when(F.col("scenario_kind") == "baseline", F.array(*map(F.lit, kinds))).otherwise(F.array("scenario_kind"))))
    found = ranking_metrics(sides, [*by, "slice"])
    present = df.where(F.col("scenario_kind").isin(kinds)).groupBy(*by, F.col("scenario_kind").alias("slice")).agg(F.count_distinct(F.when(F.col("event_label") == 1, F.col("scenario_id"))).alias("n_positive"))
    return found.join(present, [*by, "slice"]).select(*by, "slice", "ap", "prior", "n_positive")


def leak_stream_metrics(df: DataFrame, stream: list[str], by: list[str]) -> DataFrame:
    """(by, full_ap, active_ap): leak streams against normal ones, by the maximum over all steps and over active ones."""
    some = df.where(F.col("scenario_kind").isin("leak", "baseline"))
    t = some.groupBy(*dict.fromkeys([*by, *stream])).agg(F.max("score").alias("whole"), F.max(F.when(F.col("event_label") == 1, F.col("score"))).alias("on"), F.max((F.col("scenario_kind") == "leak").cast("int")).alias("label"))
    t = t.withColumn("active", F.coalesce("on", "whole"))
    return ranking_metrics(t, by, "label", "whole").select(*by, F.col("ap").alias("full_ap")).join(ranking_metrics(t, by, "label", "active").select(*by, F.col("ap").alias("active_ap")), by)


def top_tie_fraction(df: DataFrame, stream: list[str], by: list[str]) -> DataFrame:
    """Share of streams whose maximum equals the largest of their group."""
    t = stream_table(df, list(dict.fromkeys([*by, *stream])))
    return t.withColumn("top", F.max("max_score").over(Window.partitionBy(*by))).groupBy(*by).agg(F.avg((F.col("max_score") == F.col("top")).cast("double")).alias("top_tie_fraction"))


def within_stream_ap(df: DataFrame, stream: list[str], by: list[str]) -> DataFrame:
    """(by, within_ap, chance, n_streams): average precision inside each leak stream with both classes, averaged."""
    m = ranking_metrics(df.where(F.col("scenario_kind") == "leak"), list(dict.fromkeys([*by, *stream]))).where("ap is not null")
    return m.groupBy(*by).agg(F.avg("ap").alias("within_ap"), F.avg("prior").alias("chance"), F.count(F.lit(1)).alias("n_streams"))


def rsi(df: DataFrame, stream: list[str], by: list[str], a: str, b: str, pool: str = "max") -> DataFrame:
    """(by, rsi): (row a - row b) - (stream a - stream b), over long records with `arm`."""
    keys = [*by, "arm"]
    both = ranking_metrics(df, keys).select(*keys, F.col("ap").alias("row")).join(stream_metrics(df, stream, keys, pool).select(*keys, "stream_ap"), keys)
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("row") - F.col("stream_ap")))
    return both.groupBy(*by).agg((side(a) - side(b)).alias("rsi"))


def keep_first_normals(df: DataFrame, n: int, by: str = "network_id") -> DataFrame:
    """All disturbances, and of each network the first n normal scenarios by id."""
    ids = df.where(F.col("scenario_kind") == "baseline").select(by, "scenario_id").distinct()
    kept = ids.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("scenario_id"))).where(F.col("k") <= n).drop("k")
    return df.where(F.col("scenario_kind") != "baseline").unionByName(df.where(F.col("scenario_kind") == "baseline").join(kept, [by, "scenario_id"], "left_semi"))


def confusion(df: DataFrame, by: list[str], threshold: float = 0.5, label: str = "event_label", score: str = "score") -> DataFrame:
    hit = F.col(score) >= threshold
    y = F.col(label) == 1
    return df.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))


def binary_report(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, the rates made of them (0 for 0/0), auc and ap."""
    c = confusion(df, by, threshold)
    rate = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"), rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), (tp + fp + tn + fn).alias("support"))
    out = out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    return out.join(ranking_metrics(df, by).select(*by, "ap", "auc"), by)


def report_by_coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """binary_report() of each group and of each of its coverages; coverage null stands for all."""
    every = df.withColumn("coverage", F.explode(F.array(F.lit(None).cast("double"), F.col("sensor_coverage"))))
    named = every.withColumn("slice", F.coalesce(F.col("coverage").cast("string"), F.lit("all")))
    return binary_report(named, [*by, "slice"])


def lift_over_prior(df: DataFrame, by: list[str]) -> DataFrame:
    return ranking_metrics(df, by).select(*by, (F.col("ap") - F.col("prior")).alias("lift"))


def prevalence(df: DataFrame) -> DataFrame:
    """Positive rate and rows per network, and of all networks as ALL."""
    return df.rollup("network_id").agg(F.avg(F.col("event_label").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"), F.grouping("network_id").alias("g")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("network_id")).alias("network_id"), "rate", "n")


def prevalence_by_slice(df: DataFrame) -> DataFrame:
    """The same per disturbance kind, network, both and neither."""
    out = df.cube("scenario_kind", "network_id").agg(F.avg(F.col("event_label").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"), F.grouping("scenario_kind").alias("gk"), F.grouping("network_id").alias("gn"))
    return out.select(F.when(F.col("gk") == 1, "ALL").otherwise(F.col("scenario_kind")).alias("scenario_kind"), F.when(F.col("gn") == 1, "ALL").otherwise(F.col("network_id")).alias("network_id"), "rate", "n")

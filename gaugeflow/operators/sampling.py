"""Sensor placement, halves, augmentation and screening. Random choices are made by hash, so that runs repeat them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalar import unit_hash
from gaugeflow.operators.neighbours import knn_pairs
from gaugeflow.operators.ranks import quantiles
from gaugeflow.operators.supersteps import Supersteps
from gaugeflow.operators.windows import normal_reference, normalise

#: Draws of one generator.
DRAWN = 4_096


def place_sensors(sensors: DataFrame, coverage: float, seed: int) -> DataFrame:
    """(network_id, sensor_id): ceil(n * coverage) of each network's sensors, at least one, the same for all its scenarios."""
    w = Window.partitionBy("network_id")
    share = min(1.0, max(0.0, coverage))
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), "network_id", F.lit(str(coverage)), F.col("sensor_id").cast("string")))
    ranked = sensors.withColumn("__k", F.row_number().over(w.orderBy(ticket))).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__k") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * share))).select("network_id", "sensor_id")


def place_sensors_stride(sensors: DataFrame, coverage: float) -> DataFrame:
    """The older rule: every (n div count)-th sensor by id, count of them."""
    w = Window.partitionBy("network_id")
    ranked = sensors.withColumn("__k", F.row_number().over(w.orderBy("sensor_id")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    ranked = ranked.withColumn("__c", F.greatest(F.lit(1), F.ceil(F.col("__n") * min(1.0, max(0.0, coverage))))).withColumn("__s", F.greatest(F.lit(1), F.floor(F.col("__n") / F.col("__c"))))
    return ranked.where((F.col("__k") % F.col("__s") == 0) & (F.floor(F.col("__k") / F.col("__s")) < F.col("__c"))).select("network_id", "sensor_id")


def halves(df: DataFrame, seed: int) -> DataFrame:
    """(network_id, scenario_id, half): normal scenarios of each network, half of them (rounded down) 0, the rest 1."""
    ids = df.where(F.col("scenario_kind") == "baseline").select("network_id", "scenario_id").distinct()
    w = Window.partitionBy("network_id")
    rank = F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("scenario_id").cast("string"))), "scenario_id"))
    return ids.withColumn("__k", rank).withColumn("__n", F.count(F.lit(1)).over(w)).select("network_id", "scenario_id", F.when(F.col("__k") <= F.floor(F.col("__n") / 2), 0).otherwise(1).alias("half"))


def folds(df: DataFrame, seed: int) -> DataFrame:
    """Each row once per fold, with half (null beside normal scenarios) and fold: half = fold marks the reference."""
    return df.join(halves(df, seed), ["network_id", "scenario_id"], "left").withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))


def split_calibration(df: DataFrame, seed: int, columns: list[str]) -> DataFrame:
    """Both folds: normalised by the reference of one half of the normals, kept are the other half and all disturbances."""
    both, by = folds(df, seed), ["network_id", "fold"]
    reference = normal_reference(both.where("half = fold"), by, columns, 1)
    kept = both.where((F.col("scenario_kind") != "baseline") | (F.col("half") != F.col("fold")))
    return normalise(kept, reference, by, columns).join(reference.select(*by), by, "left_semi")


def noise_augment(df: DataFrame, features: list[str], multiple: int, scale: float = 0.05, preserve: list[str] = (), label: str = "event_label", salt: str = "noise") -> DataFrame:
    """Rows with is_synthetic 0, and each positive `multiple` times with normal noise of scale * deviation per feature."""
    moved = [f for f in features if f not in preserve]
    positive = df.where(F.col(label) == 1)
    sd = positive.agg(*[F.greatest(F.coalesce(F.stddev_pop(f), F.lit(0.0)) * scale, F.lit(1e-9)).alias(f"__sd_{f}") for f in moved])
    whole = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    copies = positive.withColumn("__row", whole).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(multiple)))).join(F.broadcast(sd))

    def noise(f: str) -> Column:
        u, v = (F.greatest(unit_hash(F.lit(salt), F.lit(f), F.lit(x), F.col("__copy").cast("string"), "__row"), F.lit(1e-12)) for x in "uv")
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)

    # As rows of an array, so that a filter on them doesn't compute them again.
    each = F.inline(F.array(F.struct(*[(F.col(f) + F.col(f"__sd_{f}") * noise(f)).alias(f"__x_{f}") for f in moved])))
    made = copies.select("*", each).select(*[F.col(f"__x_{c}").alias(c) if c in moved else F.col(c) for c in df.columns], F.lit(1).alias("is_synthetic"))
    return df.withColumn("is_synthetic", F.lit(0)).unionByName(made)


def mixture_draws(ids: np.ndarray, weights: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], seed: int) -> np.ndarray:
    """A row for each id from a Gaussian mixture of parts (mean, root of the covariance). DRAWN consecutive ids share a
    generator, so that a row depends on its id only, whatever the batches."""
    out, upto = np.empty((len(ids), len(parts[0][0]))), np.cumsum(weights) / np.sum(weights)
    blocks = ids // DRAWN
    for block in np.unique(blocks):
        here = np.flatnonzero(blocks == block)
        g, at = np.random.default_rng((seed, int(block))), ids[here] % DRAWN
        which, z = np.searchsorted(upto[:-1], g.random(DRAWN), "right")[at], g.standard_normal((DRAWN, out.shape[1]))[at]
        for k, (mean, root) in enumerate(parts):
            out[here[which == k]] = mean + z[which == k] @ root.T
    return out


def gmm_augment(df: DataFrame, features: list[str], k: int, n: int, label: str = "event_label", seed: int = 42) -> DataFrame:
    """Rows with is_synthetic 0, and n drawn from a Gaussian mixture of the positives; other columns are null there.

    The mixture is fitted on the positives' distinct features, each weighted by its count: every iteration reads all of them.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    counts = df.where(F.col(label) == 1).groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("__w"))
    # Sorted, so that the first means are drawn from the same rows in each run.
    counts = Supersteps(df.sparkSession, "mixture").table(counts.sortWithinPartitions(*features))
    fitted = GaussianMixture(k=k, seed=seed, featuresCol="__f", weightCol="__w").fit(VectorAssembler(inputCols=features, outputCol="__f").transform(counts))
    weights = np.array(fitted.weights)
    parts = [(np.array(r.mean.toArray()), np.linalg.cholesky(r.cov.toArray() + 1e-9 * np.eye(len(features)))) for r in fitted.gaussiansDF.collect()]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(mixture_draws(batch["id"].to_numpy(), weights, parts, seed), columns=features)

    made = df.sparkSession.range(n).mapInPandas(draw, ", ".join(f"`{f}` double" for f in features)).withColumn(label, F.lit(1)).withColumn("is_synthetic", F.lit(1))
    return df.withColumn("is_synthetic", F.lit(0)).unionByName(made, allowMissingColumns=True)


def _between(pairs: DataFrame, vec: str, salt: str) -> DataFrame:
    """A point on the line of each pair, at a hashed fraction."""
    u = unit_hash(F.lit(salt), F.col("id").cast("string"), F.col("copy").cast("string"))
    return pairs.withColumn("__u", u).select(F.concat_ws("_", F.lit("s"), "id", "copy").alias("id"), F.zip_with(vec, "other", lambda a, b: a + F.col("__u") * (b - a)).alias(vec), F.lit(1).alias("event_label"), F.lit(1).alias("is_synthetic"))


def _made(df: DataFrame, neighbours: DataFrame, wanted: DataFrame, vec: str, salt: str) -> DataFrame:
    """wanted (id, times) copies of positives, each towards one of its positive neighbours by hash."""
    positive = df.where("event_label = 1").select("id", vec)
    lists = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    copies = wanted.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).join(lists, "id")
    pick = F.floor(unit_hash(F.lit(salt), F.lit("pick"), F.col("id").cast("string"), F.col("copy").cast("string")) * F.size("near")).cast("int")
    chosen = copies.select("id", "copy", F.get("near", pick)["neighbour"].alias("neighbour"))
    other = positive.select(F.col("id").alias("neighbour"), F.col(vec).alias("other"))
    made = _between(chosen.join(positive, "id").join(other, "neighbour"), vec, salt)
    return df.select(F.col("id").cast("string").alias("id"), vec, "event_label", F.lit(0).alias("is_synthetic")).unionByName(made)


def smote_augment(df: DataFrame, vec: str, k: int = 5, n: int | None = None, salt: str = "smote") -> DataFrame:
    """(id, vec, event_label, is_synthetic): positives interpolated with one of their k nearest positives, up to the number
    of negatives or n of them; with fewer than two positives nothing is made."""
    counts = df.agg(F.count_if(F.col("event_label") == 1).alias("p"), F.count_if(F.col("event_label") == 0).alias("q")).first()
    need = max(0, counts["q"] - counts["p"]) if n is None else n
    positive = df.where("event_label = 1")
    if counts["p"] < 2 or not need:
        return df.select(F.col("id").cast("string").alias("id"), vec, "event_label", F.lit(0).alias("is_synthetic"))
    whole, rest = divmod(need, counts["p"])
    # The rest goes to the positives of the smallest hashes.
    ticket = unit_hash(F.lit(salt), F.col("id").cast("string"))
    extra = positive.select("id").orderBy(ticket, "id").limit(rest).withColumn("more", F.lit(1))
    wanted = positive.select("id").join(extra, "id", "left").select("id", (F.lit(whole) + F.coalesce("more", F.lit(0))).alias("times"))
    return _made(df, knn_pairs(positive, "id", vec, k), wanted, vec, salt)


def adasyn_augment(df: DataFrame, vec: str, k: int = 5, n: int | None = None, salt: str = "adasyn") -> DataFrame:
    """Like smote_augment(), with copies in proportion to the share of negatives among each positive's k neighbours."""
    counts = df.agg(F.count_if(F.col("event_label") == 1).alias("p"), F.count_if(F.col("event_label") == 0).alias("q")).first()
    need = max(0, counts["q"] - counts["p"]) if n is None else n
    labels = df.select(F.col("id").alias("neighbour"), F.col("event_label").alias("__y"))
    near = knn_pairs(df, "id", vec, k).join(labels, "neighbour")
    hard = df.where("event_label = 1").select("id").join(near, "id").groupBy("id").agg(F.avg(1.0 - F.col("__y")).alias("share"))
    total = hard.agg(F.sum("share")).first()[0] or 0.0
    share = F.col("share") / total if total else F.lit(1.0 / max(1, counts["p"]))
    wanted = hard.select("id", F.round(share * need).cast("int").alias("times"))
    return _made(df, knn_pairs(df.where("event_label = 1"), "id", vec, k), wanted, vec, salt)


def fit_quantile_screen(df: DataFrame, features: list[str], lo: float = 0.01, hi: float = 0.99, margin: float = 0.1) -> DataFrame:
    """(feature, lo, hi, screened): quantiles widened by margin * spread; a spread of 1e-9 or less isn't screened."""
    each = quantiles(df, [], features, [lo, hi]).select(F.col("value").alias("feature"), F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    spread = F.col("b") - F.col("a")
    return each.select("feature", (F.col("a") - margin * spread).alias("lo"), (F.col("b") + margin * spread).alias("hi"), (spread > 1e-9).cast("int").alias("screened"))


def apply_quantile_screen(df: DataFrame, bounds: DataFrame, features: list[str]) -> DataFrame:
    """Rows inside every bound, ends included; null fails; a feature without a bound is an error."""
    known = {r["feature"]: r for r in bounds.collect()}
    if missing := [f for f in features if f not in known]:
        raise ValueError(f"the screen isn't fitted for {', '.join(missing)}")
    tests = [F.coalesce(F.col(f).between(known[f]["lo"], known[f]["hi"]), F.lit(False)) for f in features if known[f]["screened"]]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def augment(df: DataFrame, arm: str, features: list[str], multiple: int = 1, label: str = "event_label") -> DataFrame:
    """Rows with is_synthetic and what the arm (none, noise, gmm) adds, screened by the positives' bounds (all rows' below
    50 positives); where nothing passes the input stays as it is."""
    if arm == "none":
        return df.withColumn("is_synthetic", F.lit(0))
    positives = df.where(F.col(label) == 1)
    n = positives.count()
    made = noise_augment(df, features, multiple, label=label) if arm == "noise" else gmm_augment(df, features, 2, n * multiple, label)
    bounds = fit_quantile_screen(positives if n >= 50 else df, features)
    return made.where("is_synthetic = 0").unionByName(apply_quantile_screen(made.where("is_synthetic = 1"), bounds, features))


def sensitivity_grid(df: DataFrame, configs: list[dict], keep: Callable[[dict], Column]) -> DataFrame:
    """The rows that each setting keeps, with the settings as columns, from one pass over df."""
    hit = F.filter(F.array(*[F.when(keep(c), F.struct(*[F.lit(v).alias(k) for k, v in c.items()])) for c in configs]), lambda x: x.isNotNull())
    return df.withColumn("__c", F.explode(hit)).select(*[F.col(f"__c.{k}").alias(k) for k in configs[0]], *df.columns)

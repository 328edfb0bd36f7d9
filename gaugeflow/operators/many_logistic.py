"""Class-balanced logistic regressions of many overlapping sets of rows at once, as folds, slices or arms are.

Each row names the fits that it trains (column `fits`, an array). A Newton step of all fits is one aggregation over the rows:
tasks sum gradients and curvatures of their rows for each fit, and only those sums are shuffled. The number of jobs depends on
the steps until the last fit has converged, not on the number of fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.supersteps import Supersteps

#: Numbers that a task and the driver hold for the fits of one pass; more fits are dealt into further passes.
CELLS = 2_000_000
#: Relative error that a sum over many rows may have; a loss that rises by less doesn't count as risen.
NOISE = 1e-12
MODEL = "fit string, intercept double, coefficients array<double>, medians array<double>, rows long, positive_rows long"


def _passes(slim: DataFrame, fits: list[str], width: int, state) -> dict[str, np.ndarray]:
    """For each fit the sum over its rows of what `state(fit, x, y)` makes of a block of them, `width` numbers."""
    names, schema = pa.array(fits, pa.string()), pa.schema([("fit", pa.string()), ("s", pa.list_(pa.float64()))])

    def sums(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(fits), width)), np.zeros(len(fits), bool)
        for block in blocks:
            if not block.num_rows:
                continue
            x = block.column("x").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
            y, each = block.column("y").to_numpy(zero_copy_only=False), block.column("fits")
            row = np.repeat(np.arange(block.num_rows), pc.list_value_length(each).to_numpy(zero_copy_only=False))
            fit = pc.fill_null(pc.index_in(each.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            by_fit = np.argsort(fit, kind="stable")
            fit, row = fit[by_fit], row[by_fit]
            for f, at, end in zip(*_runs(fit), strict=True):
                if f >= 0:
                    total[f] += state(fits[f], x[row[at:end]], y[row[at:end]])
                    seen[f] = True
        used = np.flatnonzero(seen)
        # Typed by the schema: a task without rows has sums of no fit, whose type nothing else tells.
        yield pa.RecordBatch.from_arrays([pa.array([fits[f] for f in used], pa.string()), pa.array(total[used].tolist(), schema.field("s").type)], schema=schema)

    made = slim.mapInArrow(sums, "fit string, s array<double>")
    parts = made.groupBy("fit").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    return {r[0]: np.array(r[1:], float) for r in parts.collect()}  # a row for each fit of this pass


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    at = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.array([], int)
    return sorted_values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_values)][: len(at)]


def _moments(medians: dict[str, np.ndarray]):
    def of(fit: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mid = medians[fit]
        d = np.where(np.isnan(x), mid, x) - mid  # around the median, so that squares keep their digits
        return np.concatenate([[len(y), y.sum()], d.sum(axis=0), (d * d).sum(axis=0)])

    return of


def _curvature(models: dict[str, tuple]):
    def of(fit: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if fit not in models:
            return np.zeros(1 + (x.shape[1] + 1) * (x.shape[1] + 2))
        beta, mid, mean, sd, weights = models[fit]
        z = np.column_stack([np.ones(len(y)), (np.where(np.isnan(x), mid, x) - mean) / sd])
        w, margin = np.where(y > 0, weights[1], weights[0]), z @ beta
        p = 0.5 * (1 + np.tanh(margin / 2))
        loss = (w * (np.logaddexp(0.0, margin) - y * margin)).sum()
        return np.concatenate([[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    return of


def fit_many_logistic(df: DataFrame, features: list[str], fits: str = "fits", label: str = "event_label", ridge: float = 1e-4, most: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """A row per fit: (fit, intercept, coefficients in units of the features, medians, rows, positive_rows).

    Each fit fills nulls and NaN with its own medians (0 for a feature without values), scales by its own moments, weights both
    classes alike and minimises the mean log-loss plus ridge / 2 times the squared scaled coefficients, by Newton steps that are
    halved while the objective rises. Fits of a single class have null coefficients; names of no row make no fit; null names and
    rows without a label train nothing; a name that stands twice in a row counts once. Fails if a fit hasn't converged after
    `most` passes.
    """
    spark, wide = df.sparkSession, len(features)
    named = F.array_distinct(F.filter(F.coalesce(F.col(fits), F.array().cast("array<string>")), lambda f: f.isNotNull()))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    slim = df.where(F.col(label).isNotNull()).select(named.alias("fits"), F.col(label).cast("double").alias("y"), F.array(*[value(c) for c in features]).alias("x"))
    slim = Supersteps(spark, "fits").table(slim.where(F.size("fits") > 0))
    real = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    middle = slim.select(F.explode("fits").alias("fit"), "x").groupBy("fit").agg(*[F.percentile_approx(real(i), F.lit(0.5), F.lit(10_000)).alias(f"m{i}") for i in range(wide)])
    medians = {r[0]: np.array([0.0 if v is None else v for v in r[1:]]) for r in middle.collect()}  # a row per fit
    names, numbers = sorted(medians), 1 + (wide + 1) * (wide + 2)
    block = max(1, CELLS // numbers)
    found = []
    for at in range(0, len(names), block):
        found += _newton(slim, names[at : at + block], medians, wide, ridge, most, tolerance)
    return spark.createDataFrame(found, MODEL)


def _newton(slim: DataFrame, names: list[str], medians: dict[str, np.ndarray], wide: int, ridge: float, most: int, tolerance: float) -> list[tuple]:
    only = {f: medians[f] for f in names}
    sums = _passes(slim, names, 2 + 2 * wide, _moments(only))
    scale, models, done = {}, {}, []
    for f in names:
        n, ones = sums[f][:2]
        if ones in (0, n):
            done.append((f, None, None, medians[f].tolist(), int(n), int(ones)))
            continue
        shift = sums[f][2 : 2 + wide] / n
        var = np.maximum(sums[f][2 + wide :] - n * shift**2, 0.0) / max(1.0, n - 1)
        sd = np.sqrt(var)
        scale[f] = (medians[f] + shift, np.where(sd > 0, sd, 1.0), (n / (2 * (n - ones)), n / (2 * ones)), n, ones)
        models[f] = np.zeros(wide + 1)
    step = {f: (np.zeros(wide + 1), 0.0) for f in models}  # direction and slope from the last accepted point
    best = {f: (models[f], np.inf) for f in models}
    size, active = dict.fromkeys(models, 1.0), set(models)
    penalty = np.diag([0.0] + [ridge] * wide)
    for _ in range(most):
        if not active:
            break
        trial = {f: best[f][0] + size[f] * step[f][0] for f in active}
        at = {f: (trial[f], medians[f], *scale[f][:3]) for f in active}
        sums = _passes(slim, sorted(active), 1 + (wide + 1) * (wide + 2), _curvature(at))
        for f in sorted(active):
            n, s, beta = scale[f][3], sums[f], trial[f]
            loss = s[0] / n + beta @ penalty @ beta / 2
            if loss > best[f][1] + 1e-4 * size[f] * step[f][1] + NOISE * (1 + abs(best[f][1] if np.isfinite(best[f][1]) else 0.0)):
                size[f] /= 2
                continue
            slope = s[1 : wide + 2] / n + penalty @ beta
            curve = s[wide + 2 :].reshape(wide + 1, wide + 1) / n + penalty
            ahead = -np.linalg.solve(curve + 1e-12 * np.eye(wide + 1), slope)
            best[f], step[f], size[f] = (beta, loss), (ahead, slope @ ahead), 1.0
            if np.abs(ahead).max() < tolerance * (1 + np.abs(beta).max()) or np.abs(slope).max() < tolerance:
                active.discard(f)
    if active:
        raise RuntimeError(f"{len(active)} fits haven't converged, one of them is {min(active)!r}")
    for f, (beta, _) in best.items():
        mean, sd, _, n, ones = scale[f]
        coefficients = beta[1:] / sd
        done.append((f, float(beta[0] - coefficients @ mean), coefficients.tolist(), medians[f].tolist(), int(n), int(ones)))
    return done


def score_many(models: DataFrame, df: DataFrame, features: list[str], fit: str = "fit", name: str = "score") -> DataFrame:
    """df with `name`: the probability of the positive class by the model that the row names; null without one."""
    own = models.select(F.col("fit").alias("__fit"), "intercept", "coefficients", "medians")
    value = lambda c, i: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col("medians")[i])
    margin = sum((F.col("coefficients")[i] * value(c, i) for i, c in enumerate(features)), F.col("intercept"))
    joined = df.join(own, F.col(fit) == F.col("__fit"), "left")
    return joined.select(*[F.col(c) for c in df.columns], (1 / (1 + F.exp(-margin))).alias(name))


def leave_one_out_by_slice(df: DataFrame, group: str, slices: str, features: list[str], label: str = "event_label") -> DataFrame:
    """df's rows once for each of their slices (columns __slice, score): scored by the model of that slice which all groups but
    the row's own have trained. Every slice's every fold is fitted in the same passes.

    A null group is a group of its own name ''; a row without slices trains and scores nothing. Scores are null where the other
    groups of the slice have one class or no rows.
    """
    own = F.coalesce(F.col(group).cast("string"), F.lit(""))
    name = lambda s, g: F.concat_ws("\u0001", s, g)
    held = df.select(F.explode(slices).alias("s"), own.alias("g")).distinct().groupBy("s").agg(F.array_sort(F.collect_set("g")).alias("__groups"))
    long = df.withColumn("__slice", F.explode(F.array_distinct(slices))).withColumn("__own", own)
    # A row of names for each slice, of which there are few.
    both = long.join(held.withColumnRenamed("s", "__slice"), "__slice")
    others = F.transform(F.filter("__groups", lambda g: g != F.col("__own")), lambda g: name(F.col("__slice"), g))
    models = fit_many_logistic(both.withColumn("__fits", others), features, "__fits", label)
    scored = score_many(models, long.withColumn("__fit_name", name(F.col("__slice"), F.col("__own"))), features, "__fit_name")
    return scored.drop("__own", "__fit_name")

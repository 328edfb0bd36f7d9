"""Detectors on Spark ML and label-free ones, with the tables that compare them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.scalar import unit_hash
from gaugeflow.operators.many_logistic import leave_one_out_by_slice
from gaugeflow.operators.metrics import ranking_metrics
from gaugeflow.operators.ranks import quantiles
from gaugeflow.operators.sampling import augment
from gaugeflow.operators.supersteps import Supersteps


def class_weights(df: DataFrame, label: str = "event_label") -> DataFrame:
    """Adds weight: n / (2 * rows of the same label)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    return df.join(F.broadcast(counts.join(F.broadcast(total))), label).withColumn("weight", F.col("__n") / (2 * F.col("__c"))).drop("__c", "__n")


def _filled(features: list[str]) -> list:
    names = [f"__i_{f}" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=names), VectorAssembler(inputCols=names, outputCol="__v", handleInvalid="keep")]


def _weighted(df: DataFrame, features: list[str], label: str, written: bool) -> DataFrame:
    """The columns of a fit with class_weights(). They are written once unless df is a table already, since imputation, scaling
    and the classifier each read them all; the counts of labels, a row each, come to the driver."""
    slim = df.select(label, *features)
    if not written:
        slim = Supersteps(df.sparkSession, "fit").table(slim)
    counts = slim.groupBy(label).agg(F.count(F.lit(1))).collect()
    total, weight = sum(n for _, n in counts), F.lit(None).cast("double")
    for value, n in counts:
        if value is not None:
            weight = F.when(F.col(label) == value, total / (2 * n)).otherwise(weight)
    return slim.where(F.col(label).isNotNull()).withColumn("weight", weight)


def fit_forest(df: DataFrame, features: list[str], label: str = "event_label", trees: int = 200, seed: int = 42, written: bool = False) -> PipelineModel:
    """Median imputation and a class-balanced random forest."""
    forest = RandomForestClassifier(numTrees=trees, weightCol="weight", labelCol=label, featuresCol="__v", seed=seed)
    return Pipeline(stages=[*_filled(features), forest]).fit(_weighted(df, features, label, written))


def fit_logistic(df: DataFrame, features: list[str], label: str = "event_label", written: bool = False) -> PipelineModel:
    """Median imputation, scaling and class-balanced logistic regression."""
    scaler = StandardScaler(inputCol="__v", outputCol="__s", withMean=True)
    return Pipeline(stages=[*_filled(features), scaler, LogisticRegression(weightCol="weight", labelCol=label, featuresCol="__s", regParam=1e-4)]).fit(_weighted(df, features, label, written))


def score_rows(model: PipelineModel | None, df: DataFrame, arm: str) -> DataFrame:
    """df with score__arm: the positive class's probability; null where the arm has no model."""
    if model is None:
        return df.withColumn(f"score__{arm}", F.lit(None).cast("double"))
    return model.transform(df).withColumn(f"score__{arm}", vector_to_array("probability")[1]).select(*df.columns, f"score__{arm}")


def majority_detector(train: DataFrame, df: DataFrame, label: str = "event_label") -> DataFrame:
    """df with score: the label that most training rows have, 1 on a tie."""
    constant = train.agg((F.count_if(F.col(label) == 1) >= F.count_if(F.col(label) == 0)).cast("double").alias("score"))
    return df.join(F.broadcast(constant))


def fit_bounds(df: DataFrame, columns: list[str], how: str = "iqr", label: str = "event_label") -> DataFrame:
    """(feature, lo, hi, mean) from rows of label 0: quartiles widened by 1.5 spreads, or mean and three sample deviations."""
    normal = df.where(F.col(label) == 0)
    if how == "iqr":
        ends = quantiles(normal, [], columns, [0.25, 0.75]).select(F.col("value").alias("feature"), F.col("q")[0].alias("p"), F.col("q")[1].alias("q"))
        means = normal.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean")) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        spread = F.col("q") - F.col("p")
        return ends.join(F.broadcast(means), "feature").select("feature", (F.col("p") - 1.5 * spread).alias("lo"), (F.col("q") + 1.5 * spread).alias("hi"), "mean")
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("p"), F.greatest(F.stddev_samp(c), F.lit(1e-12)).alias("q"), F.avg(c).alias("mean")) for c in columns]
    lo, hi = F.col("p") - 3 * F.col("q"), F.col("p") + 3 * F.col("q")
    return normal.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*").select("feature", lo.alias("lo"), hi.alias("hi"), "mean")


def score_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """df with score (share of columns out of bounds, null counting as the mean) and predicted (any); 0 without columns."""
    known = bounds.collect()  # a row per feature
    if not known:
        return df.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    out = [(~F.coalesce(F.col(b["feature"]), F.lit(b["mean"])).between(b["lo"], b["hi"])).cast("double") for b in known]
    total = sum(out[1:], out[0])
    return df.withColumn("score", total / len(out)).withColumn("predicted", (F.col("score") > 0).cast("int"))


#: Levels of splits of an isolation tree.
DEEPEST = 8


def _drawn(train: DataFrame, features: list[str], trees: int, share: float, seed: int) -> DataFrame:
    """(features, tree): the rows of each tree's sample, each of them there with the chance `share`, independently of others.

    One hash tells the first tree that has a row, as the gap before a first success does; only rows that any tree has, a few
    thousandths of a large table, are hashed again for the trees after it.
    """
    text, salt = [F.col(f).cast("string") for f in features], F.lit(str(seed))
    gap = F.floor(F.log(F.greatest(unit_hash(salt, F.lit("first"), *text), F.lit(2.0**-33))) / F.lit(float(np.log1p(-share)))) if share < 1 else F.lit(0)
    any_tree = train.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("__first", gap).where(F.col("__first") < trees)
    each = any_tree.withColumn("tree", F.explode(F.sequence(F.col("__first").cast("int"), F.lit(trees - 1))))
    return each.where((F.col("tree") == F.col("__first")) | (unit_hash(salt, F.col("tree").cast("string"), *text) < share)).drop("__first")


def _heap(nodes: np.ndarray, average) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of each inner place of a full tree (children of i at 2 i + 1 and 2 i + 2) and the value of each last place."""
    size = 2 ** (DEEPEST + 1) - 1
    feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
    todo = [(0, 0)]
    while todo:
        place, at = todo.pop()
        f, c, lo, hi, n, depth = nodes[at]
        if f >= 0:
            feature[place], cut[place] = int(f), c
        value[place] = depth + average(np.array([n]))[0]
        if 2 * place + 2 < size:
            todo += [(2 * place + 1, int(lo) if f >= 0 else at), (2 * place + 2, int(hi) if f >= 0 else at)]
    return feature, cut, value


def isolation_scores(train: DataFrame, df: DataFrame, features: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """df with score: isolation forest of trees grown on hashed samples of `sample` rows, a task per group of trees.

    Only the samples (trees * sample rows) leave the table; the trees, of bounded size, are broadcast, as heaps of DEEPEST
    levels in which leaves are filled downwards, so that all rows of a batch go down a tree together.
    """
    n = max(1, train.count())
    share = min(1.0, 1.2 * sample / n)
    drawn = _drawn(train, features, trees, share, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.random.default_rng((seed, int(pdf["tree"].iloc[0])))
        x = np.nan_to_num(pdf[features].to_numpy(float))[:sample]
        nodes: list[tuple] = []

        def split(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, -1, -1, float(len(rows)), depth))
            spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(len(features))
            if len(rows) > 1 and depth < DEEPEST and spread.max() > 0:
                f = int(g.choice(np.flatnonzero(spread > 0)))
                cut = float(g.uniform(x[rows, f].min(), x[rows, f].max()))
                low = x[rows, f] < cut
                nodes[at] = (f, cut, split(rows[low], depth + 1), split(rows[~low], depth + 1), float(len(rows)), depth)
            return at

        split(np.arange(len(x)), 0)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "lo", "hi", "size", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", pdf["tree"].iloc[0])
        return out

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, lo int, hi int, size double, depth int").toPandas()

    def average(m: np.ndarray) -> np.ndarray:
        return np.where(m > 1, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1), 0.0)

    forest = [_heap(t.sort_values("node")[["feature", "cut", "lo", "hi", "size", "depth"]].to_numpy(float), average) for _, t in grown.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.concatenate([c.to_numpy(float) for c in columns]))
        n = len(columns[0])
        total, row = np.zeros(n), np.arange(n)
        for feature, cut, value in shared.value:
            at = np.zeros(n, np.int64)
            for _ in range(DEEPEST):
                at = 2 * at + 1 + (x.take(feature.take(at) * n + row) >= cut.take(at))
            total += value.take(at)
        return pd.Series(2.0 ** (-total / max(1, len(shared.value)) / max(1e-9, float(average(np.array([float(sample)]))[0]))))

    return df.withColumn("score", score(*[F.col(f).cast("double") for f in features]))


def isolation_predictions(train: DataFrame, df: DataFrame, features: list[str], label: str = "event_label", trees: int = 200) -> DataFrame:
    """df with score and predicted: a forest of the rows of label 0 in `train`, whose own scores set the cut. The share of
    positives in df, clipped to 0.05..0.25, of those rows lies above it; predicted is 1 above the cut."""
    normal = train.where(F.col(label) == 0)
    used = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__f_{f}") for f in features]
    names = [f"__f_{f}" for f in features]
    both = df.select("*", *used, F.lit(1).alias("__new")).unionByName(normal.select(*used, F.lit(0).alias("__new")), allowMissingColumns=True)
    scored = isolation_scores(normal.select(*used), both, names, trees)
    share = df.agg(F.least(F.lit(0.25), F.greatest(F.lit(0.05), F.avg(F.col(label).cast("double"))))).first()[0] or 0.05
    cut = quantiles(scored.where("__new = 0"), [], ["score"], [1 - share]).select(F.col("q")[0].alias("__cut"))
    return scored.where("__new = 1").join(F.broadcast(cut)).withColumn("predicted", (F.col("score") > F.col("__cut")).cast("int")).drop("__cut", "__new", *names)


def reconstruction_score(train: DataFrame, df: DataFrame, values: str, k: int = 3) -> DataFrame:
    """df (with an array column) and error, score: mean squared error after projection on the k main components of the
    training sequences, through a logistic curve around the training errors' 95th percentile."""
    from pyspark.ml.functions import array_to_vector

    vec = lambda d: d.withColumn("__v", array_to_vector(values))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vec(train))
    parts = model.pc.toArray()

    @F.pandas_udf("double")
    def error(v: pd.Series) -> pd.Series:
        x = np.stack(v) if len(v) else np.empty((0, parts.shape[0]))
        return pd.Series(((x - x @ parts @ parts.T) ** 2).mean(axis=1))

    limit = quantiles(train.select(error(values).alias("e")), [], ["e"], [0.95]).select(F.col("q")[0].alias("__t"))
    out = df.withColumn("error", error(values)).join(F.broadcast(limit))
    return out.withColumn("score", 1 / (1 + F.exp(-(F.col("error") - F.col("__t")) / F.greatest(F.col("__t"), F.lit(1e-9))))).drop("__t")


def arm_benchmark(train: DataFrame, test: DataFrame, arms: dict[str, tuple[str, str]], features: list[str], trees: int = 200) -> DataFrame:
    """test with a score per arm; arms name (augmentation, classifier). Each arm is fitted once and scores all networks; an arm
    whose rows have no two classes, or that has none, scores null.

    The rows of each augmentation are made and written once, for all its classifiers and all their passes, and so are the
    scores, which every metric reads again.
    """
    steps, out, made = Supersteps(test.sparkSession, "arms"), test, {}
    if set(how for how, _ in arms.values()) != {"none"}:  # read once otherwise
        train = steps.table(train)
    for arm, (how, classifier) in arms.items():
        if how not in made:
            data = steps.table(augment(train, how, features).fillna(0.0, subset=features).select("event_label", *features))
            made[how] = data, data.select("event_label").distinct().count() > 1
        data, two = made[how]
        model = None
        if two:
            model = fit_forest(data, features, trees=trees, written=True) if classifier == "forest" else fit_logistic(data, features, written=True)
        out = score_rows(model, out, arm)
    return steps.table(out)


def evaluate_networks(scored: DataFrame, arms: list[str], by: list[str]) -> DataFrame:
    """(arm, by, ap, auc, rows, positive_rows); groups of a single class have null metrics."""
    long = scored.unpivot([*by, "event_label"], [f"score__{a}" for a in arms], "arm", "score").withColumn("arm", F.substring("arm", 8, 100))
    keys = ["arm", *by]
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_label").alias("positive_rows"))
    return ranking_metrics(long, keys).select(*keys, "ap", "auc").join(counts, keys)


def feature_ablation(train: DataFrame, test: DataFrame, features: list[str], drop: list[str], by: list[str]) -> DataFrame:
    """(by, with_ap, without_ap, delta, prior) of one logistic arm with and without the named features."""
    out = None
    for name, used in (("with", features), ("without", [f for f in features if f not in drop])):
        m = ranking_metrics(score_rows(fit_logistic(train, used), test, "x"), by, score="score__x").select(*by, F.col("ap").alias(f"{name}_ap"), "prior")
        out = m if out is None else out.join(m.drop("prior"), by)
    return out.withColumn("delta", F.col("with_ap") - F.col("without_ap"))


def leave_one_group_out(df: DataFrame, group: str, features: list[str], arms: dict[str, tuple[str, str]], trees: int = 10) -> DataFrame:
    """evaluate_networks() of every group by arms fitted on all others. Logistic arms without augmentation are fitted for all
    groups in the same passes; others, forests and augmented arms, one group after the other."""
    together = [a for a, how in arms.items() if how == ("none", "logistic")]
    apart = {a: how for a, how in arms.items() if a not in together}
    out = None
    if together:
        filled = df.fillna(0.0, subset=features)
        scored = leave_one_out_by_slice(filled.withColumn("__all", F.array(F.lit("all"))), group, "__all", features)
        for arm in together:
            one = evaluate_networks(scored.withColumnRenamed("score", f"score__{arm}"), [arm], [group])
            out = one if out is None else out.unionByName(one)
    for (name,) in sorted(map(tuple, df.select(group).distinct().collect())) if apart else []:
        scored = arm_benchmark(df.where(F.col(group) != name), df.where(F.col(group) == name), apart, features, trees)
        one = evaluate_networks(scored, list(apart), [group])
        out = one if out is None else out.unionByName(one)
    return out


def slice_benchmark(df: DataFrame, slices: str, features: list[str], group: str = "network_id", by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """(slice, by, group, ap, prior, rows): within each slice a row belongs to (column `slices`, an array of names) every group
    is scored by the logistic model of the slice's other groups. All folds of all slices are fitted in the same passes."""
    keys = ["slice", *by, group]
    scored = leave_one_out_by_slice(df, group, slices, features).withColumnRenamed("__slice", "slice")
    rows = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return ranking_metrics(scored, keys).select(*keys, "ap", "prior").join(rows, keys)

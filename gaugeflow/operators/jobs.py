"""Whole evaluations made of the other operators: scenarios, rare priors, perturbed copies, suites and validation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.operators import aggregates as A
from gaugeflow.operators import compare as C
from gaugeflow.operators import detect as D
from gaugeflow.operators import graph as N
from gaugeflow.operators import joins as J
from gaugeflow.operators import metrics as M
from gaugeflow.sources.shared import shared_folder

#: What a triage model looks at, as far as a table has it.
TRIAGE = [
    "base_score", "pressure_range", "head_gap", "demand_flow_ratio", "pressure_flow_ratio", "mass", "energy", "violation", "plausibility", "mass_by_coverage", "energy_by_coverage",
    "score_by_plausibility", "score_by_coverage", "simulation_residual",
]


def triage_frame(df: DataFrame, normals: DataFrame) -> DataFrame:
    """df (with base_score) and every triage column that can be made of it; the expected ratio is that of `normals`."""
    ratio = normals.select("pressure_std", "flow_std").transform(scalar.expected_ratio)
    known = scalar.with_plausibility(df.join(F.broadcast(ratio)), F.col("ratio")).drop("ratio")
    return scalar.triage_features(known).withColumn("score_by_coverage", F.col("base_score") * F.col("sensor_coverage"))


def triage_columns(df: DataFrame) -> list[str]:
    return [c for c in TRIAGE if c in df.columns]


def scenario_table(readings: DataFrame, stream: list[str]) -> DataFrame:
    """A row per stream of long readings (with scenario_kind and event_label): stream_features() and the columns that
    plausibility and triage take, label (any positive step), kind and steps."""
    facts = readings.groupBy(*stream).agg(F.max("event_label").alias("event_label"), F.min("scenario_kind").alias("kind"))
    wide = A.stream_features(readings, stream).join(facts, stream)
    return wide.withColumns({"demand_sum": F.col("demand_mean") * F.col("n_steps"), "observed_count": F.col("n_sensors").cast("int"), "steps": F.col("n_steps")})


def _written(df: DataFrame) -> DataFrame:
    """The same rows from a table, as a model's fit reads them many times."""
    path = shared_folder(df.sparkSession, "scenarios")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scenario_evaluation(train: DataFrame, test: DataFrame, stream: list[str], features: list[str], coverages: list[float], kinds: list[str], least: int = 1, trees: int = 200, draws: int = 500) -> DataFrame:
    """(model, status, n_train, n_test, report, ap with an interval): streams of the listed coverages and kinds (and normals)
    with enough steps are scored by a forest of their features and by a triage model of its scores.

    Reports are those of binary_report(); the interval resamples scenarios within networks and is that of all networks
    pooled. An empty side gives one row whose status names it and whose figures are null. A training side of one class
    has no forest, a triage frame of one class leaves the base scores.
    """
    chosen = [J.filter_streams(x, coverages, kinds, least) for x in (train, test)]
    status = J.empty_split_status(*chosen)
    known = status.first()
    if known["status"] != "ok":
        return status.select(F.lit(None).cast("string").alias("model"), "status", "n_train", "n_test", *[F.lit(None).cast(t).alias(c) for c, t in REPORT])
    train, test = (_written(x.fillna(0.0, subset=features)) for x in chosen)
    two = train.select("event_label").distinct().count() > 1
    forest = D.fit_forest(train, features, trees=trees) if two else None
    scored = [D.score_rows(forest, x, "forest").withColumn("base_score", F.coalesce("score__forest", F.lit(0.0))) for x in (train, test)]
    frames = [triage_frame(x, train.where("event_label = 0")) for x in scored]
    model = D.fit_logistic(frames[0], triage_columns(frames[0])) if two else None
    done = D.score_rows(model, frames[1], "triage").withColumn("score__triage", F.coalesce("score__triage", "base_score"))
    done = done.withColumn("score__forest", F.col("base_score"))
    long = done.unpivot([*stream, "event_label"], ["score__forest", "score__triage"], "model", "score").withColumn("model", F.substring("model", 8, 100))
    long = _written(long.withColumn("member", F.concat_ws("|", "network_id", "scenario_id")))
    ends = C.bootstrap_ap(long, ["model"], "member", draws, "scenarios").select("model", "lo", "hi", "valid")
    out = M.binary_report(long, ["model"]).join(ends, "model")
    return out.select("model", F.lit("ok").alias("status"), F.lit(known["n_train"]).alias("n_train"), F.lit(known["n_test"]).alias("n_test"), *[F.col(c).cast(t).alias(c) for c, t in REPORT])


REPORT = [("support", "long"), ("precision", "double"), ("recall", "double"), ("f1", "double"), ("balanced_accuracy", "double"), ("ap", "double"), ("auc", "double"), ("lo", "double"), ("hi", "double"), ("valid", "long")]


def classifier_grid(train: DataFrame, test: DataFrame, hows: list[str], classifiers: list[str], features: list[str], baseline: str = "none", seed: str = "seed", trees: int = 200) -> DataFrame:
    """(how, classifier, mean, std, n, delta): each arm is fitted on each seed's training rows and scores that seed's test
    rows; networks weigh by their rows; mean and population deviation over seeds; delta is to the same classifier's baseline."""
    out = None
    for (s,) in sorted(map(tuple, train.select(seed).distinct().collect())):  # a handful of seeds
        grid = {f"{how}|{kind}": (how, kind) for how in hows for kind in classifiers}
        scored = D.arm_benchmark(train.where(F.col(seed) == s), test.where(F.col(seed) == s), grid, features, trees)
        one = A.macro_weighted(D.evaluate_networks(scored, list(grid), ["network_id"]), ["arm"], "ap", F.col("rows").cast("double")).withColumn(seed, F.lit(s))
        one = _written(one)  # a row per arm
        out = one if out is None else out.unionByName(one)
    table = A.seed_summary(out, ["arm"], "macro", 0)
    table = table.select(F.split_part("arm", F.lit("|"), F.lit(1)).alias("how"), F.split_part("arm", F.lit("|"), F.lit(2)).alias("classifier"), "mean", "std", "n")
    base = table.where(F.col("how") == baseline).select("classifier", F.col("mean").alias("__base"))
    return table.join(base, "classifier", "left").withColumn("delta", F.col("mean") - F.col("__base")).drop("__base")


def perturbed_copies(df: DataFrame, columns: list[str], copies: int, keys: list[str], seed: int = 42) -> DataFrame:
    """`copies` copies of every row with `copy` from 1, whose listed columns are multiplied by one demand multiplier per
    scenario (keys) and copy: normal around 1 with deviation 0.2, between 0.5 and 2."""
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))) if copies > 0 else df.withColumn("copy", F.lit(0)).where("false")
    factor = scalar.demand_multiplier(F.lit(1.0), F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("copy").cast("string"))
    return each.withColumn("__m", factor).withColumns({c: F.col(c) * F.col("__m") for c in columns}).drop("__m")


def randomised_training(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """The union of both over the columns that they share, with `origin`; the clean rows alone where there are no noisy ones."""
    shared = [c for c in clean.columns if c in noisy.columns]
    if noisy.isEmpty():
        return clean.withColumn("origin", F.lit("clean"))
    return clean.select(*shared, F.lit("clean").alias("origin")).unionByName(noisy.select(*shared, F.lit("noisy").alias("origin")))


def drawn_normals(normals: DataFrame, n: int, seed: int) -> DataFrame:
    """(network_id, scenario_id, drawn_id, demand_seed): n of each network's normal scenarios, the first by hash, under the ids
    and seeds of normal_catalog(). Networks with fewer give all."""
    ids = normals.select("network_id", "scenario_id").distinct()
    order = Window.partitionBy("network_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "network_id", F.col("scenario_id").cast("string"))), "scenario_id")
    drawn = ids.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n)
    catalog = J.normal_catalog(ids, n, seed).withColumn("__k", F.element_at(F.split("scenario_id", "__"), -1).cast("int") + 1).withColumnRenamed("scenario_id", "drawn_id")
    return drawn.join(catalog, ["network_id", "__k"]).drop("__k")


def rare_prior_benchmark(disturbed: DataFrame, normals: DataFrame, n: int, seed: int, arm: str = "arm") -> DataFrame:
    """(network_id, arm, row_ap, pooled_ap, n_scenarios, n_positive, positive_rate): long records of disturbances with n drawn
    normal scenarios of each network as negatives; rows ranked as they are, scenarios by their largest score."""
    drawn = drawn_normals(normals, n, seed).select("network_id", "scenario_id")
    both = disturbed.unionByName(normals.join(drawn, ["network_id", "scenario_id"], "left_semi"))
    keys = ["network_id", arm]
    pooled = M.stream_table(both, [*keys, "scenario_id"])
    top = M.ranking_metrics(pooled, keys, "label", "max_score").select(*keys, F.col("ap").alias("pooled_ap"), F.col("prior").alias("positive_rate"))
    counts = pooled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scenarios"), F.sum("label").cast("long").alias("n_positive"))
    return M.ranking_metrics(both, keys).select(*keys, F.col("ap").alias("row_ap")).join(top, keys).join(counts, keys)


def plausibility_vs_utility(report: DataFrame, metrics: DataFrame, by: list[str], source: str, baseline, metric: str = "ap") -> DataFrame:
    """(by, rho, n, p): plausibility_report()'s score_mean of each source against its metric minus that of the baseline
    source, which takes part with 0. Sources without either are left out."""
    base = metrics.where(F.col(source) == baseline).select(*by, F.col(metric).alias("__base"))
    delta = metrics.join(base, by).select(*by, source, (F.col(metric) - F.col("__base")).alias("delta"))
    return C.spearman(report.select(*by, source, "score_mean").join(delta, [*by, source]), by, "score_mean", "delta")


def suite_table(results: DataFrame, splits: list[str], summarised: list[str], metrics: list[str] = ("f1", "ap"), seed: str = "seed", draws: int = 2000) -> DataFrame:
    """A row per run and experiment: each split's metrics of the first seed, and for the summarised splits mean, sample
    deviation (null below two seeds), interval and number of seeds. `results` has run, experiment, seed, split and the metrics."""
    keys = ["run", "experiment"]
    first = results.groupBy(*keys).agg(F.min(seed).alias(seed))
    wide = results.join(first, [*keys, seed]).groupBy(*keys).pivot("split", splits).agg(*[F.first(m).alias(m) for m in metrics])
    long = results.where(F.col("split").isin(summarised)).unpivot([*keys, seed, "split"], list(metrics), "metric", "value").withColumn("of", F.concat_ws("_", "split", "metric"))
    ends = C.bootstrap_mean(long, [*keys, "of"], seed, "value", draws, "seeds")
    seeds = A.seed_summary(long, [*keys, "of"], "value", 1).select(*keys, "of", "n")
    names = [f"{s}_{m}" for s in summarised for m in metrics]
    summary = ends.join(seeds, [*keys, "of"]).groupBy(*keys).pivot("of", names).agg(*[F.first(c).alias(c) for c in ("mean", "std", "lo", "hi", "n")])
    return wide.join(summary, keys, "left")


def validation_summary(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, mean, std, n): the runs whose return_code is 0, mean and population deviation of each metric that they
    have; a null return_code is a failure. Groups in which no run has the metric keep a row with n 0."""
    long = runs.where(F.col("return_code") == 0).unpivot(by, metrics, "metric", "value")
    return A.seed_summary(long, [*by, "metric"], "value", 0)


def topology_scores(train: DataFrame, test: DataFrame, edges: DataFrame, nodes: DataFrame, node_columns: list[str], features: list[str]) -> DataFrame:
    """test with score__topology: logistic regression on the rows' features and their network's node columns, which are first
    spread over its links; rows of unknown networks have 0 for those."""
    spread = N.topology_propagation(edges, nodes, node_columns)
    names = [f"net_{c}" for c in node_columns]
    wide = spread.select("network_id", *[F.col(c).alias(x) for c, x in zip(node_columns, names, strict=True)])
    sides = [x.join(wide, "network_id", "left").fillna(0.0, subset=[*names, *features]) for x in (train, test)]
    scored = D.score_rows(D.fit_logistic(sides[0], [*features, *names]), sides[1], "topology").drop(*names)
    return _written(scored)  # metrics and counts read it many times

"""Joins, set operations, guards and catalogs around the record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.scalar import unit_hash
from gaugeflow.operators.ranks import cumulative, running_largest

#: Columns that describe how a record came about: fixed values, never features.
METADATA = {"leak_area", "leak_node", "disturbance_target", "scenario_id", "scenario_kind", "benchmark_id", "split", "stage", "event_label", "observed_junction_count", "observed_link_count", "demand_seed"}


def guard_no_metadata(columns: list[str]) -> list[str]:
    """The columns, or an error that names those that are metadata."""
    if bad := sorted(set(columns) & METADATA):
        raise ValueError(f"metadata among the features: {', '.join(bad)}")
    return columns


def select_numeric_features(df: DataFrame, target: str, exclude: list[str] = ()) -> list[str]:
    out = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != target and f.name not in exclude]
    if not out:
        raise ValueError("no numeric feature columns")
    return out


def validate_schema(df: DataFrame, required: list[str], optional: list[str] = (), target: str | None = None) -> None:
    """Fails on duplicate, overlapping or missing names, and on a target among the features."""
    names = [*required, *optional]
    if len(set(names)) < len(names):
        raise ValueError("a feature is named twice")
    if target in names:
        raise ValueError("the target is a feature")
    if missing := [c for c in [*required, *([target] if target else [])] if c not in df.columns]:
        raise ValueError(f"missing: {', '.join(missing)}")


def validate_split(fractions: dict[str, float]) -> None:
    if min(fractions.values()) <= 0 or abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("split fractions are positive and sum to 1")


def hash_split(df: DataFrame, key: str, fractions: dict[str, float], salt: str = "split") -> DataFrame:
    """Adds split: rows with equal keys share one, by hash."""
    validate_split(fractions)
    u, ends, at = unit_hash(F.lit(salt), F.col(key).cast("string")), [], 0.0
    for name, f in fractions.items():
        at += f
        ends.append((name, at))
    out = F.lit(ends[-1][0])
    for name, end in ends[-2::-1]:
        out = F.when(u < end, name).otherwise(out)
    return df.withColumn("split", out)


def restrict_normals(df: DataFrame, ids: DataFrame, key: str = "scenario_id") -> DataFrame:
    """All disturbances, and the listed normals."""
    normal = F.col("scenario_kind") == "baseline"
    return df.where(~normal).unionByName(df.where(normal).join(ids.select(key).distinct(), key, "left_semi"))


def disturbance_slice(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("scenario_kind").isin(kind, "baseline"))


def filter_coverage(df: DataFrame, coverage: float) -> DataFrame:
    return df.where(F.round("sensor_coverage", 2) == round(coverage, 2))


def filter_streams(index: DataFrame, coverages: list[float], kinds: list[str], least: int) -> DataFrame:
    """Streams of the listed coverages with enough steps, of the listed kinds or normal."""
    return index.where(F.col("sensor_coverage").isin(coverages) & (F.col("kind").isin(kinds) | F.col("kind").isin("baseline", "normal")) & (F.col("steps") >= least))


def empty_split_status(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: ok, or which side is empty."""
    n = train.agg(F.count(F.lit(1)).alias("n_train")).join(test.agg(F.count(F.lit(1)).alias("n_test")))
    return n.withColumn("status", F.when(F.col("n_train") == 0, "empty_train").when(F.col("n_test") == 0, "empty_test").otherwise("ok"))


def pending_keys(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(done, keys, "left_anti")


def relabel(column: str, names: dict[str, str]) -> Column:
    """Renamed values; those without a new name stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)], F.col(column))


def infer_tags(run: Column, tests: list[tuple[str, str]], default: str) -> Column:
    """The tag of the first test whose substring the run id holds."""
    return reduce(lambda out, t: F.when(F.contains(F.lower(run), F.lit(t[0])), t[1]).otherwise(out), reversed(tests), F.lit(default))


def staleness(files: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """(key, status): per set of files CURRENT, STALE (any file older than the set's bound) or MISSING; STALE outranks MISSING."""
    each = bounds.join(files, key, "left")
    rank = F.when(F.col("mtime").isNull(), 1).when(F.col("mtime") < F.col("bound"), 2).otherwise(0)
    return each.groupBy(key).agg(F.max(rank).alias("r")).select(key, F.when(F.col("r") == 2, "STALE").when(F.col("r") == 1, "MISSING").otherwise("CURRENT").alias("status"))


def resolve_splits(splits: DataFrame, benchmarks: DataFrame, key: str) -> DataFrame:
    """Split members with their benchmark's columns; a member that doesn't exist fails the query."""
    known = benchmarks.withColumn("__known", F.lit(True))
    joined = splits.join(known, key, "left")
    bad = F.raise_error(F.concat(F.lit("unknown benchmark "), F.col(key).cast("string")))
    return joined.withColumn("__known", F.when(F.col("__known"), True).otherwise(bad.cast("boolean"))).where("__known").drop("__known")


def select_entries(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


def label_events(steps: DataFrame, specs: DataFrame) -> DataFrame:
    """Adds label: for leaks 1 inside [start_time, end_time], for other kinds but baseline 1, else 0. One spec per scenario."""
    s = specs.select("scenario_id", F.col("scenario_kind").alias("__kind"), "start_time", "end_time")
    inside = (F.col("time_seconds") >= F.col("start_time")) & (F.col("time_seconds") <= F.col("end_time"))
    label = F.when(F.col("__kind") == "leak", F.coalesce(inside, F.lit(False)).cast("int")).when(F.coalesce(F.col("__kind"), F.lit("baseline")) == "baseline", 0).otherwise(1)
    return steps.join(s, "scenario_id", "left").withColumn("label", label).drop("__kind", "start_time", "end_time")


def score_parity(a: DataFrame, b: DataFrame, keys: list[str], scores: list[str], tolerance: float) -> DataFrame:
    """One row: rows on either side alone, the largest difference, and whether both sides agree."""
    left, right = a.select(*keys, *scores).withColumn("__l", F.lit(1)), b.select(*keys, *[F.col(s).alias(f"{s}__b") for s in scores]).withColumn("__r", F.lit(1))
    diff = F.greatest(*[F.abs(F.col(s) - F.col(f"{s}__b")) for s in scores]) if len(scores) > 1 else F.abs(F.col(scores[0]) - F.col(f"{scores[0]}__b"))
    out = left.join(right, keys, "full_outer").agg(F.count_if(F.col("__r").isNull()).alias("only_a"), F.count_if(F.col("__l").isNull()).alias("only_b"), F.max(diff).alias("max_difference"))
    return out.withColumn("equal", ((F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("max_difference") <= tolerance)).cast("int"))


def interval_overlap(rows: DataFrame, sims: DataFrame, key: str, id: str, tolerance: float = 0.05, parts: int | None = None) -> DataFrame:  # noqa: A002
    """(id, feasible): whether a row's [lo, hi] meets any simulated [lo (1 - tolerance), hi (1 + tolerance)] of its key.

    A row meets one iff some simulation begins at or before its end and ends at or after its start; simulations are
    reduced per key to running maxima of ends by start, so that rows are ranked against them instead of paired. The maxima
    are taken in ranges of starts (parts per key, by the size of the input if None), so that one key fills no task.
    """
    s = sims.select(key, (F.col("lo") * (1 - tolerance)).alias("at"), (F.col("hi") * (1 + tolerance)).alias("end"))
    marks = s.select(key, "at", F.lit(0).alias("what"), "end", F.lit(None).cast("long").alias("__id"), F.lit(None).cast("double").alias("lo"))
    asks = rows.select(key, F.col("hi").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("double").alias("end"), F.col(id).alias("__id"), "lo")
    seen = running_largest(marks.unionByName(asks), [key], "at", "end", "most", parts).where("what = 1")
    return seen.select(F.col("__id").alias(id), F.coalesce((F.col("most") >= F.col("lo")).cast("int"), F.lit(0)).alias("feasible"))


def feasibility_rate(rows: DataFrame, sims: DataFrame, key: str, id: str, fraction: float, salt: str) -> DataFrame:  # noqa: A002
    """(rate, n): interval_overlap() of the max(1, n * fraction) rows with the smallest hashes; null for no rows."""
    ranked = rows.withColumn("__u", unit_hash(F.lit(salt), F.col(id).cast("string")))
    want = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction)).alias("want")).first()[0]
    sample = ranked.orderBy("__u", id).limit(int(want)).drop("__u")
    return interval_overlap(sample, sims, key, id).agg(F.avg(F.col("feasible").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def closure_screen(pressures: DataFrame, by: list[str]) -> DataFrame:
    """(by): what keeps max |closed pressure| within max(3 * max |normal pressure|, 100)."""
    m = pressures.groupBy(*by).agg(F.max(F.abs("normal")).alias("n"), F.max(F.abs("closed")).alias("c"))
    return m.where(F.col("c") <= F.greatest(3 * F.col("n"), F.lit(100.0))).select(*by)


def best_arm(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Adds best: 1 for every arm equal to its group's largest value after rounding to three digits."""
    top = F.max(F.round(column, 3)).over(Window.partitionBy(*by))
    return df.withColumn("best", (F.round(column, 3) == top).cast("int"))


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_labelled_sources(a: DataFrame, b: DataFrame, label_a: str, label_b: str, always: list[str] = ("Time", "UTCmsec")) -> DataFrame:
    """Both sources' common columns that hold a number on each side, as doubles, with those always kept and `origin`;
    without such a column an empty result of the same form."""
    common = [c for c in a.columns if c in b.columns and c not in always]
    counts = [df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in common]).first() if common else {} for df in (a, b)]
    numeric = [c for c in common if counts[0][c] and counts[1][c]]
    kept = [c for c in always if c in a.columns and c in b.columns]
    side = lambda df, name: df.select(*kept, *[F.col(c).try_cast("double").alias(c) for c in numeric], F.lit(name).alias("origin"))
    out = side(a, label_a).unionByName(side(b, label_b))
    return out if numeric else out.limit(0)


def time_ordered_holdout(df: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """Adds part: the earliest share of normals (one row at least) train, all else evaluates.

    The cut is found from counts of distinct times, then among the rows of the time at the cut.
    """
    normal = df.where(F.col("scenario_kind") == "baseline")
    run = cumulative(normal.groupBy(order[0]).agg(F.count(F.lit(1)).alias("c")), [], order[0], ["c"])
    want = F.greatest(F.lit(1), F.floor(F.col("c_total") * fraction))
    before = F.col("c_upto") - F.col("c")
    cut = run.where((before < want) & (F.col("c_upto") >= want)).select(F.col(order[0]).alias("__cut"), (want - before).alias("__left"))
    ranked = df.join(F.broadcast(cut), how="left").withColumn("__k", F.row_number().over(Window.partitionBy(order[0], "scenario_kind").orderBy(*order[1:])))
    train = (F.col("scenario_kind") == "baseline") & ((F.col(order[0]) < F.col("__cut")) | ((F.col(order[0]) == F.col("__cut")) & (F.col("__k") <= F.col("__left"))))
    return ranked.withColumn("part", F.when(F.coalesce(train, F.lit(False)), "train").otherwise("evaluate")).select(*df.columns, "part")


def scenario_catalog(nodes: DataFrame, pipes: DataFrame, pumps: DataFrame, areas: list[float], k_nodes: int = 5, k_pipes: int = 3, k_pumps: int = 3) -> DataFrame:
    """(network_id, kind, target, area, scenario_id) of all networks: baseline, leaks of the top nodes in each area,
    closures of the top pipes, outages of the first pumps, one surge and one partial closure."""
    top_nodes = top_k(nodes.where("base_demand > 0"), ["network_id"], [F.desc("base_demand"), F.col("node_id")], k_nodes).select("network_id", F.col("node_id").alias("target"), F.row_number().over(Window.partitionBy("network_id").orderBy(F.desc("base_demand"), "node_id")).alias("k"))
    top_pipes = top_k(pipes, ["network_id"], [F.desc("diameter"), F.col("pipe_id")], k_pipes).select("network_id", F.col("pipe_id").alias("target"), F.row_number().over(Window.partitionBy("network_id").orderBy(F.desc("diameter"), "pipe_id")).alias("k"))
    first = top_k(pumps, ["network_id"], [F.col("pump_id")], k_pumps).select("network_id", F.col("pump_id").alias("target"))
    every = nodes.select("network_id").union(pipes.select("network_id")).union(pumps.select("network_id")).distinct()
    none, no_area = F.lit("").alias("target"), F.lit(0.0).alias("area")
    parts = [
        every.select("network_id", F.lit("baseline").alias("kind"), none, no_area),
        top_nodes.select("network_id", F.lit("leak").alias("kind"), "target", F.explode(F.array(*map(F.lit, areas))).alias("area")),
        top_pipes.select("network_id", F.lit("pipe_closure").alias("kind"), "target", no_area),
        first.select("network_id", F.lit("pump_outage").alias("kind"), "target", no_area),
        top_nodes.where("k = 1").select("network_id", F.lit("demand_surge").alias("kind"), "target", no_area),
        top_pipes.where("k = 1").select("network_id", F.lit("partial_valve_closure").alias("kind"), "target", no_area),
    ]
    out = union_frames(parts)
    return out.withColumn("scenario_id", F.concat_ws("__", "network_id", "kind", F.nullif("target", F.lit("")), F.when(F.col("area") > 0, F.format_number("area", 4))))


def normal_catalog(networks: DataFrame, n: int, seed: int) -> DataFrame:
    """(network_id, scenario_id, demand_seed): n normals per network with padded ids; seeds come from net_seed()."""
    from gaugeflow.functions.scalar import net_seed

    each = networks.select("network_id").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.select("network_id", F.concat(F.col("network_id"), F.lit("__normal__"), F.lpad(F.col("j").cast("string"), 4, "0")).alias("scenario_id"), (net_seed(F.lit(seed), F.col("network_id"), F.lit(0)) + 100000 + F.col("j")).alias("demand_seed"))

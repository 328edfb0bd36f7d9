"""Time-ordered operators inside streams: trends, causal residual scores, delays, episodes, alarm budgets, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeflow.operators.ranks import at_ranks, cumulative
from gaugeflow.operators.supersteps import Supersteps

ORDER = ["time_seconds", "event_id"]


def _stream(stream: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*stream).orderBy(*order)


def trends(df: DataFrame, stream: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """For each column and name: name (difference to the step before, first 0) and name_cumsum (its running sum)."""
    w = _stream(stream, order)
    for column, name in columns.items():
        df = df.withColumn(name, F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0.0)))
        df = df.withColumn(f"{name}_cumsum", F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df


def normal_reference(df: DataFrame, by: list[str], columns: list[str], least: int = 10) -> DataFrame:
    """Mean and population deviation per group over normal rows (kind baseline); fails for a group with fewer than `least`."""
    n = F.count(F.lit(1))
    ref = df.where(F.col("scenario_kind") == "baseline").groupBy(*by).agg(n.alias("__n"), *[f(c).alias(f"{p}__{c}") for c in columns for p, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    few = F.raise_error(F.format_string("a reference group has %d rows, %d are needed", F.col("__n"), F.lit(least)))
    return ref.withColumn("__n", F.when(F.col("__n") >= least, F.col("__n")).otherwise(few.cast("bigint"))).withColumnRenamed("__n", "n_reference")


def normalise(df: DataFrame, reference: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Adds z__column: (value - mean) / sd, 0 where sd is 0 or not finite; the small reference is joined in."""
    joined = df.join(reference, by, "left")
    z = lambda c: F.when((F.col(f"sd__{c}") > 0) & (F.col(f"sd__{c}") < float("inf")), (F.col(c) - F.col(f"mean__{c}")) / F.col(f"sd__{c}")).otherwise(0.0)
    return joined.select(*df.columns, *[z(c).alias(f"z__{c}") for c in columns])


def _causal(df: DataFrame, blend: Column, stream: list[str], order: list[str]) -> DataFrame:
    w = _stream(stream, order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__x", blend)
    z = F.when(F.row_number().over(w) <= 4, 0.0).otherwise((F.col("__x") - F.avg("__x").over(past)) / (F.stddev_pop("__x").over(past) + 1e-9))
    return df.withColumn("__z", z).withColumn("score", F.avg("__z").over(w.rowsBetween(-2, 0))).drop("__x", "__z")


def causal_residual_score(df: DataFrame, stream: list[str], reference: DataFrame, by: list[str], order: list[str] = ORDER) -> DataFrame:
    """Adds score: both residuals standardised by their group's reference (sd 0 divides by 1) and summed, then standardised
    by the stream's strictly earlier steps (0 for the first four), then averaged over the last three steps."""
    joined = df.join(reference.select(*by, *[f"{p}__{c}" for c in ("mass_residual", "energy_residual") for p in ("mean", "sd")]), by)
    one = lambda c: (F.col(c) - F.col(f"mean__{c}")) / F.when(F.col(f"sd__{c}") > 0, F.col(f"sd__{c}")).otherwise(1.0)
    return _causal(joined, one("mass_residual") + one("energy_residual"), stream, order).select(*df.columns, "score")


def residual_arm(df: DataFrame, stream: list[str], by: list[str], least: int = 1) -> DataFrame:
    """causal_residual_score() with references from the normal rows of each group."""
    return causal_residual_score(df, stream, normal_reference(df, by, ["mass_residual", "energy_residual"], least), by)


def causal_residual_self(df: DataFrame, stream: list[str], order: list[str] = ORDER) -> DataFrame:
    """The older variant: residuals standardised by their own whole stream."""
    whole = Window.partitionBy(*stream)
    own = lambda c: (F.col(c) - F.avg(c).over(whole)) / (F.stddev_pop(c).over(whole) + 1e-9)
    return _causal(df, own("mass_residual") + own("energy_residual"), stream, order)


def _onset(df: DataFrame, stream: list[str]) -> DataFrame:
    whole = Window.partitionBy(*stream)
    on = F.when(F.col("event_label") == 1, F.col("time_seconds"))
    return df.withColumn("onset", F.min(on).over(whole)).withColumn("last_on", F.max(on).over(whole))


def detection_delay(df: DataFrame, stream: list[str], threshold: Column | str, closed: bool = True) -> DataFrame:
    """Per stream with active steps (stream, detected, delay): first score >= threshold from the first active step, up to
    the last active one if closed, else to the record's end; a miss is delayed to that end."""
    hit = F.col("score") >= (F.col(threshold) if isinstance(threshold, str) else threshold)
    end = F.col("last_on") if closed else F.max("time_seconds").over(Window.partitionBy(*stream))
    inside = _onset(df, stream).withColumn("end", end).where((F.col("onset").isNotNull()) & (F.col("time_seconds") >= F.col("onset")) & (F.col("time_seconds") <= F.col("end")))
    first = F.min(F.when(hit, F.col("time_seconds")))
    return inside.groupBy(*stream).agg(first.isNotNull().cast("int").alias("detected"), (F.coalesce(first, F.max("end")) - F.max("onset")).alias("delay"))


def early_warning(df: DataFrame, stream: list[str], by: list[str], threshold: str, soon: float = 10800.0) -> DataFrame:
    """(by, median_delay, within_3h, in_window, n_streams) over leak streams with active steps."""
    d = detection_delay(df.where(F.col("scenario_kind") == "leak"), stream, threshold)
    return d.groupBy(*by).agg(F.median("delay").alias("median_delay"), F.avg(((F.col("detected") == 1) & (F.col("delay") < soon)).cast("double")).alias("within_3h"), F.avg(F.col("detected").cast("double")).alias("in_window"), F.count(F.lit(1)).alias("n_streams"))


def exceedance_threshold(df: DataFrame, stream: list[str], by: list[str], parts: int | None = None) -> DataFrame:
    """(by, threshold): quantile 1 - 1/L (not below 0) of the normal scores, L their streams' mean length, interpolated
    linearly. The fraction differs per group, so two ranks are looked up in counts of scores instead of calling percentile."""
    normal = df.where(F.col("scenario_kind") == "baseline")
    sizes = normal.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*[F.col(c) for c in stream]).alias("streams"))
    at = sizes.withColumn("q", F.greatest(F.lit(0.0), 1 - F.col("streams") / F.col("n"))).withColumn("h", F.col("q") * (F.col("n") - 1))
    scores = cumulative(normal.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("c")), by, "score", ["c"], parts=parts)
    wanted = at.select(*by, "h", F.explode(F.array(F.floor("h") + 1, F.ceil("h") + 1)).alias("k"))
    near = at_ranks(scores, by, "c_upto", ["score"], wanted, "k")
    low, high = F.min("score"), F.max("score")
    return near.groupBy(*by).agg((low + (F.max("h") - F.floor(F.max("h"))) * (high - low)).alias("threshold"))


def false_alarm_rows(df: DataFrame, stream: list[str], by: list[str], threshold: str) -> DataFrame:
    """Mean number of exceeding rows per normal stream."""
    each = df.where(F.col("scenario_kind") == "baseline").groupBy(*stream).agg(F.count_if(F.col("score") >= F.col(threshold)).alias("x"))
    return each.groupBy(*by).agg(F.avg(F.col("x").cast("double")).alias("false_alarm_rows"))


def alarm_episodes(df: DataFrame, stream: list[str], threshold: str, order: list[str] = ORDER) -> DataFrame:
    """(stream, episodes): runs of consecutive scores >= threshold."""
    on = (F.col("score") >= F.col(threshold)).cast("int")
    marked = df.withColumn("__on", on).withColumn("__start", ((F.col("__on") == 1) & (F.coalesce(F.lag("__on").over(_stream(stream, order)), F.lit(0)) == 0)).cast("int"))
    return marked.groupBy(*stream).agg(F.sum("__start").alias("episodes"))


def step_length(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, step): median gap of distinct times."""
    times = df.select(*by, "time_seconds").distinct()
    gaps = times.withColumn("gap", F.col("time_seconds") - F.lag("time_seconds").over(Window.partitionBy(*by).orderBy("time_seconds")))
    return gaps.groupBy(*by).agg(F.median("gap").alias("step"))


def episodes_per_day(df: DataFrame, stream: list[str], by: list[str], threshold: str, step_by: list[str]) -> DataFrame:
    """(by, per_day): episodes of normal streams over their days (rows times the step length of all rows by step_by)."""
    normal = df.where(F.col("scenario_kind") == "baseline")
    total = alarm_episodes(normal, stream, threshold).groupBy(*by).agg(F.sum("episodes").alias("episodes"))
    days = normal.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).join(step_length(df, step_by), step_by)
    return total.join(days, by).select(*by, F.try_divide(F.col("episodes").cast("double"), F.col("rows") * F.col("step") / 86400.0).alias("per_day"))


def pre_onset_alarm(df: DataFrame, stream: list[str], threshold: str) -> DataFrame:
    """(stream, early): whether a score reaches the threshold before the first active step."""
    marked = _onset(df, stream).where("onset is not null")
    return marked.groupBy(*stream).agg(F.max(((F.col("time_seconds") < F.col("onset")) & (F.col("score") >= F.col(threshold))).cast("int")).alias("early"))


def _budget_limits(df: DataFrame, stream: list[str], by: list[str], budgets: list[float], step_by: list[str], candidates: int, order: list[str], parts: int | None) -> DataFrame:
    """(by, step, limit_0, limit_1, ...): a threshold for each budget, all looked up in one curve of episodes.

    An episode begins where a score reaches t and the one before doesn't: episodes(t) = #(x >= t) - #(min(x, previous) >= t).
    Both are counts by score, written once. A candidate lies on a score or between two neighbours, whose upper one then tells
    its episodes.
    """
    normal = df.where(F.col("scenario_kind") == "baseline")
    before = F.lag("score").over(_stream(stream, order))  # a stream's first row has none: an alarm there begins an episode
    x = normal.select(*by, F.col("score").alias("x"), F.when(before.isNotNull(), F.least(F.col("score"), before)).alias("low"))
    ends = F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("low").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    points = x.select(*by, F.explode(ends).alias("p")).select(*by, "p.*").where("v is not null")
    counts = Supersteps(df.sparkSession, "episodes").table(points.groupBy(*by, "v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")))
    curve = cumulative(counts, by, "v", ["up", "down"], parts=parts)
    left = lambda c: F.col(f"{c}_total") - F.col(f"{c}_upto") + F.col(c)
    curve = curve.withColumn("episodes", left("up") - left("down"))
    # Rows without a score count neither for levels nor for days; all others are in `up` once.
    sizes = counts.groupBy(*by).agg(F.sum("up").alias("n"), F.max("v").alias("most")).join(step_length(df, step_by), step_by)
    grid = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    q = 1 - F.exp(F.log(F.lit(0.3)) + F.col("i") / float(candidates - 1) * (F.log(F.lit(1e-6)) - F.log(F.lit(0.3))))
    # Rounded, so that a level that falls on a score, as the first one may, isn't put beside it by the logarithms' last digits.
    grid = grid.withColumn("h", F.round(q * (F.col("n") - 1), 9))
    wanted = grid.select(*by, "n", "step", "most", "i", "h", F.explode(F.array(F.floor("h") + 1, F.ceil("h") + 1)).alias("k"))
    near = at_ranks(curve, by, "up_upto", ["v", "episodes"], wanted, "k").groupBy(*by, "i").agg(
        *[F.max(c).alias(c) for c in ("n", "step", "most", "h")], F.min(F.struct("v", "episodes")).alias("lo"), F.max(F.struct("v", "episodes")).alias("hi")
    )
    at = F.col("lo.v") + (F.col("h") - F.floor("h")) * (F.col("hi.v") - F.col("lo.v"))
    known = near.withColumn("at", at).withColumn("episodes", F.when(F.col("at") <= F.col("lo.v"), F.col("lo.episodes")).otherwise(F.col("hi.episodes")))
    fits = lambda b: F.col("episodes") <= F.lit(b) * F.col("n") * F.col("step") / 86400.0
    lowest = [F.coalesce(F.min(F.when(fits(b), F.col("at"))), F.max("most") + 1e-9).alias(f"limit_{j}") for j, b in enumerate(budgets)]
    return known.groupBy(*by).agg(F.max("step").alias("step"), *lowest)


def budget_threshold(df: DataFrame, stream: list[str], by: list[str], budget: float, step_by: list[str], candidates: int = 400, order: list[str] = ORDER, parts: int | None = None) -> DataFrame:
    """(by, threshold): the lowest of `candidates` high quantiles of the normal scores at which normal streams have at most
    `budget` episodes a day; just above the maximum if none."""
    return _budget_limits(df, stream, by, [budget], step_by, candidates, order, parts).select(*by, F.col("limit_0").alias("threshold"))


def alarm_budget(df: DataFrame, stream: list[str], by: list[str], budgets: list[float], step_by: list[str], soon: float = 10800.0, parts: int | None = None) -> DataFrame:
    """(by, budget, within_3h, in_window, pre_onset, n_streams, step_hours, steps_3h): rates of leak streams with active steps
    at the thresholds that each budget allows, the hours of a step and how many steps there are in `soon` seconds.

    All budgets are read off one curve and one pass over the leak streams, so that scans don't grow with them. Groups
    without normal rows have no threshold and are left out.
    """
    limits = _budget_limits(df, stream, by, budgets, step_by, 400, ORDER, parts)
    leaks = _onset(df.where(F.col("scenario_kind") == "leak"), stream).where("onset is not null").join(limits, by)
    time, every = F.col("time_seconds"), range(len(budgets))
    over = [F.col("score") >= F.col(f"limit_{j}") for j in every]
    first = [F.min(F.when(over[j] & time.between(F.col("onset"), F.col("last_on")), time)).alias(f"first_{j}") for j in every]
    early = [F.max(F.coalesce(((time < F.col("onset")) & over[j]).cast("double"), F.lit(0.0))).alias(f"early_{j}") for j in every]
    each = leaks.groupBy(*stream).agg(F.max("onset").alias("onset"), F.max("step").alias("step"), *first, *early)
    hit = [F.col(f"first_{j}") for j in every]
    rates = [
        F.struct(
            F.lit(float(b)).alias("budget"),
            F.avg(F.coalesce((hit[j] - F.col("onset") < soon).cast("double"), F.lit(0.0))).alias("within_3h"),
            F.avg(hit[j].isNotNull().cast("double")).alias("in_window"),
            F.avg(f"early_{j}").alias("pre_onset"),
        )
        for j, b in enumerate(budgets)
    ]
    out = each.groupBy(*by).agg(F.array(*rates).alias("x"), F.count(F.lit(1)).alias("n_streams"), F.max("step").alias("step"))
    out = out.select(*by, F.explode("x").alias("x"), "n_streams", "step")
    return out.select(*by, "x.*", "n_streams", (F.col("step") / 3600.0).alias("step_hours"), F.bround(F.try_divide(F.lit(soon), F.col("step"))).cast("long").alias("steps_3h"))


def alarm_budget_summary(rates: DataFrame, run: list[str], by: list[str]) -> DataFrame:
    """(by, budget, mean and population deviation of each rate, n_runs) over runs (as seeds): alarm_budget()'s rates are first
    pooled within a run, each stream counting once."""
    names = ["within_3h", "in_window", "pre_onset"]
    pooled = rates.groupBy(*run, "budget").agg(*[(F.sum(F.col(c) * F.col("n_streams")) / F.sum("n_streams")).alias(c) for c in names])
    return pooled.groupBy(*by, "budget").agg(*[f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))], F.count(F.lit(1)).alias("n_runs"))


def pack_sequences(df: DataFrame, stream: list[str], column: str, length: int = 24, order: list[str] = ORDER) -> DataFrame:
    """(stream, values): the column in time order, cut to length or filled up with zeros on the right."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(column), F.lit(0.0)).alias("__v")))), lambda x: x["__v"])
    return df.groupBy(*stream).agg(ordered.alias("v")).select(*stream, F.slice(F.concat("v", F.array_repeat(F.lit(0.0), length)), 1, length).alias("values"))


def broadcast_stream_score(df: DataFrame, stream: list[str]) -> DataFrame:
    """Each row with its stream's largest score and label, and whether that score is 0.5 or more."""
    w = Window.partitionBy(*stream)
    out = df.withColumn("stream_score", F.max("score").over(w)).withColumn("stream_label", F.max("event_label").over(w))
    return out.withColumn("stream_predicted", (F.col("stream_score") >= 0.5).cast("int"))


def sequence_dataset(df: DataFrame, stream: list[str], columns: list[str], order: list[str] = ORDER) -> DataFrame:
    """(stream, steps, label, values): per stream its ordered rows of the columns; disturbed streams without a positive row go."""
    row = F.struct(*order, F.array(*[F.col(c).cast("float") for c in columns]).alias("__x"))
    grouped = df.groupBy(*stream).agg(F.count(F.lit(1)).alias("steps"), F.max("event_label").alias("label"), F.min("scenario_kind").alias("kind"), F.array_sort(F.collect_list(row)).alias("rows"))
    kept = grouped.where((F.col("kind") == "baseline") | (F.col("label") == 1))
    return kept.select(*stream, "steps", "label", F.transform("rows", lambda r: r["__x"]).alias("values"))


def channel_width_gate(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, usable): whether all normal rows have one channel count (column observed_count)."""
    return df.where(F.col("scenario_kind") == "baseline").groupBy(*by).agg((F.count_distinct("observed_count") == 1).cast("int").alias("usable"))

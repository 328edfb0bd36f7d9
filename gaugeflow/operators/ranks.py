"""Running sums and ranks by value, read off counts of distinct values.

A group whose values are more than a task should sort is ranked in two levels: totals of ranges between its own quantiles,
then within each range. The number of ranges follows from the size of the files that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.supersteps import Supersteps

#: Bytes of input for each range, and ranges of a group at most.
RANGE_BYTES, MOST_PARTS = 256 << 20, 4_096


def parts_for(df: DataFrame) -> int:
    """Ranges for each group: as many as RANGE_BYTES go into the files and tables that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    size = sum(s for s in sizes if s < 1 << 62)  # what Spark says of sources whose size it doesn't know
    return max(1, min(MOST_PARTS, -(-size // RANGE_BYTES)))


def cumulative(df: DataFrame, by: list[str], value: str, columns: list[str], descending: bool = False, largest: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """df, which has one row for each value of a group, with c_upto and c_total for each of the columns c: the sum up to and
    with this value, and the group's; and for each column in `largest` its maximum over the group in its place.

    Adds __part, the range in which the row was ranked. Ranges are looked up by the group's quantiles, so that neither
    skewed values nor a group's size put more than about a range into one task.
    """
    parts = parts_for(df) if parts is None else parts
    order = F.desc(value) if descending else F.asc(value)
    upto = [f"{c}_upto" for c in columns]
    if parts == 1:
        whole = Window.partitionBy(*by)
        run = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        kept = [c for c in df.columns if c not in largest]
        return df.select(*kept, *[F.max(c).over(whole).alias(c) for c in largest], *[F.sum(c).over(run).alias(u) for c, u in zip(columns, upto, strict=True)], *[F.sum(c).over(whole).alias(f"{c}_total") for c in columns], F.lit(0).alias("__part"))
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(8 * parts)).alias("__cuts")
    ends = df.groupBy(*by).agg(cuts, *[F.sum(c).alias(f"{c}_total") for c in columns], *[F.max(c).alias(f"__max_{c}") for c in largest])
    part = F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(value))), F.lit(0))
    dealt = _same_group(df, ends, by).withColumn("__part", part if not descending else F.lit(parts) - part).drop("__cuts")
    sums = dealt.groupBy(*by, "__part").agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__start_{c}") for c in columns])
    run = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(starts, [*by, "__part"])
    kept = [c for c in df.columns if c not in largest]
    return out.select(*kept, *[F.col(f"__max_{c}").alias(c) for c in largest], *[(F.col(f"__start_{c}") + F.sum(c).over(run)).alias(u) for c, u in zip(columns, upto, strict=True)], *[f"{c}_total" for c in columns], "__part")


def _same_group(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of its group; without `by` there is one group, of one row."""
    return df.join(groups, by) if by else df.join(F.broadcast(groups))


def running_largest(df: DataFrame, by: list[str], at: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with `name`: the largest value of its group's rows up to and with this row's `at`, those with an equal one included.

    In two levels: within ranges between the group's quantiles of `at`, and carried over the ranges' maxima, so that a group
    of any size is ranked in tasks of about a range each. Equal `at` are in one range; adds __part, the range.
    """
    parts = parts_for(df) if parts is None else parts
    upto = lambda keys: Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if parts == 1:
        return df.withColumn(name, F.max(value).over(upto(by))).withColumn("__part", F.lit(0))
    cuts = df.groupBy(*by).agg(F.percentile_approx(at, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(8 * parts)).alias("__cuts"))
    dealt = _same_group(df, cuts, by).withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(at))), F.lit(0))).drop("__cuts")
    tops = dealt.groupBy(*by, "__part").agg(F.max(value).alias("__top"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "__part", F.max("__top").over(before).alias("__carried"))
    own = F.max(value).over(upto([*by, "__part"]))
    return dealt.join(carried, [*by, "__part"]).withColumn(name, F.greatest(own, F.col("__carried"))).drop("__carried")


def at_ranks(ranked: DataFrame, by: list[str], rank: str, hit: list[str], wanted: DataFrame, k: str) -> DataFrame:
    """wanted's rows with the columns `hit` of the first row of their group whose running count (column rank of
    cumulative()'s result) reaches k. Both are sorted together within ranges; no row meets more than its neighbours."""
    ends = ranked.groupBy(*by, "__part").agg(F.max(rank).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__part")
    spans = ends.select(*by, "__part", "__end", F.coalesce(F.lag("__end").over(before), F.lit(0)).alias("__start"))
    asked = wanted.join(spans, by) if by else wanted.join(spans)
    asked = asked.where((F.col(k) > F.col("__start")) & (F.col(k) <= F.col("__end"))).drop("__start", "__end")
    payload = [c for c in wanted.columns if c not in by]
    one = ranked.select(*by, "__part", F.col(rank).alias("__pos"), F.lit(1).alias("__what"), F.struct(*hit).alias("__hit"))
    two = asked.select(*by, "__part", F.col(k).alias("__pos"), F.lit(0).alias("__what"), F.struct(*payload).alias("__ask"))
    # From the end, so that the frame only ever gains rows: one that runs to the end of its range is gone through for each row.
    so_far = Window.partitionBy(*by, "__part").orderBy(F.desc("__pos"), F.desc("__what")).rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two, allowMissingColumns=True).withColumn("__hit", F.last("__hit", ignorenulls=True).over(so_far))
    return both.where("__what = 0").select(*by, "__ask.*", "__hit.*")


def quantiles(df: DataFrame, by: list[str], values: list[str], fractions: list[float], name: str = "q", parts: int | None = None) -> DataFrame:
    """(by, value, q): for each of the columns `values` (its name in `value`) and each group the exact quantiles, interpolated
    linearly as percentile() does it, in the order of `fractions`; null for a group without values.

    Two ranks for each are looked up in counts of distinct values, so that no task holds a group's values. The counts are
    written once, and so is the result, a row per group and column.
    """
    parts = parts_for(df) if parts is None else parts
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("__v")) for v in values])).alias("__x")
    keys = [*by, "value"]
    long = df.select(*by, each).select(*by, "__x.*")
    steps = Supersteps(df.sparkSession, "quantiles")
    counts = steps.table(long.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")))
    known = counts.where("__v is not null")
    sizes = known.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(float(f)).alias("__f")) for i, f in enumerate(fractions)])).alias("__x")
    at = sizes.select(*keys, "__n", each).select(*keys, "__x.__i", ((F.col("__n") - 1) * F.col("__x.__f")).alias("__h"))
    wanted = at.select(*keys, "__i", "__h", F.explode(F.array(F.floor("__h") + 1, F.ceil("__h") + 1)).alias("__k"))
    near = at_ranks(cumulative(known, keys, "__v", ["__c"], parts=parts), keys, "__c_upto", ["__v"], wanted, "__k")
    low, high, past = F.min("__v"), F.max("__v"), F.max("__h") - F.floor(F.max("__h"))
    one = near.groupBy(*keys, "__i").agg(F.when(past == 0, low).otherwise((1 - past) * low + past * high).alias("__q"))
    found = one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda x: x["__q"]).alias(name))
    names = counts.select(*keys).distinct() if by else df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("value"))
    return steps.table(names.join(found, keys, "left"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str, times: Column | None = None) -> DataFrame:
    """(by, value, name): the average rank of each value among its group's rows, each of which counts `times` times (once)."""
    counts = df.groupBy(*by, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("__c"))
    return cumulative(counts, by, value, ["__c"]).select(*by, value, (F.col("__c_upto") - (F.col("__c") - 1) / 2).alias(name))


def weighted_correlation(count: Column, x: Column, y: Column, total: Column) -> tuple[Column, Column, Column]:
    """Sums of products of two average ranks around their mean (total + 1) / 2, each row counting `count` times."""
    mean = (total + 1) / 2
    return F.sum(count * (x - mean) * (y - mean)), F.sum(count * (x - mean) * (x - mean)), F.sum(count * (y - mean) * (y - mean))

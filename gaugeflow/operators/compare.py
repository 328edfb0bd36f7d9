"""Paired comparisons, rank tests and resampling intervals. Draws are made by hash, so that any engine repeats them."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.scalar import unit_hash
from gaugeflow.functions.tails import correlation_p, normal_tail
from gaugeflow.operators.metrics import ranking_metrics
from gaugeflow.operators.ranks import average_ranks, parts_for, weighted_correlation
from gaugeflow.operators.supersteps import Supersteps


def paired_baseline(df: DataFrame, keys: list[str], base: str, column: str) -> DataFrame:
    """(arm, keys, delta): each arm minus the arm `base` where both have a value."""
    b = df.where((F.col("arm") == base) & F.col(column).isNotNull()).select(*keys, F.col(column).alias("__base"))
    return df.where((F.col("arm") != base) & F.col(column).isNotNull()).join(b, keys).select("arm", *keys, (F.col(column) - F.col("__base")).alias("delta"))


def wilcoxon(df: DataFrame, by: list[str], delta: str = "delta", most_exact: int = 50, alternative: str = "two-sided") -> DataFrame:
    """(by, n, statistic, p, effect, significant, error): signed ranks of paired differences.

    Zero differences are dropped, ties share ranks, and ranks are read off counts of distinct values. The statistic is the
    smaller rank sum, or for "greater" and "less" that of positive differences. Up to most_exact differences p is exact: the
    number of sign patterns of each rank sum, by adding one rank after another (ranks doubled, so that shared ones are whole).
    Beyond, it is normal with tie correction. effect = 1 - 2 W / (n (n + 1) / 2), n with zeros; significant is 1 for p < .05.
    All zero: p 1. Below two pairs everything but n and error is null.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"no such alternative: {alternative}")
    known = df.where(F.col(delta).isNotNull())
    all_n = df.groupBy(*by).agg(F.count(delta).alias("n_all"))
    use = known.where(F.col(delta) != 0).withColumn("__a", F.abs(F.col(delta)))
    values = use.groupBy(*by, "__a").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(delta) > 0).alias("ups"))
    values = Supersteps(df.sparkSession, "differences").table(values)  # as in spearman()
    ranks = values.join(average_ranks(values, by, "__a", "__r", F.col("t")), [*by, "__a"])
    sums = ranks.groupBy(*by).agg(F.sum("t").alias("m"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"), F.sum(F.col("__r") * F.col("ups")).alias("up"), F.sum(F.col("__r") * (F.col("t") - F.col("ups"))).alias("down"))
    s = all_n.join(sums, by, "left").withColumn("statistic", F.least("up", "down") if alternative == "two-sided" else F.col("up"))
    few = ranks.join(sums.where(F.col("m") <= most_exact).select(*by), by, "left_semi")
    lists = few.groupBy(*by).agg(F.flatten(F.collect_list(F.array_repeat((F.col("__r") * 2).cast("int"), F.col("t").cast("int")))).alias("__ranks"))
    total = (F.col("m") * (F.col("m") + 1)).cast("int")
    empty = F.transform(F.sequence(F.lit(0), total), lambda j: (j == 0).cast("double"))
    add = lambda acc, rank: F.transform(acc, lambda x, j: x + F.coalesce(F.get(acc, j - rank), F.lit(0.0)))
    # By symmetry the sums from `up` on are as frequent as those up to the negative differences' sum.
    upto = (2 * (F.col("down") if alternative == "greater" else F.col("statistic"))).cast("int")
    below = F.aggregate(F.slice(F.aggregate("__ranks", empty, add), F.lit(1), upto + 1), F.lit(0.0), lambda acc, x: acc + x) / F.pow(F.lit(2.0), F.col("m"))
    exact = s.join(lists, by).select(*by, (F.least(F.lit(1.0), 2 * below) if alternative == "two-sided" else below).alias("exact"))
    mean, var = F.col("m") * (F.col("m") + 1) / 4, F.col("m") * (F.col("m") + 1) * (2 * F.col("m") + 1) / 24 - F.col("tie") / 48
    z = (F.col("statistic") - mean) / F.sqrt(F.greatest(var, F.lit(1e-300)))
    tail = normal_tail(F.abs(z))
    side = {"two-sided": F.least(F.lit(1.0), 2 * tail), "greater": F.when(z >= 0, tail).otherwise(1 - tail), "less": F.when(z <= 0, tail).otherwise(1 - tail)}
    enough = lambda c: F.when(F.col("n_all") >= 2, c)
    out = s.join(exact, by, "left").withColumn("p", enough(F.when(F.col("m").isNull(), 1.0).otherwise(F.coalesce("exact", side[alternative]))))
    w = F.coalesce("statistic", F.lit(0.0))
    effect = F.when(F.col("m").isNull(), 0.0).otherwise(1 - 2 * w / (F.col("n_all") * (F.col("n_all") + 1) / 2))
    return out.select(
        *by, F.col("n_all").alias("n"), enough(w).alias("statistic"), "p", enough(effect).alias("effect"), (F.col("p") < 0.05).cast("int").alias("significant"),
        F.when(F.col("n_all") < 2, "at least 2 paired observations required").alias("error"),
    )


def holm(df: DataFrame, by: list[str], p: str = "p", name: str = "arm", alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and reject: step-down adjusted p-values, ties by name."""
    w = Window.partitionBy(*by).orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = df.withColumn("__x", (m - F.row_number().over(w) + 1) * F.col(p))
    return raw.withColumn("p_holm", F.least(F.lit(1.0), F.max("__x").over(w))).withColumn("reject", (F.col("p_holm") < alpha).cast("int")).drop("__x")


def spearman(df: DataFrame, by: list[str], x: str, y: str, ordinal: bool = False, tie: str | None = None) -> DataFrame:
    """(by, rho, n, p): correlation of average ranks, or of ordinal ones with ties broken by a column; null below 3 pairs.

    Average ranks are read off counts of distinct values, and equal pairs of values are counted before they meet their ranks.
    The counted pairs are written once: values that are means may differ in their last digit from one computation to the next,
    and would not meet their own ranks.
    p is two-sided: Student's t with n - 2 degrees for average ranks, the normal tail of that t for ordinal ones. A perfect
    correlation has p 0, or null for ordinal ranks.
    """
    use = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if ordinal:
        rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)).cast("double")
        ranks = use.withColumn("__x", rank(x)).withColumn("__y", rank(y))
        found = ranks.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("__x", "__y")).alias("rho"), F.count(F.lit(1)).alias("n"))
        t = F.abs(F.col("rho")) * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
        return found.withColumn("p", F.when(F.abs("rho") < 1, 2 * normal_tail(t)))
    pairs = Supersteps(df.sparkSession, "pairs").table(use.groupBy(*by, F.col(x).alias("__vx"), F.col(y).alias("__vy")).agg(F.count(F.lit(1)).alias("__n")))
    sizes = pairs.groupBy(*by).agg(F.sum("__n").alias("n"))
    ranks = [average_ranks(pairs, by, v, r, F.col("__n")) for v, r in (("__vx", "__x"), ("__vy", "__y"))]
    met = pairs.join(ranks[0], [*by, "__vx"]).join(ranks[1], [*by, "__vy"]).join(sizes, by)
    both, own_x, own_y = weighted_correlation(F.col("__n"), F.col("__x"), F.col("__y"), F.col("n"))
    sums = met.groupBy(*by, "n").agg(both.alias("__b"), own_x.alias("__p"), own_y.alias("__q"))
    rho = F.try_divide(F.col("__b"), F.sqrt(F.col("__p") * F.col("__q")))
    found = sums.select(*by, F.when(F.col("n") >= 3, rho).alias("rho"), "n")
    return found.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def paired_deltas(df: DataFrame, by: list[str], least: int = 3, member: str | None = None, least_tested: int = 6) -> DataFrame:
    """(by, mean_delta, wins, n, mde, p): groups with fewer than `least` pairs go; mde = 2.5 sd / sqrt(n).

    p is that of signed ranks, from `least_tested` pairs on. With member, deltas has each member's as (member, delta).
    """
    each = [F.sort_array(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct(F.col(member).alias("member"), "delta")))).alias("deltas")] if member else []
    mde = (2.5 * F.stddev_samp("delta") / F.sqrt(F.count("delta"))).alias("mde")
    out = df.groupBy(*by).agg(F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count("delta").alias("n"), mde, *each)
    tested = wilcoxon(df, by).where(F.col("n") >= least_tested).select(*by, "p")
    return out.where(F.col("n") >= least).join(tested, by, "left")


def family_deltas(df: DataFrame, families: Column, by: list[str]) -> DataFrame:
    """Deltas with each family's members collapsed to their mean; families is null for those that stay."""
    named = df.withColumn("member", F.coalesce(families, F.col("network_id")))
    return named.groupBy(*by, "member").agg(F.avg("delta").alias("delta"))


def leave_one_out(df: DataFrame, member: str) -> DataFrame:
    """Each member dropped in turn: the rows of all others, with `dropped`. Each row is repeated once per member."""
    names = df.select(F.col(member).alias("dropped")).distinct().agg(F.sort_array(F.collect_set("dropped")).alias("names"))
    return df.join(F.broadcast(names)).withColumn("dropped", F.explode("names")).where(F.col("dropped") != F.col(member)).drop("names")


def regression_check(df: DataFrame, expected: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, difference): value minus the expected one, null where either is missing."""
    e = expected.select(*keys, F.col(column).alias("__e"))
    return df.join(e, keys, "full_outer").select(*keys, (F.col(column) - F.col("__e")).alias("difference"))


def draws(members: DataFrame, by: list[str], member: str, count: int, salt: str) -> DataFrame:
    """(by, b, member, times): `count` resamples of each group's members, drawn by hash with replacement.

    Slot i of draw b takes member number floor(hash * n) in sorted order; groups are small tables of ids here.
    """
    w = Window.partitionBy(*by)
    order = members.select(*by, member).distinct().withColumn("k", F.row_number().over(w.orderBy(member)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    slots = order.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    pick = F.floor(unit_hash(F.lit(salt), F.col("b").cast("string"), *[F.col(c).cast("string") for c in by], F.col("k").cast("string")) * F.col("n")).cast("int")
    times = slots.select(*by, "b", pick.alias("k")).groupBy(*by, "b", "k").agg(F.count(F.lit(1)).alias("times"))
    return times.join(order.select(*by, "k", member), [*by, "k"]).select(*by, "b", member, "times")


#: How often a member counts in a draw, from sixteen bits of a hash: as often as the bits reach one of these fixed values,
#: 65,536 times the distribution function of Poisson(1).
TIMES = (24_109, 48_219, 60_273, 64_291, 65_296, 65_497, 65_530, 65_535)
#: Draws that one hash decides, rows times draws of a task, about, and blocks of a group's draws at most.
DRAWS, TASK_CELLS, BLOCKS = 8, 128_000_000, 8
#: Members whose times a task remembers, and numbers that are weighed together if a task has 1,000 draws.
MEMBERS, CELLS = 262_144, 2_000_000


def with_draws(df: DataFrame, members: list[str], count: int, salt: str) -> DataFrame:
    """df's rows once for each of `count` draws in which their member counts, with b and times.

    A member's times are Poisson(1) by hash, so that they are computed beside the row: no member is numbered, and no draw
    is joined in. Sizes of draws vary by the square root of the members.
    """

    def block(k: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(salt), k.cast("string"), *[F.col(c).cast("string") for c in members]))
        return F.flatten(F.transform(F.array(digest), lambda h: F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: F.struct((k * DRAWS + i).cast("int").alias("b"), F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int").alias("x")))))

    drawn = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-count // DRAWS) - 1)), block))
    used = F.filter(drawn, lambda d: (d["x"] >= TIMES[0]) & (d["b"] < count))
    out = df.withColumn("__d", F.explode(used))
    times = sum((F.col("__d.x") >= t).cast("int") for t in TIMES)
    return out.withColumn("b", F.col("__d.b")).withColumn("times", times).drop("__d")


def drawn_ap(slim: DataFrame, by: list[str], members: list[str], count: int, salt: str) -> DataFrame:
    """(by, b, ap): average precision of each draw over rows that count `rows` times their member's times.

    A task goes through a group's rows by falling score, a batch at a time, and keeps the sums of one block of draws: memory
    depends on neither the rows nor the draws. Blocks are as many as make TASK_CELLS with the group's rows, but BLOCKS at most,
    as each gets the rows anew. with_draws() gives the same values from rows.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in members])
    rows = slim.select(*by, key.alias("__m"), F.col("score").cast("double").alias("__s"), F.col("event_label").cast("double").alias("__y"), F.col("rows").cast("double").alias("__n"))
    kinds = dict(rows.dtypes)
    hashes = -(-count // DRAWS)
    blocks = F.least(F.lit(hashes), F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("__size") * count / TASK_CELLS))).cast("int")
    null_safe = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    sizes = rows.groupBy(*[F.col(c).alias(f"__by_{c}") for c in by]).agg(F.count(F.lit(1)).alias("__size"))
    dealt = rows.join(F.broadcast(sizes), functools.reduce(Column.__and__, null_safe)).withColumn("__blocks", blocks).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    # A number, as Spark would merge tasks of few bytes, which are much work.
    tasks = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), BLOCKS * parts_for(slim))
    work = dealt.select(*by, "__m", "__s", "__y", "__n", "__blocks", "__block").repartition(tasks, *by, "__block").sortWithinPartitions(*by, "__block", F.desc("__s"))
    return work.mapInArrow(_drawn_sorted(by, count, salt), ", ".join(f"{c} {kinds[c]}" for c in by) + ", b int, ap double")


#: Times for each value of sixteen bits.
LOOKUP = np.searchsorted(np.array(TIMES), np.arange(1 << 16), "right").astype(np.int8)


def _times(names: list[bytes], salt: str, hashes: range) -> np.ndarray:
    """How often each member counts in the draws of the hashes, a row per member."""
    found = np.empty((len(names), len(hashes) * DRAWS), np.int8)
    for i, k in enumerate(hashes):
        start, md5 = b"%s|%d|" % (salt.encode(), k), hashlib.md5
        found[:, i * DRAWS : (i + 1) * DRAWS] = LOOKUP[np.frombuffer(b"".join([md5(start + m).digest() for m in names]), ">u2")].reshape(-1, DRAWS)
    return found


class _Block:
    """One block of draws of one group, given its rows by falling score."""

    def __init__(self, count: int, salt: str, number: int, block: int):
        hashes = -(-count // DRAWS)
        self.salt, self.hashes = salt, range(hashes * block // number, hashes * (block + 1) // number)
        wide = len(self.hashes) * DRAWS
        self.draw, self.count = self.hashes.start * DRAWS + np.arange(wide), count
        self.places, self.known = {}, np.empty((0, wide), np.int8)  # of the first MEMBERS members
        self.tp, self.all, self.closed, self.area = (np.zeros(wide) for _ in range(4))
        self.bad, self.score = np.zeros(wide, bool), None

    def _weights(self, names: list[bytes]) -> np.ndarray:
        at = np.fromiter((self.places.get(m, -1) for m in names), np.int64, len(names))
        out = np.empty((len(names), len(self.draw)), np.int8)
        out[at >= 0] = self.known[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = _times([names[i] for i in new], self.salt, self.hashes)
            room = new[: max(0, MEMBERS - len(self.places))]
            if len(room):
                self.places.update(zip((names[i] for i in room), range(len(self.places), len(self.places) + len(room)), strict=True))
                self.known = np.concatenate([self.known, out[room]])
        return out

    def _close(self, tp: np.ndarray, every: np.ndarray) -> None:
        """Adds what ends of equal scores, a row each, gain."""
        gain = np.diff(tp, axis=0, prepend=self.closed[None, :])
        gain *= tp
        gain /= np.maximum(every, 1e-300)
        self.area += gain.sum(axis=0)
        self.closed = tp[-1].copy()

    def add(self, names: pa.Array, score: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        coded = names.dictionary_encode()
        times, member = self._weights(coded.dictionary.cast(pa.binary()).to_pylist()), coded.indices.to_numpy(zero_copy_only=False)
        up, bad = rows * label, ~np.isfinite(score)
        step = max(1, CELLS // 1_000)  # whatever the draws, so that sums don't depend on the blocks
        for at in range(0, len(score), step):
            part = slice(at, at + step)
            s, weight = score[part], times[member[part]]
            if self.score is not None and self.score != s[0]:
                self._close(self.tp[None, :], self.all[None, :])
            tp, every = (np.cumsum(weight * side[part, None], axis=0) + start for side, start in ((up, self.tp), (rows, self.all)))
            last = np.flatnonzero(s[1:] != s[:-1])
            if len(last):
                self._close(tp[last], every[last])
            if bad[part].any():
                self.bad |= (weight[bad[part]] > 0).any(axis=0)
            self.tp, self.all, self.score = tp[-1], every[-1], s[-1]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(draws, their average precision), NaN for a draw of one class or with a score that is no number."""
        self._close(self.tp[None, :], self.all[None, :])
        fits = (self.tp > 0) & (self.all > self.tp) & ~self.bad
        ap, kept = np.where(fits, self.area / np.maximum(self.tp, 1e-300), np.nan), self.draw < self.count
        return self.draw[kept], ap[kept]


def _drawn_sorted(by: list[str], count: int, salt: str):
    """The draws of each group and block in batches of rows that are sorted by them and by falling score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, same, block = None, None, None

        def done() -> pa.RecordBatch:
            draw, ap = block.found()
            ends = [pa.array(draw, pa.int32()), pa.array(ap, from_pandas=True)]
            return pa.RecordBatch.from_arrays([pa.array([v] * len(draw), t) for v, t in same] + ends, [*by, "b", "ap"])

        for batch in batches:
            if not len(batch):
                continue
            codes = [batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in [*by, "__block"]]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for start, end in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
                part = batch.slice(start, end - start)
                own = [part.column(c)[0].as_py() for c in [*by, "__block"]]
                if own != now:
                    if block is not None:
                        yield done()
                    now, same = own, [(part.column(c)[0].as_py(), part.schema.field(c).type) for c in by]
                    block = _Block(count, salt, part.column("__blocks")[0].as_py(), own[-1])
                block.add(part.column("__m"), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("__s", "__y", "__n")))
        if block is not None:
            yield done()

    return run


def _drawn(by: list[str], count: int, salt: str):
    """_drawn_sorted() of one group and block that are in one table, in any order."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_drawn_sorted(by, count, salt)(table.sort_by([("__s", "descending")]).to_batches(max_chunksize=MEMBERS)))

    return run


def bootstrap_ap(df: DataFrame, by: list[str], member: str, count: int, salt: str = "ap") -> DataFrame:
    """(by, point, mean, lo, hi, valid): average precision over resamples of members (rows or scenarios) within groups.

    Rows are summed by member and score before draws weight them. Draws with a single class are left out; without any,
    mean and ends are null.
    """
    point = ranking_metrics(df, by).select(*by, F.col("ap").alias("point"))
    slim = df.groupBy(*by, member, "score", "event_label").agg(F.count(F.lit(1)).alias("rows"))
    each = drawn_ap(slim, by, [*by, member], count, salt).where("ap is not null")
    ends = each.groupBy(*by).agg(F.avg("ap").alias("mean"), F.percentile("ap", F.lit(0.025)).alias("lo"), F.percentile("ap", F.lit(0.975)).alias("hi"), F.count(F.lit(1)).alias("valid"))
    return point.join(ends, by, "left").withColumn("valid", F.coalesce("valid", F.lit(0)).cast("long"))


def bootstrap_rsi(df: DataFrame, stream: list[str], group: str, a: str, b: str, count: int, salt: str = "rsi") -> DataFrame:
    """(group, point, lo, hi): rsi of arms a and b over resamples of scenarios within each group.

    A scenario drawn k times is k streams: both levels weight it by k. Invalid draws (a single class) are left out.
    """
    keys = [group, "arm"]
    streams = df.groupBy(*dict.fromkeys([*keys, *stream])).agg(F.max("score").alias("score"), F.max("event_label").alias("event_label"))
    slim = df.groupBy(*keys, "scenario_id", "score", "event_label").agg(F.count(F.lit(1)).cast("double").alias("rows"))

    def spread(drawn: bool) -> DataFrame:
        both, more = (slim, streams.withColumn("rows", F.lit(1.0))), ["b"] if drawn else []
        of = lambda x: drawn_ap(x, keys, [group, "scenario_id"], count, salt) if drawn else ranking_metrics(x, keys, weight=F.col("rows"))
        row, top = (of(x).select(*keys, *more, F.col("ap").alias(name)) for x, name in zip(both, ("row", "top"), strict=True))
        side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("row") - F.col("top")))
        return row.join(top, [*keys, *more]).groupBy(group, *more).agg((side(a) - side(b)).alias("rsi"))

    ends = spread(True).where("rsi is not null").groupBy(group).agg(F.percentile("rsi", F.lit(0.025)).alias("lo"), F.percentile("rsi", F.lit(0.975)).alias("hi"), F.count(F.lit(1)).alias("valid"))
    return spread(False).withColumnRenamed("rsi", "point").join(ends, group, "left")


def bootstrap_mean(df: DataFrame, by: list[str], member: str, column: str, count: int, salt: str) -> DataFrame:
    """(by, mean, std, lo, hi): mean and sample deviation of the members' values (networks or seeds) and the percentile interval
    of the mean over resampled members; all but the mean are null below two. Nulls and NaN are skipped."""
    values = df.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(*by, member).agg(F.avg(column).alias("__v"))
    means = values.join(draws(values, by, member, count, salt), [*by, member]).groupBy(*by, "b").agg((F.sum(F.col("__v") * F.col("times")) / F.sum("times")).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    base = values.groupBy(*by).agg(F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"), F.count(F.lit(1)).alias("members"))
    null_below = lambda c: F.when(F.col("members") >= 2, F.col(c)).alias(c)
    return base.join(ends, by).select(*by, "mean", "std", null_below("lo"), null_below("hi"))

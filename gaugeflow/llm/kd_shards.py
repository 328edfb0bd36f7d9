"""Sharding by a k-d tree over metadata, balanced in bytes.

The tree is found from histograms: each level needs a few grouped sums over a slim table, of which the driver sees one
row a node. What comes out is a nested CASE expression, so that placing a row costs neither a join nor a shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm._native import utf8_bytes
from gaugeflow.llm._scratch import Scratch

#: Bits of a position on one axis, and of the tie-break behind it.
AXIS_BITS, TIE_BITS = 20, 42
#: Low bits of the tie-break that tell rows with equal texts apart.
ROW_BITS = 14
#: Intervals a histogram divides a node's range into.
BINS = 4096
#: Bytes a row costs besides its text.
ROW_OVERHEAD = 16
#: Rows of one slot group at most, about.
SLOT_ROWS = 50_000
#: Texts that stand with different metadata, up to which they are broadcast (32 bytes each).
MOST_BROADCAST = 500_000


def default_axes() -> dict[str, Column]:
    """Metadata axes of the documents table, each as a value in 0..1: length on a log scale, language and source by hash."""
    unit = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(1 << AXIS_BITS)) / F.lit(float(1 << AXIS_BITS))
    return {
        "lang": unit(F.col("lang")),
        "source": unit(F.col("source")),
        "length": F.least(F.lit(1.0), F.log2(F.lit(1.0) + utf8_bytes(F.col("text"))) / F.lit(40.0)),
    }


def _tie(same: Column, row_id: Column) -> Column:
    """Equal texts lie side by side; only a group of them that outweighs a step of the histogram is cut, by row id."""
    by_text = F.shiftrightunsigned(same, 64 - TIE_BITS + ROW_BITS)
    return F.shiftleft(by_text, ROW_BITS) + F.shiftrightunsigned(F.xxhash64(row_id), 64 - ROW_BITS)


def _place(tree: dict, node: tuple, keys: list[str]) -> Column:
    """Nested CASE from the root to the leaf number."""
    if node not in tree:
        return F.lit(node[0])
    axis, cut, left, right = tree[node]
    return F.when(F.col(keys[axis]) < F.lit(cut), _place(tree, left, keys)).otherwise(_place(tree, right, keys))


def _cut_level(slim: DataFrame, tree: dict, nodes: list[tuple], keys: list[str], total: float, shards: int) -> None:
    """Adds to the tree the cuts of all nodes of one level."""
    root = (0, shards)
    ids = {node: i for i, node in enumerate(nodes)}
    first = {node[0]: ids[node] for node in nodes}
    # A row's node is named by its first leaf; leaves that are ready map to none.
    at = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), _place(tree, root, keys)) if len(nodes) > 1 or tree else F.lit(0)
    rows = slim.withColumn("__node", at).where(F.col("__node").isNotNull())
    stats = {r["__node"]: r for r in rows.groupBy("__node").agg(F.sum("__size").alias("b"), *[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    axis, low, high, want = {}, {}, {}, {}
    for node, i in ids.items():
        left = (node[1] + 1) // 2
        if i in stats:
            s = stats[i]
            spread = [(s[f"hi{a}"] >> TIE_BITS) - (s[f"lo{a}"] >> TIE_BITS) for a in range(len(keys))]
            axis[i] = max(range(len(keys)), key=lambda a: (spread[a], -a))
            low[i], high[i] = s[f"lo{axis[i]}"], s[f"hi{axis[i]}"] + 1
            want[i] = s["b"] * left / node[1]
        else:
            axis[i], low[i], high[i], want[i] = 0, 0, 1, 0.0
    before, live = dict.fromkeys(low, 0.0), [i for i in low if i in stats]
    exact = max(1.0, total / shards / 512)
    pick = lambda d, kind="long": F.element_at(F.create_map(*[x for i in live for x in (F.lit(i), F.lit(d[i]).cast(kind))]), F.col("__node"))
    while live:
        # Every pass divides each node's open range into BINS and keeps the bin that holds the wanted weight.
        width = {i: max(1, -(-(high[i] - low[i]) // BINS)) for i in live}
        key = reduce(lambda e, a: F.when(pick(axis) == a, F.col(keys[a])).otherwise(e), range(1, len(keys)), F.col(keys[0]))
        part = rows.where(F.col("__node").isin(live)).withColumn("__key", key).where((F.col("__key") >= pick(low)) & (F.col("__key") < pick(high)))
        bins = part.groupBy("__node", F.call_function("div", F.col("__key") - pick(low), pick(width)).alias("__bin")).agg(F.sum("__size").alias("b"))
        run = F.sum("b").over(Window.partitionBy("__node").orderBy("__bin"))
        ends = bins.withColumn("run", run).withColumn("before", F.col("run") - F.col("b"))
        found = ends.withColumn("__want", pick({i: float(want[i] - before[i]) for i in live}, "double")).where(F.col("run") >= F.col("__want")).groupBy("__node").agg(F.min(F.struct("__bin", "b", "before")).alias("x")).collect()
        at_bin = {r["__node"]: r["x"] for r in found}
        for i in list(live):
            x = at_bin.get(i)
            if x is None:  # rounding of the wanted weight past the last row
                low[i] = high[i]
                live.remove(i)
                continue
            start = low[i] + x["__bin"] * width[i]
            end = min(high[i], start + width[i])
            if x["b"] <= exact or width[i] == 1:
                near = want[i] - before[i] - x["before"] < x["before"] + x["b"] - (want[i] - before[i])
                low[i] = start if near else end
                live.remove(i)
            else:
                before[i] += x["before"]
                low[i], high[i] = start, end
    for node, i in ids.items():
        left = (node[1] + 1) // 2
        tree[node] = (axis[i], int(low[i]), (node[0], left), (node[0] + left, node[1] - left))


def kd_shards(df: DataFrame, shards: int, axes: dict[str, Column] | None = None, size: Column | None = None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Adds `shard` (int, 0 to shards - 1) and `size` (long); bytes of the shards are near equal.

    A node with several shards to come is cut along its widest axis at the weighted quantile that its halves need, until
    each leaf holds the target of total / shards bytes. Rows with equal positions are told apart by a hash of the text.
    Equal texts take the same place whatever their metadata, and share a leaf unless they outweigh 1/512 of a shard and a
    cut runs through them.
    Null metadata counts as empty, a null text as 0 bytes; an empty table gives an empty result. Columns named shard and
    size are replaced, all others stay.
    """
    axes = axes or default_axes()
    size = size if size is not None else utf8_bytes(F.col(text)) + F.lit(ROW_OVERHEAD)
    keys = [f"__k{i}" for i in range(len(axes))]
    scratch = Scratch(df.sparkSession, "kd-shards")
    same = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    spots = [_position(a).alias(f"__a{i}") for i, a in enumerate(axes.values())]
    placed = _with_common_spots(df.select("*", size.alias("__size"), same.alias("__same"), *spots), scratch, len(axes))
    tie = _tie(F.col("__same"), F.col(row_id))
    placed = placed.select("*", *[(F.shiftleft(F.col(f"__a{i}"), TIE_BITS) + tie).alias(k) for i, k in enumerate(keys)])
    slim = scratch.table(placed.select("__size", *keys))
    total = float(slim.agg(F.sum("__size")).first()[0] or 0)
    tree: dict = {}
    level = [(0, shards)] if total else []
    while nodes := [n for n in level if n[1] > 1]:
        _cut_level(slim, tree, nodes, keys, total, shards)
        level = [side for n in nodes for side in tree[n][2:]]
    scratch.drop(slim)
    out = placed.withColumn("shard", _place(tree, (0, shards), keys).cast("int")).withColumn("size", F.col("__size"))
    return out.drop("__size", "__same", *keys, *[f"__a{i}" for i in range(len(axes))])


def _position(axis: Column) -> Column:
    return F.floor(F.coalesce(axis, F.lit(0.0)) * ((1 << AXIS_BITS) - 1)).cast("long")


def _with_common_spots(df: DataFrame, scratch: Scratch, axes: int) -> DataFrame:
    """Equal texts with different metadata take the smallest position on each axis, so that they stand together. Only such
    texts are joined in; they are broadcast if they are few, else joined by hash."""
    names = [f"__a{i}" for i in range(axes)]
    ranges = df.groupBy("__same").agg(*[F.min(a).alias(f"{a}_lo") for a in names], *[F.max(a).alias(f"{a}_hi") for a in names])
    differ = ranges.where(" or ".join(f"{a}_lo < {a}_hi" for a in names)).select(F.col("__same").alias("__of"), *[f"{a}_lo" for a in names])
    differ = scratch.table(differ)
    n = differ.count()
    joined = df.join(F.broadcast(differ) if n <= MOST_BROADCAST else differ, F.col("__same") == F.col("__of"), "left")
    kept = [c for c in df.columns if c not in names]
    return joined.select(*kept, *[F.coalesce(f"{a}_lo", a).alias(a) for a in names])


def with_slots(df: DataFrame, order: list[Column], shard: str = "shard", rows: int | None = None) -> DataFrame:
    """Adds `slot` (long): gapless numbers from 0 within each shard, dealt in groups so that no task ranks a whole shard.

    Rows equal in all of `order` get different slots in any order.
    """
    rows = df.count() if rows is None else rows
    groups = max(1, math.ceil(rows / SLOT_ROWS))
    dealt = df.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy(shard, "__group").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(F.col(shard).alias("__shard"), F.col("__group").alias("__g"), (F.sum("__n").over(Window.partitionBy(shard).orderBy("__group")) - F.col("__n")).alias("__start"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(shard, "__group").orderBy(*order)))
    joined = ranked.join(starts, (F.col(shard) == F.col("__shard")) & (F.col("__group") == F.col("__g")), "left")
    return joined.withColumn("slot", F.col("__start") + F.col("__rank") - F.lit(1)).drop("__group", "__n", "__shard", "__g", "__start", "__rank")

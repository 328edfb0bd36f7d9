"""Exact nearest neighbours by an index of pivots, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.supersteps import Supersteps

#: Points of a block; pivots at most, whose vectors come to the driver.
BLOCK, MOST_PIVOTS = 2_000, 1_024
#: Points whose cells, or whose nearest among a block, a task decides on together.
STRIP = 512
#: Bytes of the blocks that a task holds to search in, and of those that it searches for.
HELD, ASKING = 64 << 20, 32 << 20


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot, from differences."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _sent(x: np.ndarray) -> bytes:
    """Coordinates as they are written and sent: of half the size where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return (small if np.array_equal(small, x, equal_nan=True) else x.astype("<f8")).tobytes()


def _read(v: bytes, n: int, width: int) -> np.ndarray:
    """n rows of what _sent() was given."""
    return np.frombuffer(v, "<f8" if len(v) == 8 * n * width else "<f4").reshape(n, width).astype(float)


def _may(d: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells may hold something within the bound, by distances to their pivots."""
    return (d - radius <= bound[:, None] + 1e-9 * (1 + d)) & np.isfinite(radius)


class _Nearest:
    """The k nearest that a block's points have met so far: (row, neighbour, distance) in `found`, of which those that were
    not there at the start are new."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, found: pd.DataFrame | None = None):
        self.ids, self.x, self.k, self.square = ids, x, k, (x**2).sum(1)
        self.found = pd.DataFrame({"row": np.empty(0, np.int64), "neighbour": ids[:0], "distance": np.empty(0)}) if found is None else found
        self.found["new"], self.bound = False, np.full(len(x), np.inf)
        self._bounds()

    def _bounds(self) -> None:
        full = self.found.groupby("row")["distance"].agg(["size", "max"])
        full = full[full["size"] >= self.k]
        self.bound[full.index.to_numpy(np.int64)] = full["max"].to_numpy()

    def meet(self, others: np.ndarray, y: np.ndarray, rows: np.ndarray) -> None:
        """The given rows meet the points y. Products tell who may be near; distances are taken from differences, so that equal
        points tie exactly."""
        square, out = (y**2).sum(1), []
        large = np.nanmax(square, initial=0.0)
        for start in range(0, len(rows), STRIP):
            some = rows[start : start + STRIP]
            d = self.square[some][:, None] + square - 2 * self.x[some] @ y.T
            last, open_ = self.bound[some] ** 2, np.flatnonzero(~np.isfinite(self.bound[some]))
            if len(open_):
                few = np.where(self.ids[some[open_]][:, None] == others, np.inf, d[open_])
                last[open_] = np.partition(few, min(self.k, len(y)) - 1, axis=1)[:, min(self.k, len(y)) - 1]
            slack = 1e-9 * (1 + self.square[some] + large)
            at, cols = np.nonzero((d <= (last + slack)[:, None]) & np.isfinite(d))
            at = some[at]
            apart = self.ids[at] != others[cols]
            at, cols = at[apart], cols[apart]
            exact = np.concatenate([np.empty(0), *[np.sqrt(((self.x[at[i : i + 8192]] - y[cols[i : i + 8192]]) ** 2).sum(1)) for i in range(0, len(at), 8192)]])
            near = exact <= self.bound[at]
            out.append(pd.DataFrame({"row": at[near], "neighbour": others[cols[near]], "distance": exact[near], "new": True}))
        met = pd.concat(out) if out else self.found[:0]
        if len(met):
            both = pd.concat([self.found[self.found["row"].isin(met["row"].unique())], met]) if len(self.found) else met
            kept = both.sort_values(["row", "distance", "neighbour"]).groupby("row").head(self.k)
            self.found = pd.concat([self.found[~self.found["row"].isin(met["row"].unique())], kept]) if len(self.found) else kept
            self._bounds()


class PivotIndex:
    """Points in cells around pivots, for exact searches.

    Each point belongs to its nearest pivot. Cells are packed into rows of about BLOCK points. A first search within a row gives
    each of its points an upper bound of its k-th distance; by the triangle inequality, a cell can hold something nearer only if
    the point's distance to its pivot, less the cell's radius, is no more than that. Only these cells are searched, so that the
    recall is 1. Packed rows meet in a cartesian product of their partitions, which reads them again instead of sending copies:
    a point is written a fixed number of times, however many cells it asks for. The driver holds pivots and a size and radius
    for each.
    """

    def __init__(self, points: DataFrame, id: str, vec: str):  # noqa: A002
        self.steps = Supersteps(points.sparkSession, "neighbours")
        self.kind = points.schema[id].dataType.simpleString()
        base = points.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        pivots = -(-base.count() * 2 // BLOCK)
        chosen = base.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_PIVOTS, pivots))).toPandas()
        self.pivots = np.stack(chosen["v"]).astype(float) if len(chosen) else np.zeros((1, 1))
        at = self.pivots

        def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                x = np.stack(pdf["v"]).astype(float) if len(pdf) else np.zeros((0, at.shape[1]))
                d = _distances(x, at)
                yield pdf.assign(v=[_sent(v) for v in x], cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

        self.cells = self.steps.table(base.mapInPandas(assigned, f"id {self.kind}, v binary, cell int, far double"))
        sizes = self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius")).toPandas()
        self.size, self.radius = np.zeros(len(at), np.int64), np.full(len(at), -np.inf)
        self.size[sizes["cell"]], self.radius[sizes["cell"]] = sizes["size"], sizes["radius"]

    def _blocks(self, k: int) -> DataFrame:
        """A row for each block: its points, whom each of them found near in it (row, id, neighbour, distance) and the cells
        that may hold nearer ones."""
        at, radius, size = self.pivots, self.radius, self.size
        each = np.maximum(1, -(-size // BLOCK))
        plan = [(int(c), int(first), int(n)) for c, first, n in zip(range(len(at)), np.cumsum(each) - each, each, strict=True)]
        plan = self.cells.sparkSession.createDataFrame(plan, "cell int, start int, blocks int")  # a row per pivot at most
        block = (F.col("start") + F.pmod(F.xxhash64("id"), "blocks")).cast("int").alias("block")

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, x, cell = pdf["id"].to_numpy(), np.concatenate([_read(v, 1, at.shape[1]) for v in pdf["v"]]), int(pdf["cell"].iloc[0])
            best = _Nearest(ids, x, k)
            best.meet(ids, x, np.arange(len(x)))
            targets = np.zeros(len(at), bool)
            for start in range(0, len(x), STRIP):
                targets |= _may(_distances(x[start : start + STRIP], at), radius, best.bound[start : start + STRIP]).any(axis=0)
            targets[cell] = each[cell] > 1
            found = best.found
            row = {"block": pdf["block"].iloc[0], "cell": cell, "ids": ids, "v": _sent(x), "rows": found["row"].to_numpy(np.int32), "who": ids[found["row"].to_numpy(np.int64)]}
            row |= {"near": found["neighbour"].to_numpy(), "far": found["distance"].to_numpy(), "targets": np.flatnonzero(targets).astype(np.int32)}
            return pd.DataFrame({c: [v] for c, v in row.items()})

        schema = f"block int, cell int, ids array<{self.kind}>, v binary, rows array<int>, who array<{self.kind}>, near array<{self.kind}>, far array<double>, targets array<int>"
        return self.steps.table(self.cells.join(F.broadcast(plan), "cell").select("id", "v", "cell", block).groupBy("block").applyInPandas(packed, schema))

    def _others(self, blocks: DataFrame, k: int) -> DataFrame:
        """(id, neighbour, distance): whom points found near in the other blocks of their targets."""
        at, radius, kind = self.pivots, self.radius, self.kind
        known = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
        wanted = max(4 * blocks.sparkSession.sparkContext.defaultParallelism, -(-known[1] // ASKING))
        asking = blocks.where(F.size("targets") > 0).drop("who").repartition(max(1, min(known[0], wanted)))
        held = blocks.select(F.col("block").alias("block_"), F.col("cell").alias("cell_"), F.col("ids").alias("ids_"), F.col("v").alias("v_")).repartition(max(1, -(-known[1] // HELD)))
        pairs = asking.join(held.hint("shuffle_replicate_nl"), F.array_contains("targets", F.col("cell_")) & (F.col("block") != F.col("block_")))

        def out(best: _Nearest) -> pd.DataFrame:
            new = best.found[best.found["new"].astype(bool)]
            return pd.DataFrame({"id": best.ids[new["row"].to_numpy(np.int64)], "neighbour": new["neighbour"].to_numpy(), "distance": new["distance"].to_numpy()})

        def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, best = None, None
            for pdf in frames:  # a block's pairs follow each other
                for r in pdf.itertuples(index=False):
                    if block != r.block:
                        if best is not None:
                            yield out(best)
                        found = pd.DataFrame({"row": np.asarray(r.rows, np.int64), "neighbour": r.near, "distance": np.asarray(r.far, float)})
                        block, best = r.block, _Nearest(np.asarray(r.ids), _read(r.v, len(r.ids), at.shape[1]), k, found)
                    d = _distances(best.x, at[r.cell_ : r.cell_ + 1])
                    rows = np.flatnonzero(_may(d, radius[r.cell_ : r.cell_ + 1], best.bound)[:, 0])
                    best.meet(np.asarray(r.ids_), _read(r.v_, len(r.ids_), at.shape[1]), rows)
            if best is not None:
                yield out(best)

        columns = ["block", "ids", "v", "rows", "near", "far", "cell_", "ids_", "v_"]
        return pairs.select(*columns).mapInPandas(searched, f"id {kind}, neighbour {kind}, distance double")

    def _asks(self, bounds: DataFrame) -> DataFrame:
        """(id, targets): the cells beside its own that can hold one of a point's nearest; bound is null without one.

        A point has one row, whatever the number of cells, and only numbers of cells come out of Python beside it.
        """
        at, radius = self.pivots, self.radius

        def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for start in range(0, len(pdf), STRIP):
                    part = pdf.iloc[start : start + STRIP]
                    d = _distances(np.concatenate([_read(v, 1, at.shape[1]) for v in part["v"]]), at)
                    bound = part["bound"].fillna(np.inf).to_numpy(float)
                    may = _may(d, radius, bound) & (part["cell"].to_numpy()[:, None] != np.arange(len(at))[None, :])
                    yield pd.DataFrame({"id": part["id"], "targets": [np.flatnonzero(m).astype(np.int32) for m in may]})

        source = self.cells.join(bounds, "id", "left").select("id", "v", "cell", "bound")
        return source.mapInPandas(asked, f"id {self.kind}, targets array<int>")

    def search(self, k: int) -> tuple[DataFrame, DataFrame]:
        """(id, neighbour, distance, rank) of each point's k nearest others, and (compared): pairs whose distance is taken at
        most, a row for those of a cell and one for those of several."""
        w = Window.partitionBy("id").orderBy("distance", "neighbour")
        blocks = self._blocks(k)
        first = blocks.select(F.inline(F.arrays_zip("who", "near", "far"))).toDF("id", "neighbour", "distance")
        both = first.unionByName(self._others(blocks, k)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        bounds = first.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
        sizes = blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"))
        away = self._asks(bounds).select(F.explode("targets").alias("cell")).join(F.broadcast(sizes), "cell")
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias("compared")
        # Written, as it may be read more than once.
        return self.steps.table(both), sizes.agg(total(F.col("n") * F.col("n"))).unionAll(away.agg(total("n")))


def knn_pairs(points: DataFrame, id: str, vec: str, k: int) -> DataFrame:  # noqa: A002
    """(id, neighbour, distance, rank): each point's k nearest others by Euclidean distance, ties by id; all others if fewer.

    Exact, by a PivotIndex: on clustered points the pairs compared grow far slower than the square of the rows; where no cell
    can be ruled out, all rows meet in blocks. A task holds HELD bytes of points and two blocks; what is written grows with the
    rows, and by at most k pairs a point for each HELD bytes.
    """
    return PivotIndex(points, id, vec).search(k)[0]


def symmetric_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst): every neighbour pair in both directions, a row per direction and pair."""
    one, two = (F.struct(F.col(s).alias("src"), F.col(d).alias("dst")) for s, d in (("id", "neighbour"), ("neighbour", "id")))
    return pairs.select(F.inline(F.array(one, two)))


def propagate(features: DataFrame, edges: DataFrame, columns: list[str], rounds: int = 2, distinct: bool = True) -> DataFrame:
    """(id, columns): degree-normalised averaging over neighbours and oneself, `rounds` times (edges src, dst in both directions,
    made distinct unless the caller has done so).

    A link's weight is 1 / sqrt(degree of one end * degree of the other), so values are divided by the root of their own
    point's degree before they go over the links and after: links meet one table of points a round and carry no weight. The
    links, the degrees and each round's result are written once, so that rounds do not add to one plan.
    """
    steps = Supersteps(features.sparkSession, "propagate")
    now = steps.table(features.select("id", *columns))
    pairs = edges.distinct() if distinct else edges
    loops = steps.table(pairs.select("src", "dst").unionByName(now.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    degree = steps.table(loops.groupBy(F.col("src").alias("id")).agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("root")))
    for _ in range(rounds):
        sent = now.join(degree, "id").select(F.col("id").alias("dst"), *[(F.col(c) / F.col("root")).alias(c) for c in columns])
        met = loops.join(sent, "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(c).alias(c) for c in columns])
        now = steps.table(met.join(degree, "id").select("id", *[(F.col(c) / F.col("root")).alias(c) for c in columns]))
    return now

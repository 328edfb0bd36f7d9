"""Causal operators on event time: rows in any order over batches, as long as they come before the watermark passes them.

Each stream's rows wait in state until the watermark has passed them and are then worked off in time order, so that results
don't depend on how rows fell into batches. State holds the rows of the allowed lateness and a few numbers for each stream; it
lives in RocksDB, which the session has to name as its state store (`use_rocksdb`). Rows that come later than the watermark of
the batch before are dropped by Spark. A stream whose rows are more than `idle` apart ends there and begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Hands each stream's rows (t in microseconds, tie, x) over in order of (t, tie), once the watermark has passed t.

    Subclasses give PAST, the schema of what they keep, FRESH, its values at a stream's begin, scan(), which works off rows of
    one unbroken run, and closed(), what a stream's end puts out.
    """

    PAST: str
    FRESH: tuple

    def __init__(self, tie: str, idle: int | None):
        self.tie, self.idle = tie, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"t long, tie {self.tie}, x double")
        self.past = handle.getValueState("past", f"last long, {self.PAST}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows if len(pdf) for r in zip(pdf["gf_t"].tolist(), pdf["gf_tie"].tolist(), pdf["gf_x"].tolist(), strict=True)]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        passed = watermark * 1000
        waiting = [*self.pending.get(), *new] if self.pending.exists() else new
        ready = sorted(r for r in waiting if r[0] <= passed)
        rest = [r for r in waiting if r[0] > passed]
        if ready and rest:
            self.pending.put(rest)
        elif ready:
            self.pending.clear()
        elif new:
            self.pending.appendList(new)
        last, *state = self.past.get() if self.past.exists() else (None, *self.FRESH)
        out = []
        if ready:
            t = np.array([r[0] for r in ready])
            ties, x = [r[1] for r in ready], np.array([r[2] for r in ready], float)
            gaps = np.diff(t, prepend=t[0] if last is None else last)
            starts = [0, *np.flatnonzero(gaps > self.idle).tolist()] if self.idle is not None else [0]
            for at, end in zip(starts, [*starts[1:], len(t)], strict=True):
                if self.idle is not None and gaps[at] > self.idle:
                    out.append(self.closed(state))
                    state = list(self.FRESH)
                if end > at:
                    state, made = self.scan(state, t[at:end], ties[at:end], x[at:end])
                    out.append(made)
            last = int(t[-1])
        if last is not None and self.idle is not None and passed > last + self.idle and not rest:
            out.append(self.closed(state))
            self.past.clear()
            last = None
        elif ready:
            self.past.update((last, *state))
        self._wake(rest, last)
        for made in out:
            if made is not None and len(made):
                yield made.assign(**{f"gf_k{i}": v for i, v in enumerate(key)})

    def _wake(self, rest: list[tuple], last: int | None) -> None:
        """One timer a stream: when the watermark passes its next row, or its end by idleness. Timers fire when the watermark
        is later than they are, in milliseconds."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000) - 1)
        elif last is not None and self.idle is not None:
            self.handle.registerTimer((last + self.idle) // 1000 + 1)

    def scan(self, state: list, t: np.ndarray, ties: list, x: np.ndarray) -> tuple[list, pd.DataFrame]:
        raise NotImplementedError

    def closed(self, state: list) -> pd.DataFrame | None:
        return None

    def close(self) -> None:
        pass


class Scores(InOrder):
    """Each value standardised by the stream's earlier ones (0 for the first four), averaged over the last three."""

    PAST, FRESH = "n long, mean double, m2 double, z1 double, z2 double", (0, 0.0, 0.0, 0.0, 0.0)

    def scan(self, state, t, ties, x):
        n, mean, m2, z1, z2 = state
        # Sums around the mean so far (around the first value where there is none), so that squares keep their digits.
        middle = mean if n else float(x[0])
        d = x - middle
        count = n + np.arange(len(x) + 1)
        total, square = np.append(0.0, np.cumsum(d)), m2 + np.append(0.0, np.cumsum(d * d))
        shift = total / np.maximum(count, 1)
        spread = np.maximum(0.0, square - total * shift)
        z = np.where(count[:-1] < 4, 0.0, (d - shift[:-1]) / (np.sqrt(spread[:-1] / np.maximum(count[:-1], 1)) + 1e-9))
        wide = np.concatenate([[z2, z1], z])
        score = (wide[2:] + wide[1:-1] + wide[:-2]) / np.minimum(count[:-1] + 1, 3)
        kept = [int(count[-1]), float(middle + shift[-1]), float(spread[-1]), float(wide[-1]), float(wide[-2])]
        return kept, pd.DataFrame({"gf_t": t, "gf_tie": ties, "gf_score": score})


class Episodes(InOrder):
    """Runs of values at or above a threshold; put out when a value falls below it or the stream ends."""

    PAST, FRESH = "started long, ended long", (-1, -1)

    def __init__(self, tie: str, idle: int | None, threshold: float):
        super().__init__(tie, idle)
        self.threshold = threshold

    def scan(self, state, t, ties, x):
        started, ended = state
        on = np.concatenate([[ended >= 0], x >= self.threshold])
        up, down = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
        begun = np.concatenate([[started] if ended >= 0 else [], t[up]]).astype(np.int64)
        before = np.concatenate([[ended], t])  # an episode ends with the step before the one that is below
        done = pd.DataFrame({"gf_started": begun[: len(down)], "gf_ended": before[down]})
        return ([int(begun[-1]), int(t[-1])] if on[-1] else [-1, -1]), done

    def closed(self, state):
        return pd.DataFrame({"gf_started": [state[0]], "gf_ended": [state[1]]}) if state[1] >= 0 else None


def _run(df: DataFrame, key: list[str], at: str, tie: str, value: str, late: str, made: InOrder, columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    marked = df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).withWatermark(at, late)
    # Frames are built from named tuples, which rename columns that begin with an underscore.
    keys = [F.col(k).alias(f"gf_k{i}") for i, k in enumerate(key)]
    slim = marked.select(*keys, F.col(at).alias("gf_at"), F.unix_micros(at).alias("gf_t"), F.col(tie).alias("gf_tie"), F.col(value).cast("double").alias("gf_x"))
    schema = columns + "".join(f", gf_k{i} {kinds[k]}" for i, k in enumerate(key))
    out = slim.groupBy(*[f"gf_k{i}" for i in range(len(key))]).transformWithStateInPandas(made, schema, "Append", "EventTime")
    return out.withColumnsRenamed({f"gf_k{i}": k for i, k in enumerate(key)})


def event_time_scores(df: DataFrame, key: list[str], at: str, tie: str, value: str, late: str = "1 hour", idle: int | None = None) -> DataFrame:
    """(key, at, tie, score) of a stream of rows, in order of (at, tie) within each key whatever the order of arrival.

    `at` is a timestamp later than the epoch (the watermark of a query that has seen nothing), `tie` tells rows of one time apart and isn't null, `idle` is in microseconds. Rows
    without a time or value are left out, equal rows each count; rows after the last watermark wait for a later one.
    """
    kind = dict(df.dtypes)[tie]
    out = _run(df, key, at, tie, value, late, Scores(kind, idle), f"gf_t long, gf_tie {kind}, gf_score double")
    return out.select(*key, F.timestamp_micros("gf_t").alias(at), F.col("gf_tie").alias(tie), F.col("gf_score").alias("score"))


def event_time_episodes(df: DataFrame, key: list[str], at: str, tie: str, score: str, threshold: float, late: str = "1 hour", idle: int | None = None) -> DataFrame:
    """(key, started, ended): episodes of scores at or above the threshold; `ended` is the time of the last such score. See
    event_time_scores() for order, late and odd rows. Episodes that are still open wait for a later watermark."""
    kind = dict(df.dtypes)[tie]
    out = _run(df, key, at, tie, score, late, Episodes(kind, idle, threshold), "gf_started long, gf_ended long")
    return out.select(*key, F.timestamp_micros("gf_started").alias("started"), F.timestamp_micros("gf_ended").alias("ended"))

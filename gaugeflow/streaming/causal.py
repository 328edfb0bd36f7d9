"""Streaming twins of the causal operators: what a batch window computes, with state per stream.

State is kept by key and grows with the number of streams, not with their length; keys without news time out, unless idle
is None. A query with a timeout never ends by itself, as it always waits for the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.operators.aggregates import sensor_aggregates


def stream_sensor_aggregates(readings: DataFrame, step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """sensor_aggregates() of readings (network_id, ts, channel, value) in tumbling windows; later ones than `late` are dropped."""
    marked = readings.withWatermark("ts", late).withColumn("w", F.window("ts", step))
    return sensor_aggregates(marked, ["network_id", "w"]).withColumn("window_start", F.col("w.start")).drop("w")


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def stream_causal_score(df: DataFrame, key: str, order: str, value: str, idle: int | None = 86_400_000) -> DataFrame:
    """(key, order, score): each value standardised by the stream's earlier ones (0 for the first four), averaged over
    the last three. A stream's rows have to arrive in order from batch to batch; within one they are sorted."""

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2, z1, z2 = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in pdf[value].astype(float):
            z = 0.0 if n < 4 else (x - mean) / (np.sqrt(max(0.0, m2 / n)) + 1e-9)
            last = [z2, z1, z][-min(n + 1, 3) :]
            out.append(sum(last) / len(last))
            z2, z1, n = z1, z, n + 1
            gap = x - mean
            mean += gap / n
            m2 += gap * (x - mean)
        state.update((n, float(mean), float(m2), float(z1), float(z2)))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: names[0], order: pdf[order].to_numpy(), "score": out})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, score double", "n long, mean double, m2 double, z1 double, z2 double", "append", _timeout(idle))


def stream_alarm_episodes(df: DataFrame, key: str, order: str, score: str, threshold: float, idle: int | None = 86_400_000) -> DataFrame:
    """(key, started, ended): an episode is emitted when a score falls below the threshold again, or when its stream has
    been idle; ended is the last step at or above it."""
    kinds = dict(df.dtypes)

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last = state.get if state.exists else (float("nan"), float("nan"))
        closed = []
        if state.hasTimedOut:
            if started == started:
                closed.append((started, last))
            state.remove()
        else:
            for t, s in pd.concat(list(batches)).sort_values(order)[[order, score]].itertuples(index=False):
                if s >= threshold:
                    started, last = (t if started != started else started), t
                elif started == started:
                    closed.append((started, last))
                    started = last = float("nan")
            state.update((float(started), float(last)))
            if idle is not None:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: [names[0]] * len(closed), "started": [float(a) for a, _ in closed], "ended": [float(b) for _, b in closed]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, started double, ended double", "started double, last double", "append", _timeout(idle))

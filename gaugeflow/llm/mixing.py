"""Mixing to target weights by soft membership.

A classifier learnt from the labelled table gives every document its posterior p over domains. Nonnegative rates minimise

    |sum(share * rate * p) - target|^2 + ridge * sum(share * (rate - 1)^2)

over all documents, where share is a document's part of all tokens. At the minimum every rate is a gradient step of length
1 / ridge from 1, projected to 0 and more: max(0, 1 - p . gap / ridge), where gap is what the domain totals are off. So the
rates of any number of documents follow from one small vector. It is found by passes over a slim table, each of which sums
the totals and their slopes at a trial vector; Newton's method picks the next one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import add_columns
from gaugeflow.llm._hashing import _LOWER, as_bytes
from gaugeflow.llm._scratch import Scratch

#: Domains in order, and the share of tokens each shall have.
TARGET = {"high": 0.7, "low": 0.3, "toxic": 0.0}
#: Hashed byte trigrams that describe a text, and labelled rows the classifier learns from at most, by hash of the id.
FEATURES, TRAIN_ROWS = 1024, 8_000
#: Weight of staying near rate 1 against meeting the targets. Without any, a target that no mixture meets (such as a toxic
#: share of 0, as no posterior is 0) is approached best by two documents, repeated endlessly.
RIDGE = 1e-4
#: Trial vectors at most for a ridge, and the error of the domain shares at which they end.
STEPS, ENOUGH = 40, 1e-9
#: Bytes of text, and texts, looked at together.
PIECE, ROWS = 1 << 18, 512


def features(texts: list[bytes | None]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, a row per text; zeros for empty ones."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and (not group or size + len(texts[at + len(group)] or b"") <= PIECE):
            group.append(texts[at + len(group)] or b"")
            size += len(group[-1])
        for part in range(0, max(1, size), PIECE):  # more than one only for a single long text
            pieces = group if len(group) > 1 or size <= PIECE else [group[0][part : part + PIECE + 2]]
            buf = _LOWER[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.uint32)
            if len(buf) > 2:
                gram = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
                slot = (gram * np.uint32(2654435761)) >> np.uint32(22)
                owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
                whole = owner[:-2] == owner[2:]
                sums = np.bincount(owner[:-2][whole] * FEATURES + slot[whole], minlength=len(pieces) * FEATURES)
                out[at : at + len(pieces)] += sums.reshape(-1, FEATURES)
            if pieces is group:
                break
        at += len(group)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def _halves(texts: list[bytes | None]) -> pa.Array:
    return pa.array([r.tobytes() for at in range(0, len(texts), ROWS) for r in features(texts[at : at + ROWS]).astype(np.float16)], pa.binary())


@dataclass
class Mixture:
    """What places a document: the classifier, and what the domain shares are off."""

    weights: np.ndarray
    gap: np.ndarray
    ridge: float = RIDGE

    def posterior(self, texts: list[bytes | None]) -> np.ndarray:
        out = [np.empty((0, self.weights.shape[1]))]
        for at in range(0, len(texts), ROWS):
            z = features(texts[at : at + ROWS]) @ self.weights[:-1] + self.weights[-1]
            e = np.exp((z - z.max(axis=1, keepdims=True)).astype(np.float64))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def rate(self, posterior: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - posterior @ self.gap / self.ridge)


def _learn(x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """Softmax regression by accelerated gradient descent with a small ridge; the last row holds the intercepts."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    w = v = np.zeros((x.shape[1], kinds), x.dtype)
    if not len(x):
        return w
    goal = np.eye(kinds, dtype=x.dtype)[y]
    rate, last = 1.0, 1.0  # a row's squared length is 2 at most, a softmax's curvature 1/2
    for _ in range(300):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        after = v - rate * (x.T @ (p - goal) / len(x) + 1e-5 * v)
        momentum = (1 + math.sqrt(1 + 4 * last * last)) / 2
        v, w, last = after + (last - 1) / momentum * (after - w), after, momentum
    return w


def _tokens(texts: list[bytes | None]) -> pa.Array:
    """Words between white space."""
    return pa.array([len((t or b"").split()) for t in texts], pa.int64())


def _members(mixture: Mixture, text: str):
    def compute():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = as_bytes(batch.column(text))
            p = mixture.posterior(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            return [_tokens(texts), flat, pa.array(mixture.rate(p))]

        return of

    return compute


def fit_mixture(df: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, id: str = "doc_id", text: str = "text", ridge: float = RIDGE) -> Mixture:  # noqa: A002
    """The mixture whose expected token totals are target shares of df's tokens, as nearly as rates >= 0 and the ridge allow.

    Labelled rows are toxic where `toxic` is 1, else high or low by `quality`; null labels and ids are left out, repeated
    ids count once. At most TRAIN_ROWS of them are learnt from. Without labels all posteriors are equal.
    """
    goal = np.array(list((target or TARGET).values()))
    known = labels.where(F.col(id).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    known = known.select("__id", F.when(F.col("t") == 1, 2).when(F.col("q") == 1, 0).otherwise(1).alias("kind"))
    n, share = known.count(), 1.0
    while n > TRAIN_ROWS:
        share *= 0.98 * TRAIN_ROWS / n
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        n = known.count()
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = docs.join(F.broadcast(known), F.col("id") == F.col("__id")).select("kind", "text")
    seen = add_columns(rows, "x binary", lambda: lambda b: [_halves(as_bytes(b.column("text")))], ["kind"]).toPandas()
    x = np.stack([np.frombuffer(r, np.float16) for r in seen["x"]]).astype(np.float32) if len(seen) else np.empty((0, FEATURES), np.float32)
    mixture = Mixture(_learn(x, seen["kind"].to_numpy(int), len(goal)), np.zeros(len(goal)), ridge)

    scratch = Scratch(df.sparkSession, "mixing")
    slim = scratch.table(add_columns(docs.select("text"), "n bigint, p array<double>, rate double", _members(mixture, "text"), []).select("n", "p").where("n > 0"))
    tokens = slim.agg(F.sum("n")).first()[0]
    if tokens:
        now = 1.0
        while now > ridge:
            mixture.gap = _solved(slim, tokens, goal / goal.sum(), mixture.gap, now)
            now /= 10
        mixture.gap = _solved(slim, tokens, goal / goal.sum(), mixture.gap, ridge)
    scratch.drop(slim)
    return mixture


def _solved(slim: DataFrame, tokens: int, goal: np.ndarray, gap: np.ndarray, ridge: float) -> np.ndarray:
    """The vector whose rates leave just this gap, by Newton steps from another ridge's; a step is halved until the dual
    objective falls. All that a pass brings to the driver is a few numbers."""
    k = len(goal)

    def at(trial: np.ndarray):
        parts = slim.mapInArrow(_sums(trial, ridge), "sums array<double>")
        row = np.array(parts.agg(*[F.sum(F.col("sums")[i]) for i in range(k + k * k + 1)]).first(), dtype=float) / tokens
        total, slope, square = row[:k], row[k:-1].reshape(k, k), row[-1]
        return trial + goal - total, slope, trial @ trial / 2 + trial @ goal + ridge / 2 * square

    error, slope, value = at(gap)
    for _ in range(STEPS):
        if np.abs(error).max() <= ENOUGH:
            break
        step, length = np.linalg.solve(np.eye(k) + slope / ridge, error), 1.0
        while True:
            trial = at(gap - length * step)
            if trial[2] <= value - 1e-4 * length * (error @ step) + 1e-12 * (1 + abs(value)) or length < 1e-6:
                break
            length /= 2
        if length < 1e-6:  # as near as sums of doubles tell
            break
        gap = gap - length * step
        error, slope, value = trial
    return gap


def _sums(gap: np.ndarray, ridge: float):
    """Of a task's documents: tokens by domain at the rates, their slopes, and the square of the rates by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(gap)
        sums = np.zeros(k + k * k + 1)
        for batch in batches:
            p, n = batch.column("p").flatten().to_numpy().reshape(-1, k), batch.column("n").to_numpy()
            rate = np.maximum(0.0, 1.0 - p @ gap / ridge)
            on = p * (n * (rate > 0))[:, None]
            sums += np.concatenate(((n * rate) @ p, (on.T @ p).ravel(), [(n * rate) @ rate]))
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

    return run


def with_rates(df: DataFrame, mixture: Mixture, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:  # noqa: A002
    """Adds n_tokens, posterior (array<double>, by TARGET's order), rate and copies (int) to df's columns.

    copies is rate rounded up or down by a hash of id and text, so that its expectation is the rate; columns of these names
    are replaced. Null and empty texts have the classifier's intercepts as posterior and no tokens.
    """
    out = add_columns(df, "n_tokens bigint, posterior array<double>, rate double", _members(mixture, text), None if keep is None else [*keep, id, text])
    chance = F.pmod(F.xxhash64(F.lit("copies"), id, text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(df: DataFrame, mixture: Mixture, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """df's rows as often as their copies say, with df's columns."""
    return with_rates(df, mixture, id, text).where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select(*df.columns)

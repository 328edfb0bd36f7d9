"""Quality by a regularised quadratic discriminant over document statistics.

Each text becomes a few numbers (shares of kinds of characters, their worst window, repetition of words and lines, lengths),
transformed to be near normal. A class has a mean and a covariance, shrunk towards the pooled one and its diagonal; the
evidence is the difference of the two log-densities, by Mahalanobis distances with Cholesky factors kept in the model, and
becomes a probability by a logistic curve. What is learnt comes from sums over all labelled rows, added up in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import add_columns, bounded
from gaugeflow.llm._hashing import SPACED, as_bytes, word_hashes
from gaugeflow.llm._scratch import Scratch
from gaugeflow.llm.toxicity import calibrated_curve, held_out

#: Bytes of a window, and of a text looked at together.
WINDOW, PIECE = 96, 1 << 18
#: From this score on, predicted is 1.
CUT = 0.3
#: Statistics are kept within so many standard deviations.
REACH = 6.0
#: Weights tried of the pooled covariance in a class's, and of the diagonal in the result.
POOLED, DIAGONAL = (0.02, 0.1, 0.3, 0.7), (0.01, 0.05, 0.2, 0.6)
#: Cells of the histogram of evidence from which the curve is fitted, over -EDGE to EDGE.
CELLS, EDGE = 4096, 60.0

#: Kinds of bytes: blank, line end, digit, lower case, upper case, beyond ASCII, mark of sentences, other symbol, control.
KINDS = 9
_KIND = np.full(256, 8, np.uint8)
_KIND[[0x09, 0x20]] = 0
_KIND[[0x0A, 0x0D]] = 1
_KIND[0x21:0x7F] = 7
_KIND[0x30:0x3A] = 2
_KIND[0x61:0x7B] = 3
_KIND[0x41:0x5B] = 4
_KIND[0x80:] = 5
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 6
_ODD, _UPPER = np.isin(np.arange(9), (2, 7, 8)), np.arange(9) == 4
NAMES = ("length", "blank", "line_end", "digit", "upper", "beyond", "mark", "symbol", "control", "worst_symbol", "worst_upper", "words", "word_size", "distinct", "commonest", "same_next", "lines_distinct", "line_size")


def _worst(flags: np.ndarray, lead: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest share of flags in a window of WINDOW bytes (all bytes of a shorter text), and the bytes to go on from."""
    joined = np.concatenate((lead, flags))
    run = np.concatenate(([0], np.cumsum(joined)))
    if len(joined) <= WINDOW:
        return float(run[-1]) / max(1, len(joined)), joined
    return float((run[WINDOW:] - run[:-WINDOW]).max()) / WINDOW, joined[-WINDOW + 1 :]


def _raw(text: bytes, words: np.ndarray) -> list[float]:
    counts, worst = np.zeros(KINDS), [0.0, 0.0]
    leads = [np.zeros(0, bool)] * 2
    lines: dict[int, int] = {}
    for at in range(0, len(text), PIECE):
        kinds = _KIND[np.frombuffer(text[at : at + PIECE], np.uint8)]
        counts += np.bincount(kinds, minlength=KINDS)
        for i, kind in enumerate((_ODD, _UPPER)):
            found, leads[i] = _worst(kind[kinds], leads[i])
            worst[i] = found if at == 0 else max(worst[i], found)
    for line in text.split(b"\n"):
        lines[hash(line)] = lines.get(hash(line), 0) + 1
    size, n, n_lines = len(text), len(words), sum(lines.values())
    _, often = np.unique(words, return_counts=True)
    same = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    share = counts / max(1, size)
    logit = lambda p, m: float(np.log((p * m + 0.5) / ((1 - p) * m + 0.5)))
    return [
        float(np.log1p(size)), *[float(np.sqrt(share[k])) for k in (0, 1, 2, 4, 5, 6, 7, 8)], *worst, float(np.log1p(n)), float(np.log1p(size / max(1, n))),
        logit(len(often) / max(1, n), n), float(np.sqrt(often.max() / n)) if n else 0.0, float(np.sqrt(same)), logit(len(lines) / n_lines, n_lines), float(np.log1p(size / n_lines)),
    ]


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of transformed statistics per text; null counts as empty. Long texts are read whole, in pieces."""
    rows = [_raw(t or b"", w) for t, w in zip(texts, word_hashes(texts, SPACED), strict=True)]
    return np.array(rows, float).reshape(len(rows), len(NAMES))


def _statistics(text: str):
    def compute():
        return lambda batch: [pa.array(list(statistics(as_bytes(batch.column(text)))), pa.list_(pa.float64()))]

    return compute


@dataclass
class Sums:
    """Number, sum and sum of products of the rows of each class, about an origin."""

    n: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray]]) -> Sums:
        d = len(NAMES)
        out = cls(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)))
        for k, cells in rows:
            out.n[k], out.first[k], out.second[k] = cells[0], cells[1 : 1 + d], cells[1 + d :].reshape(d, d)
        return out


class Discriminant:
    """Two normal densities with shrunk covariances; their Cholesky factors' inverses are kept."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, sums: Sums, pooled: float, diagonal: float):
        """sums are of rows standardised by centre and scale."""
        self.centre, self.scale = centre, scale
        self.slope, self.shift = 1.0, 0.0
        d, total = len(centre), max(1.0, sums.n.sum())
        self.means = sums.first / np.maximum(1, sums.n)[:, None]
        scatter = sums.second - sums.n[:, None, None] * self.means[:, :, None] * self.means[:, None, :]
        common = scatter.sum(axis=0) / total
        self.log_prior = np.log((sums.n + 1) / (total + 2))
        self.inverse, self.log_size = [], []
        for k in (0, 1):
            own = (1 - pooled) * scatter[k] / max(1.0, sums.n[k]) + pooled * common
            shrunk = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-3 * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            self.inverse.append(np.linalg.inv(factor))
            self.log_size.append(float(np.log(np.diag(factor)).sum()))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -REACH, REACH)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, priors included."""
        z, out = self.standard(x), []
        for k in (0, 1):
            distance = (z - self.means[k]) @ self.inverse[k].T
            out.append(self.log_prior[k] - self.log_size[k] - 0.5 * (distance**2).sum(axis=1))
        return out[1] - out[0]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
    return x, batch.column("kind").to_numpy()


def _cells(rows: DataFrame, compute, width: int) -> list[tuple[int, np.ndarray]]:
    """(key, cells) summed over all rows: each task sends one row per key of a fixed number of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, cells in compute(*_rows(batch)):
                total[key] = total.get(key, 0) + cells
        columns = [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "cells"])

    cells = rows.mapInArrow(run, "key int, cells array<double>").select("key", F.posexplode("cells").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r["key"], np.zeros(width))[r["i"]] = r["v"]
    return sorted(out.items())


def _by_kind(x: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k in np.unique(kind).tolist():
        own = x[kind == k]
        yield k, np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))


def _losses(models: list[Discriminant]):
    def compute(x: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i, model in enumerate(models):
            e = np.clip(model.evidence(x), -EDGE, EDGE)
            cell = np.minimum(((e + EDGE) / (2 * EDGE) * CELLS).astype(int), CELLS - 1)
            yield i, np.bincount(cell * 2 + kind, minlength=2 * CELLS).astype(float)

    return compute


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Discriminant:  # noqa: A002
    """The model of the labels that may be learnt, all of them: of repeated ids the larger label.

    Means, covariances and evidence are summed in Spark; the driver sees one row of sums per class, and a histogram of
    evidence per pair of shrinkage weights. Four fifths of the rows make the densities; the others choose the weights and
    the curve, each row by its hash, so that no row is in both.
    """
    scratch = Scratch(bounded(df.sparkSession), "quality")
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("kind"))
    seen = add_columns(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "x array<double>", _statistics("text"), ["id"])
    tune = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    rows = scratch.table(seen.join(known, "id").select("kind", "x", tune.alias("tune")))
    d = len(NAMES)
    width = 1 + d + d * d
    raw = Sums.of(_cells(rows.where("not tune"), _by_kind, width))
    total = max(1.0, raw.n.sum())
    centre = raw.first.sum(axis=0) / total
    spread = np.sqrt(np.maximum(0, np.einsum("kii->i", raw.second) / total - centre**2))
    scale = np.where(spread > 1e-9, spread, 1.0)
    plain = lambda x, kind: _by_kind(np.clip((x - centre) / scale, -REACH, REACH), kind)
    sums = Sums.of(_cells(rows.where("not tune"), plain, width))
    models = [Discriminant(centre, scale, sums, p, g) for p in POOLED for g in DIAGONAL]
    found = dict(_cells(rows.where("tune"), _losses(models), 2 * CELLS))
    scratch.drop(rows)
    at = (np.arange(CELLS) + 0.5) / CELLS * 2 * EDGE - EDGE
    best, chosen = np.inf, models[0]
    for i, model in enumerate(models):
        counts = found.get(i, np.zeros(2 * CELLS)).reshape(CELLS, 2)
        used = counts.sum(axis=1) > 0
        curve = calibrated_curve(np.repeat(at[used], 2), np.tile([0.0, 1.0], int(used.sum())), counts[used].ravel())
        if curve is None:
            continue
        model.slope, model.shift = curve
        p = np.clip(model.probability(at), 1e-9, 1 - 1e-9)
        loss = -(counts[:, 1] * np.log(p) + counts[:, 0] * np.log(1 - p)).sum()
        if loss < best:
            best, chosen = loss, model
    return chosen


def _score(model: Discriminant, text: str):
    def compute():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            found = model.evidence(statistics(as_bytes(batch.column(text))))
            return [pa.array(found), pa.array(model.probability(found))]

        return of

    return compute


def score_quality(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None) -> DataFrame:  # noqa: A002
    """df's columns named in keep (all, if None) with held_out, evidence, score and predicted; predicted is 1 where score >= CUT.

    Only the text is an input of a score. Ids whose crc32 (as text, null as "") is 0 mod 5 are held out: their labels are not
    used. Null and empty texts get the score of an empty text. Without labels of both kinds the densities are equal but for
    what was seen, and the curve is the plain logistic one. Repeated rows each get the same score. Columns of the added names
    are replaced.
    """
    scored = add_columns(df, "evidence double, score double", _score(fit(df, labels, id, text, label), text), keep)
    return scored.withColumn("held_out", held_out(F.col(id))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))

"""Toxicity by two Kneser-Ney models over byte n-grams, one of toxic and one of ordinary documents.

Highest-order counts belong to a class; all lower orders are continuation counts of the whole corpus, shared by both
models, so that expressions rare in either class differ by what the class adds only. A document's evidence is the largest
length-normalised difference of the two log-likelihoods over windows of WINDOW bytes: one passage is enough, whatever the
document's length. Evidence becomes a probability by a logistic curve, fitted on labelled rows that no count has seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import add_columns, bounded, slices
from gaugeflow.llm._hashing import _LOWER, as_bytes

#: Bytes of an n-gram, bytes of a window, and the discount of both models.
ORDER, WINDOW, DISCOUNT = 4, 24, 0.75
#: Labelled rows used at most: a sample by hash of the id beyond that. They are broadcast, 16 bytes each.
TRAIN_ROWS = 200_000
#: n-grams of the labelled rows in a block of the model at most, or those of 256 contexts; 4 bytes each and 52 a context are broadcast.
BLOCK_GRAMS = 2_000_000
#: Bytes of text looked at together.
PIECE = 1 << 18


@dataclass
class _Part:
    """Part of a text in a buffer: its place, the bytes before its own that are there as context only, and whether the text
    begins and ends with it."""

    owner: int
    start: int
    lead: int
    end: int
    first: bool
    last: bool


def _pieces(texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, list[_Part]]]:
    """Buffers of texts with blanks around them, and what lies where. Long texts come in parts; each part repeats so much of
    the one before that every n-gram and window that ends in its own bytes is whole."""
    group: list[bytes] = []
    parts: list[_Part] = []
    size, gap = 0, b" " * (WINDOW + ORDER)
    joined = lambda: (_LOWER[np.frombuffer(gap + b"".join(x + gap for x in group), np.uint8)], parts)
    for i, text in enumerate(texts):
        text = text or b""
        for at in range(0, max(1, len(text)), PIECE):
            lead = min(at, WINDOW + ORDER - 2)
            piece = text[at - lead : at + PIECE]
            if group and size + len(piece) > PIECE:
                yield joined()
                group, parts, size = [], [], 0
            start = len(gap) + size
            parts.append(_Part(i, start, lead, start + len(piece), at == 0, at + PIECE >= len(text)))
            group.append(piece)
            size += len(piece) + len(gap)
    if group:
        yield joined()


def _codes(buf: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte."""
    out = np.zeros(len(buf), np.uint32)
    for back in range(ORDER):
        out[ORDER - 1 :] |= buf[ORDER - 1 - back : len(buf) - back].astype(np.uint32) << np.uint32(8 * back)
    return out


def _between(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """Which of n places lie in one of the runs."""
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    at, sums = 0, np.zeros((len(grams), 3), np.int64)
    for g, c in found:
        sums[place[at : at + len(g)]] += c
        at += len(g)
    return grams, sums


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, ordinary, toxic) of a task; kind is 0 or 1 in labelled rows, else null."""
    found, fresh = [(np.empty(0, np.uint32), np.empty((0, 3), np.int64))], 0
    for batch in slices(batches):
        kinds = batch.column("kind").fill_null(2).to_numpy()
        for buf, parts in _pieces(as_bytes(batch.column("text"))):
            codes = _codes(buf)[_between(len(buf), [p.start + p.lead for p in parts], [p.end for p in parts])]
            kind = np.repeat(kinds[[p.owner for p in parts]], [p.end - p.start - p.lead for p in parts])
            grams, total = np.unique(codes, return_counts=True)
            by_kind = [np.bincount(np.searchsorted(grams, codes[kind == k]), minlength=len(grams)) for k in (0, 1)]
            found.append((grams, np.stack((total, *by_kind), axis=1)))
            fresh += len(grams)
            if fresh > len(found[0][0]):  # as much again as there was
                found, fresh = [_merged(found)], 0
    grams, counts = _merged(found)
    yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(3)]], ["gram", "n", "ordinary", "toxic"])


def _shared(grams: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities of the longest shared order, from continuation counts down to single bytes."""
    orders = [(grams, types)]
    for n in range(ORDER - 2, 0, -1):
        orders.append(np.unique(orders[-1][0] & ((1 << 8 * n) - 1), return_counts=True))
    known, p = np.arange(1), np.array([1 / 256])
    for n, (g, c) in enumerate(orders[::-1], 1):
        _, at = np.unique(g >> 8, return_inverse=True)
        total, kinds = np.bincount(at, c), np.bincount(at)
        below = p[np.searchsorted(known, g & ((1 << 8 * (n - 1)) - 1))]
        known, p = g, np.maximum(c - DISCOUNT, 0) / total[at] + DISCOUNT * kinds[at] / total[at] * below
    return known, p


class Block:
    """Log-likelihood differences of a range of contexts. Every n-gram counted in labelled rows has a value, every other
    n-gram under a context of theirs has the context's; contexts that no labelled row has differ by 0."""

    def __init__(self, first: int, last: int, grams: np.ndarray, counts: np.ndarray, shared: tuple[np.ndarray, np.ndarray]):
        """grams of the contexts from first to before last, sorted, with their (ordinary, toxic) counts."""
        contexts, at = np.unique(grams >> 8, return_inverse=True)
        suffix = grams & ((1 << 8 * (ORDER - 1)) - 1)
        below = shared[1][np.searchsorted(shared[0], suffix)] if len(grams) else np.empty(0)
        by_class, backoff = [], []
        for k in (0, 1):
            c = counts[:, k].astype(float)
            total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, c > 0, len(contexts))
            free = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            by_class.append(np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1) + free[at] * below)
            backoff.append(free)
        self.first, self.last = first, last
        self.contexts = (contexts - first).astype(np.int32)
        # Row of each context by pages of 256 contexts; page 0 and all else unknown lead to row 0.
        pages, on = np.unique(self.contexts >> 8, return_inverse=True)
        self.pages = np.zeros(last - first >> 8, np.int32)
        self.pages[pages] = np.arange(1, len(pages) + 1)
        self.rows = np.zeros((len(pages) + 1, 256), np.int32)
        self.rows[on + 1, self.contexts & 255] = np.arange(1, len(contexts) + 1)
        # Row 0 is that of unknown contexts; unseen in both, what both classes back off to is the same.
        self.unseen = np.append(0, np.log(backoff[1] / backoff[0])).astype(np.float32)
        self.values = np.append(np.log(by_class[1] / by_class[0]), 0).astype(np.float32)
        # Which bytes a context has, as four words of bits, and how many n-grams stand before each word.
        word, bit = (at + 1) * 4 + (grams >> 6 & 3), np.uint64(1) << (grams & 63).astype(np.uint64)
        self.seen = np.zeros(len(self.unseen) * 4, np.uint64)
        np.bitwise_or.at(self.seen, word, bit)
        self.before = np.append(0, np.cumsum(np.bincount(word, minlength=len(self.seen)))[:-1]).astype(np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The differences of n-grams whose contexts are in the range."""
        row = self.rows[self.pages[(codes >> np.uint32(16)) - np.uint32(self.first >> 8)], codes >> np.uint32(8) & np.uint32(255)]
        word = row * 4 + (codes >> np.uint32(6) & np.uint32(3)).astype(np.int32)
        bit = np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64)
        seen = self.seen[word]
        place = self.before[word] + np.bitwise_count(seen & (bit - np.uint64(1)))
        return np.where(seen & bit, self.values[np.minimum(place, len(self.values) - 1)], self.unseen[row])


class Model:
    """The blocks (broadcast) of all contexts and the curve."""

    def __init__(self, blocks: list):
        self.blocks = blocks
        self.slope, self.shift = 8.0, -6.0

    def differences(self, codes: np.ndarray) -> np.ndarray:
        if len(self.blocks) == 1:
            return self.blocks[0].value.of(codes)
        out, context = np.zeros(len(codes), np.float32), codes >> np.uint32(8)
        for shared in self.blocks:
            block = shared.value
            inside = np.flatnonzero((context >= block.first) & (context < block.last))
            out[inside] = block.of(codes[inside])
        return out

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        """For each text the largest mean difference over its windows; texts shorter than a window count as filled up with zeros."""
        out = np.full(len(texts), -np.inf)
        for buf, parts in _pieces(texts):
            # Of a part that continues a text, the first n-grams aren't whole; blanks around texts stay 0.
            known = _between(len(buf), [p.start + (0 if p.first else ORDER - 1) for p in parts], [p.end for p in parts])
            run = np.concatenate(([0.0], np.cumsum(self.differences(_codes(buf)) * known, dtype=np.float64)))
            window = (run[WINDOW:] - run[:-WINDOW]) / WINDOW
            # Windows that end in a part's own bytes, and behind the text's last part those that still begin in it.
            ends = np.array([(p.start + p.lead - WINDOW + 1, p.end if p.last else p.end - WINDOW + 1) for p in parts]).ravel()
            np.maximum.at(out, [p.owner for p in parts], np.maximum.reduceat(window, ends)[::2])
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def calibrated_curve(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float] | None:
    """Slope and shift of a ridge-regularised logistic curve, by Newton steps; None if it doesn't rise or a label is missing."""
    weight = np.ones(len(label)) if weight is None else weight
    if not (weight[label == 1].sum() > 0 and weight[label == 0].sum() > 0):
        return None
    x = np.stack((evidence, np.ones(len(evidence))), axis=1)
    w, ridge = np.zeros(2), np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - label)) + ridge * w)
        w = w - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else None


def _score(model: Model, text: str):
    def compute():
        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            found = model.evidence(as_bytes(batch.column(text)))
            return [pa.array(found), pa.array(model.probability(found))]

        return of

    return compute


def held_out(id: Column) -> Column:  # noqa: A002
    """Rows from which no label is learnt."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(5)) == 0


def training_labels(labels: DataFrame, id: str = "doc_id", label: str = "toxic") -> DataFrame:  # noqa: A002
    """(id, kind, tune): one row per labelled id outside the held-out ones, at most TRAIN_ROWS of them, sampled by hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("kind"))
    n = known.count()
    share = 1.0
    while n > TRAIN_ROWS:
        share *= 0.98 * TRAIN_ROWS / n
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        n = known.count()
    return known.withColumn("tune", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 4)


def _ranges(tops: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Ranges of contexts that cover them all, with BLOCK_GRAMS n-grams at most or one top (256 contexts)."""
    cuts, size = [0], 0
    for top, c in zip(tops, counts, strict=True):
        if size and size + c > BLOCK_GRAMS:
            cuts.append(top << 8)
            size = 0
        size += c
    return list(zip(cuts, [*cuts[1:], 1 << 8 * (ORDER - 1)], strict=True))


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:  # noqa: A002
    """The model of all documents' texts and of the labels that may be learnt. Rows without a label count for the shared
    orders. All n-grams of the labelled rows are in the model; blocks of about BLOCK_GRAMS of them come to the driver one
    after another and are broadcast, besides at most 256**3 shared trigrams."""
    spark = bounded(df.sparkSession)
    known = training_labels(labels, id, label)
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    marked = docs.join(F.broadcast(known), "id", "left").select("text", F.when(~F.col("tune"), F.col("kind")).alias("kind"))
    counts = marked.mapInArrow(_count, "gram bigint, n bigint, ordinary bigint, toxic bigint").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).persist()
    try:
        lower = counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * (ORDER - 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("types")).toPandas().sort_values("gram")
        shared = _shared(lower["gram"].to_numpy(np.int64), lower["types"].to_numpy())
        used = counts.where("ordinary + toxic > 0")
        sizes = used.groupBy(F.shiftright("gram", 16).alias("top")).agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values("top")
        blocks = []
        for first, last in _ranges(sizes["top"].tolist(), sizes["c"].tolist()):
            part = used.where(F.col("gram").between(first << 8, (last << 8) - 1)).select("gram", "ordinary", "toxic").toPandas().sort_values("gram")
            blocks.append(spark.sparkContext.broadcast(Block(first, last, part["gram"].to_numpy(np.int64), part[["ordinary", "toxic"]].to_numpy(), shared)))
    finally:
        counts.unpersist()
    model = Model(blocks)
    tune = docs.join(F.broadcast(known.where("tune")), "id").select(F.col("kind").cast("long").alias("id"), "text")
    seen = add_columns(tune, "evidence double, score double", _score(model, "text"), ["id"]).toPandas()
    if curve := calibrated_curve(seen["evidence"].to_numpy(), seen["id"].to_numpy(float)):
        model.slope, model.shift = curve
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None) -> DataFrame:  # noqa: A002
    """df's columns named in keep (all, if None) with held_out, evidence, score and predicted; predicted is 1 where score >= 0.5.

    Only the text is an input of a score. Ids whose crc32 (as text, null as "") is 0 mod 5 are held out: their labels are not used.
    Null and empty texts have evidence 0. Without usable labels of both kinds a fixed curve holds. Long texts are read
    whole, in pieces; repeated rows each get the same score. Columns of the added names are replaced.
    """
    scored = add_columns(df, "evidence double, score double", _score(fit(df, labels, id, text, label), text), None if keep is None else keep)
    return scored.withColumn("held_out", held_out(F.col(id))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

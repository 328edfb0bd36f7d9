"""Exact removal of byte strings that occur more than once, by column-wise multi-document suffix sorting around anchors.

Inserting one symbol per document each round takes as many rounds as the longest document has bytes, each over the whole
collection. So the collection is cut first: every string of LENGTH bytes holds an anchor, the smallest of its hashed
k-grams, and equal strings hold the same. The documents that are sorted are the anchors' neighbourhoods, of at most
2 * LENGTH - GRAM bytes: the rounds are as many, whatever the texts' length. Each round inserts the next symbol (a column)
of all neighbourhoods of a block, updating their order and the common prefixes of neighbours in it; a neighbour with LENGTH
bytes in common is a repeat that begins at that column.

Neighbourhoods that occur whole more than once are counted by hash and need no sorting. Anchors with very many different
neighbourhoods are shared over tasks by the hashes of their strings, packed, instead of being sorted in one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import slices
from gaugeflow.llm._hashing import _BASE, _BYTE, _INVERSE, _powers, as_bytes, mix
from gaugeflow.llm._packed import BLOCK, pack_sets, shared_members
from gaugeflow.llm._scratch import Scratch

#: Bytes of a string that may occur once only, and of an anchor.
LENGTH, GRAM = 400, 64
#: Bytes of a text looked at together.
PIECE = 1 << 18
#: Neighbourhoods sorted in one block; an anchor with more is shared over tasks.
SORTED, SHARED = 20_000, 5_000


def _running(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=out[1:])
    return out


def _strings(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of buf[starts:ends]."""
    return mix((run[ends] - run[starts]) * _powers(_INVERSE, len(run))[starts] + (ends - starts).astype(np.uint64))


def anchors(buf: np.ndarray, run: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Places of the anchors: in each window of length bytes the gram with the smallest hash, the rightmost of equal ones."""
    n = len(buf) - gram + 1
    starts = np.arange(n)
    places = np.uint64(0xFFFFFF) - starts.astype(np.uint64)
    low = (_strings(run, starts, starts + gram) & np.uint64(0xFFFFFFFFFF000000)) | places
    have, width = 1, length - gram + 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    fresh = np.concatenate(([True], low[1:] != low[:-1]))
    return (np.uint64(0xFFFFFF) - (low[fresh] & np.uint64(0xFFFFFF))).astype(np.int64)


def _anchor_rows(length: int, gram: int):
    """A row per anchor: its hash, where it is, how far its neighbourhood reaches and that one's hash."""
    before, after = length - gram, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for key, text in zip(batch.column("key").to_numpy(), as_bytes(batch.column("text")), strict=True):
                n, last = len(text or b""), -1
                for at in range(0, max(0, n - length + 1), PIECE):
                    # Windows that begin in this piece, with what their anchors' neighbourhoods reach on both sides.
                    lead, end = max(0, at - before), min(n, at + PIECE + 3 * length)
                    buf = np.frombuffer(text, np.uint8, end - lead, lead)
                    sums = _running(buf)
                    inner = min(n, at + PIECE + length - 1)
                    f = anchors(buf[at - lead : inner - lead], sums[at - lead : inner - lead + 1] - sums[at - lead], length, gram) if at == lead else _shifted(buf, at - lead, inner - lead, length, gram)
                    f = f + (at - lead)
                    f = f[f + lead > last]  # the last anchor of a piece may be the first of the next
                    last = int(f[-1]) + lead if len(f) else last
                    s, e = np.maximum(f - before, 0), np.minimum(f + after, len(buf))
                    left = f - s
                    values = (_strings(sums, f, f + gram), np.full(len(f), key), f + lead, left, e - f, mix(_strings(sums, s, e) + left.astype(np.uint64)))
                    for x, v in zip(out, values, strict=True):
                        x.append(v)
            cat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(cat[0].view(np.int64)), pa.array(cat[1]), pa.array(cat[2]), pa.array(cat[3].astype(np.int32)), pa.array(cat[4].astype(np.int32)), pa.array(cat[5].view(np.int64))], ["anchor", "key", "at", "left", "right", "around"])

    return run


def _shifted(buf: np.ndarray, a: int, b: int, length: int, gram: int) -> np.ndarray:
    part = buf[a:b]
    return anchors(part, _running(part), length, gram)


def column_repeats(groups: np.ndarray, texts: list[bytes], lefts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text the places where a string of `length` bytes begins that another text of its group has at the same
    distance from the anchor (lefts bytes into it).

    Rounds go from the last column to the first. `order` holds the texts by group and by what they have from the column
    on, `common` the bytes (up to length) that each has in common with the one before it in that order.
    """
    m = len(texts)
    before = int(lefts.max())
    width = before + max(len(t) - left for t, left in zip(texts, lefts.tolist(), strict=True))
    symbols = np.full((width, m), 256, np.int16)  # 256: beyond the text
    for i, (t, left) in enumerate(zip(texts, lefts.tolist(), strict=True)):
        symbols[before - left : before - left + len(t), i] = np.frombuffer(t, np.uint8)
    _, rank = np.unique(groups, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    group = rank.astype(np.int64) * 257
    common = np.zeros(m + 1, np.int32)
    found: list[list[int]] = [[] for _ in range(m)]
    for column in range(width - 1, -1, -1):
        symbol = symbols[column][order]
        key = group[order] + symbol
        place = np.argsort(key, kind="stable")
        after = key[place]
        same = np.flatnonzero((after[1:] == after[:-1]) & (symbol[place[1:]] != 256)) + 1
        fresh = np.zeros(m + 1, np.int32)
        if len(same):
            # What two neighbours share further on is the least that lay between them before this round.
            spans = np.stack((place[same - 1] + 1, place[same] + 1), axis=1).ravel()
            fresh[same] = np.minimum(np.minimum.reduceat(common, spans)[::2] + 1, length)
        order, common = order[place], fresh
        if column <= width - length:
            full = np.flatnonzero(common[:m] >= length)
            for i in np.unique(np.concatenate((full, full - 1))).tolist():
                found[order[i]].append(column)
    return [np.array(f[::-1], np.int64) - (before - left) for f, left in zip(found, lefts.tolist(), strict=True)]


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Starts of repeated strings as runs of bytes."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


_SPANS = "key bigint, s bigint, e bigint"


def _span_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    k, s, e = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["key", "s", "e"])


def _sorted_blocks(length: int):
    """Rows come ordered by anchor; blocks end between anchors."""

    def solve(block: list[dict]) -> pa.RecordBatch:
        places = column_repeats(np.array([r["anchor"] for r in block]), [r["bytes"] for r in block], np.array([r["left"] for r in block]), length)
        return _span_batch([(r["key"], r["at"] - r["left"] + s, r["at"] - r["left"] + e) for r, p in zip(block, places, strict=True) if r["n"] == 1 for s, e in _covered(p, length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        for batch in slices(batches):
            for row in batch.to_pylist():
                if len(block) >= SORTED and row["anchor"] != block[-1]["anchor"]:
                    yield solve(block)
                    block = []
                block.append(row)
        if block:
            yield solve(block)

    return run


def _window_hashes(anchor: int, text: bytes, left: int, length: int) -> np.ndarray:
    """Hashes of the strings of a neighbourhood, different for each anchor and distance from it: a string may hold several
    anchors, or one of them at several places, and is then in several neighbourhoods without being there twice."""
    buf = np.frombuffer(text, np.uint8)
    starts = np.arange(len(buf) - length + 1)
    return mix((_strings(_running(buf), starts, starts + length) ^ np.uint64(anchor % (1 << 64))) + (starts - left).astype(np.uint64))


def _contexts(length: int, gram: int):
    """Neighbourhoods cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for key, text, wanted in zip(batch.column("key").to_pylist(), as_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    rows.append((w["anchor"], key, w["at"], w["left"], w["around"], w["n"], w["many"], text[w["at"] - w["left"] : w["at"] + w["right"]]))
            names = ["anchor", "key", "at", "left", "around", "n", "many", "bytes"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _packed_windows(length: int, bits: int):
    def members(batch: pa.RecordBatch):
        for anchor, around, left, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "around", "left", "bytes")), strict=True):
            yield around, np.unique(_window_hashes(anchor, text, left, length))

    return pack_sets(members, bits)


def _marked(length: int):
    """Of a neighbourhood the strings whose hashes others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                shared = np.array(r["members"], np.int64).view(np.uint64)
                starts = np.flatnonzero(np.isin(_window_hashes(r["anchor"], r["bytes"], r["left"], length), shared))
                rows += [(r["key"], r["at"] - r["left"] + s, r["at"] - r["left"] + e) for s, e in _covered(starts, length)]
            yield _span_batch(rows)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, removed, counts, digests = [], [], [], []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            digest, at, gone, n = hashlib.sha256(), 0, 0, 0
            for s, e in _union([(x["s"], x["e"]) for x in spans or []]):
                digest.update(text[at:s])
                at, gone, n = e, gone + e - s, n + 1
            digest.update(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            counts.append(n)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _keyed(df: DataFrame, id: str, text: str) -> DataFrame:  # noqa: A002
    """Rows by the hash of their text: equal texts have equal repeats."""
    return df.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))


def _differing(around: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, w): the neighbourhoods of anchors that have several. Their anchors are written first: Spark splits a crowded
    key of a join only where both sides come to it without an aggregate of the same key in between."""
    kinds = scratch.table(around.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    return around.join(kinds, "anchor").select("one.key", F.struct("anchor", "around", "n", "one.at", "one.left", "one.right", (F.col("kinds") > SHARED).alias("many")).alias("w"))


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """(key, spans): for each text (xxhash64) with bytes covered by a string of `length` bytes that also begins elsewhere,
    in it or in another row, those bytes as array of (s, e); spans may overlap. Null and short texts have none."""
    spark = df.sparkSession
    scratch = Scratch(spark, "column-dedup")
    docs = _keyed(df, id, text)
    rows = scratch.table(docs.select("key", "text").mapInArrow(_anchor_rows(length, gram), "anchor bigint, key bigint, at bigint, left int, right int, around bigint"))
    around = scratch.table(rows.groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at", "left", "right")).alias("one")))
    whole = rows.join(around.where("n > 1").select("around"), "around", "left_semi").select("key", (F.col("at") - F.col("left")).alias("s"), (F.col("at") + F.col("right")).alias("e")).where(F.col("e") - F.col("s") >= length).distinct()

    wanted = _differing(around, scratch)
    lists = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    firsts = docs.groupBy("key").agg(F.min("id").alias("first"))
    picked = lists.join(firsts, "key").select(F.col("key").alias("k"), "first", "wanted")
    texts = docs.join(picked, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("first"))).select("key", "text", "wanted")
    kind = "anchor bigint, key bigint, at bigint, left int, around bigint, n bigint, many boolean, bytes binary"
    contexts = scratch.table(texts.mapInArrow(_contexts(length, gram), kind))

    few = contexts.where("not many").dropDuplicates(["anchor", "around"])
    sorted_out = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_blocks(length), _SPANS)
    many = contexts.where("many").dropDuplicates(["anchor", "around"])
    count = many.count()
    spans = whole.union(sorted_out)
    if count:
        bits = max(0, count * (length - gram) // BLOCK).bit_length()
        members = shared_members(many.select("anchor", "around", "left", "bytes").mapInArrow(_packed_windows(length, bits), "range int, blob binary"), bits)
        spans = spans.union(many.where("n = 1").join(members.withColumnRenamed("key", "around"), "around").select("anchor", "key", "at", "left", "bytes", "members").mapInArrow(_marked(length), _SPANS))
    return scratch.table(spans.distinct().groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of df, as its UTF-8 bytes stand after removing every byte
    covered by a string of `length` bytes that also begins elsewhere, in the same row or another.

    All is judged on the input. Null counts as empty; texts shorter than `length` stay whole; repeated rows repeat each
    other, so they go whole if long enough. Texts and strings are told apart by 64-bit hashes where they aren't sorted.
    """
    docs = _keyed(df, id, text)
    spans = repeated_spans(df, length, gram, id, text).withColumnRenamed("key", "k")
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.join(spans, F.col("key") == F.col("k"), "left").select("id", "text", "spans").mapInArrow(_cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id)

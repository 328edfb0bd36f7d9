"""Substring deduplication by content-defined chunks: a gear hash over the last 32 bytes ends chunks, equal digests repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import slices
from gaugeflow.llm._hashing import as_bytes
from gaugeflow.llm._scratch import Scratch

#: Bytes of a chunk: at least, at most; beyond the least, one place in 2**CUT_BITS ends it.
LEAST, MOST, CUT_BITS = 40, 512, 5
#: Bytes hashed at once.
PIECE = 1 << 18
#: Chunk rows handed on at once.
ROWS = 20_000

_GEAR = np.random.default_rng(97).integers(1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text. A place's hash covers the 32 bytes before it, so that cuts move with the content."""
    ends: list[int] = []
    n, start, at = len(text), 0, 0
    while at < n:
        lead = max(0, at - 31)
        buf = np.frombuffer(text, np.uint8, min(n, at + PIECE) - lead, lead)
        h = _GEAR[buf]
        for shift in (1, 2, 4, 8, 16):  # h[i] becomes the sum of the gears of 2 * shift bytes, older ones shifted further
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift)) if len(h) > shift else h[shift:]
        for end in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + lead + 1).tolist():
            if end <= at:
                continue
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end - start >= LEAST:
                start = end
                ends.append(end)
        at = min(n, at + PIECE)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk. Chunks below LEAST (only a text's last one can be) say too little by themselves: they are digested with
    the chunk before and an end mark, so that endings go with what they end, and copies of whole texts go whole."""
    ids, digests, starts, lengths = [], [], [], []

    def batch_of(kind: pa.DataType) -> pa.RecordBatch:
        pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if digests else np.empty((0, 2), np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32())], ["id", "d0", "d1", "start", "length"])
        for x in (ids, digests, starts, lengths):
            x.clear()
        return out

    kind = None
    for batch in slices(batches):
        kind = batch.column("id").type
        for doc, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            start = before = 0
            for end in cut_points(text or b""):
                ids.append(doc)
                short = end - start < LEAST
                digests.append(hashlib.blake2b(text[before if short else start : end], digest_size=16, person=b"end" if short else b"").digest())
                starts.append(start)
                lengths.append(end - start)
                before, start = start, end
            if len(ids) >= ROWS:
                yield batch_of(kind)
    if ids:
        yield batch_of(kind)


def repeated_chunks(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """(id, n_bytes, n_repeats, n_removed, spans): for each id the chunks that stand earlier elsewhere, by id and place.

    spans are (start, length) in UTF-8 bytes, sorted. The first place of each chunk stays; of later copies of a text nothing
    stays. Rows that share an id count as
    one document: what they repeat is summed, n_bytes too. Null ids come after all others and share a row. Null and
    empty texts have no chunks. Digests have 128 bits. Chunks are counted before the shuffle, and only those of two
    places or more are joined back, on their digest; adaptive skew joins split a digest that very many documents hold.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    chunks = docs.mapInArrow(_chunks, "id bigint, d0 bigint, d1 bigint, start bigint, length int")
    scratch = Scratch(df.sparkSession, "chunk-dedup")
    rows = scratch.table(chunks.withColumn("id", F.coalesce("id", F.lit((1 << 63) - 1))))
    many = rows.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "start")).alias("first")).where("c > 1").drop("c")
    later = rows.join(many, ["d0", "d1"]).where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
    found = later.groupBy("id").agg(F.count(F.lit(1)).alias("n_repeats"), F.sum("length").alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    sizes = docs.groupBy(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n_bytes"))
    whole = sizes.join(found, "id", "left")
    none = F.array().cast("array<struct<start:bigint,length:int>>")
    return whole.select(F.when(F.col("id") != (1 << 63) - 1, F.col("id")).alias(id), "n_bytes", F.coalesce("n_repeats", F.lit(0)).cast("long").alias("n_repeats"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", none).alias("spans"))

"""Benchmark decontamination by winnowing.

Of every 9 consecutive 5-gram hashes of words the smallest is kept, on both sides; any shared run of 13 words therefore
shares a kept hash. From each shared hash a hit is extended to the windows that hold it. The benchmark is looked up in blocks of a fixed
number of words, each checked before it is broadcast; texts are neither shuffled nor collected, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import add_columns, bounded, slices
from gaugeflow.llm._hashing import ALNUM, as_bytes, shingles, word_hashes

#: Words of a benchmark window, of a hashed gram, and hashes of which the smallest is kept: WINDOW = GRAM + KEEP_OF - 1.
WINDOW, GRAM, KEEP_OF = 13, 5, 9
#: Words of a benchmark segment; segments of one item overlap, so that every window lies in one.
SEGMENT = 4096
#: Words of a benchmark block at most (8 bytes each when broadcast, as much again for its fingerprints).
BLOCK_WORDS = 1_000_000


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def fingerprint_places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept grams of a word sequence; equal minima of a window are all kept."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = shingles(words, GRAM)
    low = _sliding(grams, KEEP_OF, np.minimum)
    pad = np.zeros(KEEP_OF - 1, np.uint64)
    kept = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), KEEP_OF, np.maximum) == grams)
    return kept, grams[kept]


def _grams_at(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` words from each start on, as shingles() has them."""
    return shingles(words[starts[:, None] + np.arange(width)].T, width)[0] if len(starts) else np.empty(0, np.uint64)


def _place(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in sorted values each wanted one is, if it is there."""
    return np.minimum(np.searchsorted(ordered, wanted), max(0, len(ordered) - 1))


class _Index:
    """Hashes, sorted, with their owners."""

    def __init__(self, hashes: np.ndarray, owners: np.ndarray):
        pairs = np.unique(np.rec.fromarrays((hashes, owners), names="h,o"))
        self.hashes, first = np.unique(pairs["h"], return_index=True)
        self.owners, self.at = pairs["o"], np.append(first, len(pairs))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Which are there, and the owners of those."""
        place = _place(self.hashes, wanted)
        known = self.hashes[place] == wanted if len(self.hashes) else np.zeros(len(wanted), bool)
        return known, sorted({int(o) for x in np.unique(place[known]) for o in self.owners[self.at[x] : self.at[x + 1]]}) if known.any() else []


class _Block:
    """Benchmark segments: their fingerprints, and their windows with the items that have them."""

    def __init__(self, segments: list[tuple[str, np.ndarray]]):
        self.items = sorted({name for name, _ in segments})
        number = {name: i for i, name in enumerate(self.items)}
        prints: list[np.ndarray] = [np.empty(0, np.uint64)]
        windows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, words in segments:
            width = min(WINDOW, len(words))
            windows.setdefault(width, []).append((shingles(words, width), number[name]))
            if width == WINDOW:
                prints.append(fingerprint_places(words)[1])
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {w: _Index(np.concatenate([h for h, _ in x]), np.repeat([i for _, i in x], [len(h) for h, _ in x])) for w, x in windows.items()}

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of document words inside windows, and the items whose windows occur.

        Around each fingerprint that the benchmark has too, all windows that hold it are looked up, each once; equal words
        in a row make no pairs of places.
        """
        runs, items = [], set()
        for width, index in self.windows.items():
            if len(words) < width:
                continue
            starts = np.arange(len(words) - width + 1)
            if width == WINDOW:
                places, hashes = fingerprint_places(words)
                near = places[self.prints[_place(self.prints, hashes)] == hashes] if len(self.prints) else places[:0]
                if not len(near):
                    continue
                starts = np.unique(np.clip(near[:, None] - np.arange(KEEP_OF), 0, len(starts) - 1))
            known, owners = index.find(_grams_at(words, starts, width))
            runs += _runs(starts[known], width)
            items.update(self.items[o] for o in owners)
        return runs, items


def _runs(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """What windows of a width cover, from their sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist(), strict=True))


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, blobs = [], []
        for item, words in zip(batch.column("id").to_pylist(), word_hashes(as_bytes(batch.column("text")), ALNUM), strict=True):
            for start in range(0, max(1, len(words) - WINDOW + 1), SEGMENT):
                if len(part := words[start : start + SEGMENT + WINDOW - 1]):
                    ids.append(item)
                    blobs.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(blobs, pa.binary())], ["item", "words"])


def _lookup(shared, text: str, first: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def compute():
        block = _Block([(item, np.frombuffer(raw, np.uint64)) for item, raw in shared.value])

        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            runs, items, counts = [], [], []
            old = [(None, None)] * batch.num_rows if first else zip(batch.column("hit_runs").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for words, (had, whose) in zip(word_hashes(as_bytes(batch.column(text)), ALNUM), old, strict=True):
                r, names = block.hits(words)
                runs.append([{"start": s, "end": e} for s, e in _merge(r + [(x["start"], x["end"]) for x in had or []])])
                items.append(sorted(names | set(whose or [])))
                counts.append(len(words))
            return [pa.array(counts, pa.int64()), pa.array(runs, span), pa.array(items, pa.list_(pa.string()))]

        return of

    return compute


def _blocks(segments: DataFrame, total: int) -> Iterator[list[tuple[str, bytes]]]:
    """The segments in blocks of BLOCK_WORDS words at most: more blocks are made until that holds."""
    n = -(-total // BLOCK_WORDS) or 1
    while True:
        dealt = segments.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(F.octet_length("words")).alias("b")).agg(F.max("b")).first()[0] or 0
        if n == 1 or most <= BLOCK_WORDS * 8:
            break
        n *= 2
    for i in range(n):
        yield [(r["item"], bytes(r["words"])) for r in dealt.where(F.col("block") == i).select("item", "words").collect()]


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns named in keep (all, if None) with n_words, n_hit, hit_runs, items and contaminated.

    Words are runs of letters and digits (all beyond ASCII counts as a letter), A-Z lower-cased. A window is 13 consecutive
    words of an item; an item with fewer, but some, is one window. A word inside any occurrence of a window is hit;
    contaminated if n_hit > 0 and 20 * n_hit >= n_words. items holds the ids (as strings, sorted) of items of which a window
    occurs; a null id counts as "". Null and empty texts have no words. Rows are kept as they are, repeated ones too; an
    empty benchmark hits nothing. Words are compared by 64-bit hashes. Columns of the added names are replaced.
    """
    bounded(df.sparkSession)
    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    segments = source.mapInArrow(_segments, "item string, words binary").distinct()
    total = (segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 8
    blocks = list(_broadcast_blocks(df.sparkSession, segments, total))
    added = ["n_words", "hit_runs", "items"]
    wanted = [c for c in (df.columns if keep is None else keep) if c not in added]
    out = df.select(*dict.fromkeys([*wanted, text]))
    for i, shared in enumerate(blocks):
        carried = wanted if i == len(blocks) - 1 else [*wanted, text]
        out = add_columns(out, "n_words bigint, hit_runs array<struct<start:bigint,end:bigint>>, items array<string>", _lookup(shared, text, i == 0), carried)
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _broadcast_blocks(spark, segments: DataFrame, total: int):
    for block in _blocks(segments, total):
        yield spark.sparkContext.broadcast(block)

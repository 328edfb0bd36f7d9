"""Similarity join on word n-gram sets by rare-first prefix filtering.

1. Texts with equal n-gram sets form a class; all that follows works on classes.
2. N-grams travel in packed, sorted blocks, a block per batch of texts and range of hashes, so that document frequencies
   of all n-grams cost one shuffle of about ten bytes each. N-grams of one class alone can't link and don't come back.
3. Each class orders what is left rarest first; its prefix holds what any partner must share one of.
4. Prefix n-grams first link every class to one hub of each n-gram. What is then connected needs no more pairs; classes of
   different components that share a prefix n-gram are paired by length and position, each pair once.
5. Pairs pass a suffix filter, then their sets are compared.
6. Where many classes share an n-gram, no pairs are made: they meet under its hub, in pairs of blocks of bounded size, and
   each block pair counts what its sets share by a product of incidence matrices. Only links leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import slices
from gaugeflow.llm._graph import components
from gaugeflow.llm._hashing import SPACED, as_bytes, shingles, word_hashes
from gaugeflow.llm._packed import BLOCK, by_set, lists, pack_sets, shared_blocks
from gaugeflow.llm._scratch import Scratch

#: Ranges into which the suffix filter divides two sets.
SUFFIX_PARTS = 16
#: Classes of an n-gram beyond which they meet in blocks; classes and n-grams of a block at most, about.
CROWD, CROWD_BLOCK, CROWD_GRAMS = 32, 1_000, 1_000_000
#: Columns of an incidence matrix.
COLUMNS = 2_048


def _class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _gram_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for words in word_hashes(as_bytes(batch.column("text")), SPACED):
        yield np.unique(shingles(words, width))


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [(len(g), _class_of(g) if len(g) else None) for g in _gram_sets(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array([n for n, _ in sets], pa.int64()), pa.array([k for _, k in sets], pa.int64())], ["id", "text_hash", "n_shingles", "key"])

    return run


def _blocks(width: int, bits: int):
    """Packs each batch's n-grams, a row for each range of hashes."""
    return pack_sets(lambda batch: ((_class_of(g), g) for g in _gram_sets(batch, width) if len(g)), bits)


def _prefixes(num: int, den: int):
    """Of one range of classes: each class that may have partners, with its prefix and all its shared n-grams."""

    def run(table: pa.Table) -> pa.Table:
        grams, keys, sizes, starts = by_set(table)
        ends = np.append(starts[1:], len(keys))
        size = sizes[starts].astype(np.int64)
        alone = size - (ends - starts)
        take = np.minimum(size - (-(-num * size // den)) + 1 - alone, ends - starts)
        use = take > 0
        heads = [grams[s : s + t] for s, t in zip(starts[use], take[use], strict=True)]
        rests = [np.sort(grams[s:e]) for s, e in zip(starts[use], ends[use], strict=True)]
        return pa.table({"key": keys[starts[use]], "n": size[use], "alone": alone[use], "prefix": lists(heads), "grams": lists(rests)})

    return run


def _linked(num: int, den: int):
    """Of pairs with their shared n-grams, those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("grams_a", "grams_b"):
                column = batch.column(name)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)))
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            need = -(-num * sizes // (num + den))
            keep = np.zeros(batch.num_rows, dtype=bool)
            edges = np.arange(1, SUFFIX_PARTS, dtype=np.uint64) * np.uint64((1 << 64) // SUFFIX_PARTS)
            for i in range(batch.num_rows):
                a, b = (values[at[i] : at[i + 1]] for at, values in sides)
                # Suffix filter: sets that share enough can't differ too much in any division of the hash range.
                apart = np.abs(np.diff(np.searchsorted(a, edges), prepend=0, append=len(a)) - np.diff(np.searchsorted(b, edges), prepend=0, append=len(b))).sum()
                if (len(a) + len(b) - apart) // 2 < need[i]:
                    continue
                keep[i] = len(np.intersect1d(a, b, assume_unique=True)) >= need[i]
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], ["a", "b"])

    return run


def _crowds(num: int, den: int):
    """Of two blocks of classes under one hub: links that join different components, as few as do."""

    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        key, n, root, block = (table.column(c).to_numpy() for c in ("key", "n", "root", "block"))
        sets = table.column("grams").combine_chunks()
        at = sets.offsets.to_numpy()
        values = sets.values.to_numpy()[at[0] : at[-1]]
        owner = np.repeat(np.arange(len(key)), np.diff(at))
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = (np.cumsum(count > 1) - 1)[column]
        use = np.flatnonzero(count[column] > 1)
        use = use[np.argsort(shared[use], kind="stable")]
        owner, shared = owner[use], shared[use]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        both = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int(count[count > 1].size), COLUMNS):
            a, b = np.searchsorted(shared, (start, start + COLUMNS))
            has = np.zeros((len(key), COLUMNS), np.float32)
            has[owner[a:b], shared[a:b] - start] = 1
            both += has[left] @ has[right].T
        size = n[left][:, None] + n[right][None, :]
        keep = (both * (num + den) >= num * size) & (root[left][:, None] != root[right][None, :])
        if first == second:
            keep &= key[left][:, None] < key[right][None, :]
        # Of many links between the same components one is enough.
        _, of = np.unique(root, return_inverse=True)
        label, out_a, out_b = np.arange(len(key)), [], []
        for i in np.flatnonzero(keep.any(axis=1)):
            j = np.flatnonzero(keep[i])
            mine = label[of[left[i]]]
            others, at = np.unique(label[of[right[j]]], return_index=True)
            at = at[others != mine]
            out_a.append(np.full(len(at), key[left[i]]))
            out_b.append(key[right[j[at]]])
            label[np.isin(label, others)] = mine
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return run


def _verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    side = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "grams_a", "grams_b")
    return scratch.table(full.mapInArrow(_linked(num, den), "a bigint, b bigint"))


def _may_link(n: Column, at: Column, m: Column, other: Column, num: int, den: int) -> Column:
    """Length filter, and positional filter for the first n-gram that two classes share."""
    need = F.ceil(F.lit(num) * (n + m) / F.lit(float(num + den)) - F.lit(1e-9))
    return (F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)) & (F.least(n - at, m - other) >= need)


def ngram_components(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """(id, n_shingles, class_key, component_id, component, text_hash) for each row of df; other columns are not read.

    Words stand between ASCII white space, A-Z lower-cased; a row's set holds its distinct runs of `width` words, or with
    fewer words its whole sequence as one. Rows link when den * intersection >= num * union; component_id is the smallest
    id reachable by links, the row itself included. Rows without words (null and empty texts too) link with nothing:
    class_key and component are null and component_id their own id. Repeated rows and ids each give a row; null ids take part and never
    name a component unless all of it is null; component tells components apart where ids repeat, and text_hash (xxhash64)
    rows. N-grams and sets are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = scratch.table(docs.mapInArrow(_classes(width), f"id {kind}, text_hash bigint, n_shingles bigint, key bigint"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(0, int(total // BLOCK)).bit_length()
    blocks = docs.select("text").mapInArrow(_blocks(width, bits), "range int, blob binary")
    sets = scratch.table(shared_blocks(blocks, bits).groupBy("group").applyInArrow(_prefixes(num, den), "key bigint, n bigint, alone bigint, prefix array<bigint>, grams array<bigint>"))

    postings = scratch.table(sets.select("key", "n", "alone", F.posexplode("prefix").alias("i", "gram")).select("gram", "key", "n", (F.col("alone") + F.col("i")).alias("at")))
    hubs = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "n", "at")).alias("hub")).where("c > 1").select("gram", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at"))
    stars = postings.join(hubs, "gram").where(F.col("key") != F.col("hub")).where(_may_link(F.col("n"), F.col("at"), F.col("hub_n"), F.col("hub_at"), num, den))
    first = scratch.table(stars.select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    links = _verified(scratch, first, sets, num, den)
    roots = components(scratch, links)

    at_root = postings.join(roots, F.col("key") == F.col("node"), "left").select("gram", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    mixed = at_root.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"), F.min("key").alias("hub")).where("lo < hi")
    left = at_root.join(mixed.where(F.col("c") <= CROWD).select("gram"), "gram", "left_semi")
    right = left.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "at", "root")])
    met = left.join(right, "gram").where((F.col("key") < F.col("key_b")) & (F.col("root") != F.col("root_b")) & _may_link(F.col("n"), F.col("at"), F.col("n_b"), F.col("at_b"), num, den))
    second = met.select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = _verified(scratch, second, sets, num, den)

    crowd = scratch.table(at_root.join(mixed.where(F.col("c") > CROWD).select("gram", "hub"), "gram").select("hub", "key", "root").distinct().join(sets.select("key", F.size("grams").alias("size")), "key"))
    parts = crowd.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CROWD_BLOCK), F.ceil(F.sum("size") / CROWD_GRAMS)).cast("int").alias("parts"))
    dealt = crowd.join(parts, "hub").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    facing = dealt.select("hub", "key", "root", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    told = facing.join(sets.select("key", "n", "grams"), "key").select("hub", "first", "second", "block", "key", "root", "n", "grams")
    crowded = scratch.table(told.groupBy("hub", "first", "second").applyInArrow(_crowds(num, den), "a bigint, b bigint"))
    scratch.drop(sets, postings, first, crowd)
    whole = components(scratch, roots.toDF("a", "b").union(more).union(crowded))

    least = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    named = least.join(whole, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "id")
    best = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = scratch.table(named.join(best, "root").select(F.col("key").alias("class_key"), "component_id", F.col("root").alias("component")))
    linked = rows.where("key is not null").join(labels, F.col("key") == F.col("class_key"), "left").select(F.col("id").alias(id), "n_shingles", "class_key", "component_id", "component", "text_hash")
    alone = rows.where("key is null").select(F.col("id").alias(id), "n_shingles", F.col("key").alias("class_key"), F.col("id").alias("component_id"), F.col("key").alias("component"), "text_hash")
    return linked.union(alone)

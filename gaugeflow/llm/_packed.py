"""Sets of 64-bit members packed into sorted blocks, so that finding members of several sets costs ten bytes each.

pack_sets() turns batches into a row per range of members; shared_members() brings together each range, keeps members
that two sets or more have, and returns them to their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeflow.llm._carry import slices

#: Members packed at once in a task, and in one range, about.
BLOCK = 1_500_000


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the high ones of small numbers compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(raw: memoryview, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack(grams: np.ndarray, owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, seen: np.ndarray | None = None) -> bytes:
    """grams sorted; owner numbers their sets, of which keys and sizes tell the id and the member count."""
    used, owner = np.unique(owner, return_inverse=True)
    parts = [np.array([len(grams), len(used)], np.int64).tobytes(), _planes(np.diff(grams, prepend=np.uint64(0))), _planes(owner.astype(np.uint32)), keys[used].tobytes(), _planes(sizes[used].astype(np.int32))]
    return b"".join(parts + ([_planes(seen.astype(np.uint32))] if seen is not None else []))


def unpack(blob: bytes, with_seen: bool = False) -> tuple[np.ndarray, ...]:
    """grams, their sets' ids and member counts, and in how many sets each is."""
    view = memoryview(blob)
    n, k = np.frombuffer(view, np.int64, 2)
    at = 16
    grams = np.cumsum(_unplanes(view[at:], n, "u8"), dtype=np.uint64)
    owner = _unplanes(view[(at := at + 8 * n) :], n, "u4")
    keys = np.frombuffer(view[(at := at + 4 * n) :], np.int64, k)
    sizes = _unplanes(view[(at := at + 8 * k) :], k, "i4")
    seen = (_unplanes(view[at + 4 * k :], n, "u4"),) if with_seen else ()
    return grams, keys[owner], sizes[owner], *seen


def _ranges(values: np.ndarray, bits: int) -> np.ndarray:
    """Where, in sorted 64-bit values, each of 2**bits equal ranges begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def pack_sets(members: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], bits: int):
    """For mapInArrow: (range int, blob binary). members yields a set's 64-bit id and its sorted, distinct members; sets
    that a task meets again soon are packed once."""

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys, sets = np.fromiter(held, np.int64, len(held)), list(held.values())
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        at = _ranges(grams, bits)
        rows = [(i, pack(grams[a:b], owner[a:b], keys, sizes)) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for batch in slices(batches):
            for key, grams in members(batch):
                if len(grams) and key not in held:
                    held[key] = grams
                    total += len(grams)
                if total > BLOCK:
                    yield packed(held)
                    held, total = {}, 0
        if held:
            yield packed(held)

    return run


def _shared(bits: int):
    """Of one range of members: those of two sets or more, packed for each range of sets."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        grams, keys, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(grams, kind="stable")
        sorted_grams = grams[order]
        same = np.concatenate(([False], sorted_grams[1:] == sorted_grams[:-1], [False]))
        order = order[same[1:] | same[:-1]]
        order = order[np.lexsort((keys[order], grams[order]))]
        grams, keys, sizes = grams[order], keys[order], sizes[order]
        seen = np.empty(0, np.int64)
        if len(grams):  # the same set may come from several tasks
            fresh = np.concatenate(([True], (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])))
            grams, keys, sizes = grams[fresh], keys[fresh], sizes[fresh]
            starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            seen = np.repeat(counts := np.diff(np.append(starts, len(grams))), counts)
            keep = seen > 1
            grams, keys, sizes, seen = grams[keep], keys[keep], sizes[keep], seen[keep]
        group = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        order = np.argsort(group, kind="stable")
        at = np.searchsorted(group[order], np.arange((1 << bits) + 1))
        rows = []
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if b > a:
                ids, owner = np.unique(keys[x := order[a:b]], return_inverse=True)
                size_of = np.empty(len(ids), np.int64)
                size_of[owner] = sizes[x]
                rows.append((i, pack(grams[x], owner, ids, size_of, seen[x])))
        return pa.table({"group": pa.array([i for i, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def shared_blocks(blocks: DataFrame, bits: int) -> DataFrame:
    """(group int, blob binary): members of two sets or more with how many have them, by range of sets."""
    return blocks.groupBy("range").applyInArrow(_shared(bits), "group int, blob binary")


def lists(values: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit values as an Arrow column."""
    flat = (np.concatenate(values) if values else np.empty(0, np.uint64)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))), pa.int32()), pa.array(flat))


def by_set(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: members by set and rarity, their sets' ids and sizes, and where sets begin."""
    parts = [unpack(x, True) for x in table.column("blob").to_pylist()]
    grams, keys, sizes, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((grams, seen, keys))
    grams, keys, sizes = grams[order], keys[order], sizes[order]
    return grams, keys, sizes, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _listed(table: pa.Table) -> pa.Table:
    grams, keys, _, starts = by_set(table)
    return pa.table({"key": keys[starts], "members": lists(np.split(grams, starts[1:]))})


def shared_members(blocks: DataFrame, bits: int) -> DataFrame:
    """(key bigint, members array<bigint>): for each set that shares members, those."""
    return shared_blocks(blocks, bits).groupBy("group").applyInArrow(_listed, "key bigint, members array<bigint>")

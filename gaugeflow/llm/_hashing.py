"""64-bit hashes of words and shingles over Arrow batches, in numpy.

A word's hash is a polynomial over random byte values, read off one running sum over the buffer; texts are taken together
up to PIECE bytes, longer ones in pieces cut at separators, so that memory depends on neither batch nor text length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed at once, about.
PIECE = 1 << 18

_RANDOM = np.random.default_rng(20_241)
_BYTE = _RANDOM.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RANDOM.integers(1 << 63, size=32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


def separators(pattern_bytes: Iterable[int]) -> np.ndarray:
    """Table of byte values that are part of words, from those that aren't."""
    table = np.ones(256, dtype=bool)
    table[list(pattern_bytes)] = False
    return table


#: Words between ASCII white space, and words of letters, digits and all beyond ASCII.
SPACED = separators([0x20, *range(0x09, 0x0E)])
ALNUM = separators([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_buffer(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a buffer."""
    low = _LOWER[buf]
    inside = table[low]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * _powers(_BASE, len(buf)), out=run[1:])
    return mix((run[ends] - run[starts]) * _powers(_INVERSE, len(buf) + 1)[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(texts: Iterable[bytes | None], table: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order; none for null."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        buf = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
        hashes, starts, _ = _hash_buffer(buf, table)
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group]))
        before = 0
        for cut in cuts:
            yield hashes[before:cut]
            before = cut

    for text in texts:
        text = text or b""
        if group and size + len(text) > PIECE:
            yield from flush()
            group, size = [], 0
        if len(text) > PIECE:
            yield _long(text, table)
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        yield from flush()


def _long(text: bytes, table: np.ndarray) -> np.ndarray:
    """Pieces end where a word does."""
    out, at, whole = [], 0, np.frombuffer(text, dtype=np.uint8)
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        while end < len(whole):
            gap = np.flatnonzero(~table[_LOWER[whole[end : end + 4096]]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(whole), end + 4096)
        out.append(_hash_buffer(whole[at:end], table)[0])
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, in order; of fewer words than k the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out = mix(out * _MULT[0] + words[i : n - width + 1 + i] + np.uint64(width))
    return out


def as_bytes(column) -> list[bytes | None]:
    """A string column of an Arrow batch as bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()

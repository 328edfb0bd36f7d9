"""Alignment of two tokenizers over the same bytes.

Both token sequences of a text are arrays of byte offsets where tokens end. As long as both go on in step, the arrays agree at
a fixed shift of their indexes: such stretches are probed in doubling lengths and jumped. Where they part, tokens are gathered
up to the next common end, which makes an irregular group and a new shift. Pairs of tokens that overlap are counted over the
corpus; frequent pairs are looked up in a broadcast of bounded size, all others are joined by key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import add_columns, bounded
from gaugeflow.llm._scratch import Scratch

#: Folder of the vocabularies, and the files of the byte-level tokenizer (A) and of the one by pieces (B).
FOLDER, BYTE_LEVEL, BY_PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words that a Python worker remembers at most, and code points of a remembered word.
MEMO, MEMO_LENGTH = 300_000, 48
#: Pairs that are broadcast at most, 16 bytes each.
FREQUENT = 1_000_000
#: A single blank between plain letters or marks: tokens of neither tokenizer go across it.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order
    for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(f"{folder}/{BYTE_LEVEL}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{BY_PIECES}")
        letters = byte_of_letter()
        size = 1 + max(self.a.get_vocab(with_added_tokens=True).values())
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        #: Words can be taken one by one if no piece holds a blank behind something else.
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.names = [f"{i}{end}" for end in ",|" for i in range(size)] + [f"{i}{end}" for end in ",;" for i in range(len(pieces))]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B (4 bytes each) of a blank and each text; None if the tokens' bytes aren't those of the text."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        out: list[tuple[bytes, bytes] | None] = []
        for text, a, b in zip(texts, ids_a, self.b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else None)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each text; None without any. A word that came before isn't encoded again."""
        words = [(_CUT.split(t) if self.by_words else [t]) if t else [] for t in texts]
        fresh = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.known]
        now = dict(zip(fresh, self._encoded(fresh), strict=True))
        old = self.known
        for text, ws in zip(texts, words, strict=True):
            found = [now[w] if w in now else old[w] for w in ws]
            if None in found:
                found = self._encoded([text])
            if not found or None in found:
                yield None
            else:
                yield tuple(np.frombuffer(b"".join([f[k] for f in found]), np.int32) for k in (0, 1))
        if len(old) + len(now) > MEMO:
            old.clear()
        old.update((w, f) for w, f in now.items() if len(w) <= MEMO_LENGTH)


_LOADED: dict[str, Tokenizers] = {}


def loaded(folder: str) -> Tokenizers:
    """Once a Python worker."""
    if folder not in _LOADED:
        _LOADED[folder] = Tokenizers(folder)
    return _LOADED[folder]


def common_ends(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """Indexes in x and y of the ends that both have; x and y rise and have the same last end."""
    at_x: list[int] = []
    at_y: list[int] = []
    i = j = 0
    n = len(x)
    while i < n:
        if x[i] == y[j]:
            began, step = i, 1
            i, j = i + 1, j + 1
            while step and i < n:  # lengths double while both are in step, and halve behind the first that fails
                if x[i : i + step] == y[j : j + step] and i + step <= n:
                    i, j = i + step, j + step
                    step *= 2
                elif step > 1:
                    while step := step // 2:
                        if x[i : i + step] == y[j : j + step] and i + step <= n:
                            i, j = i + step, j + step
                else:
                    break
            at_x.extend(range(began, i))
            at_y.extend(range(began + j - i, j))
        else:
            a, b = x[i], y[j]
            while a != b:
                if a < b:
                    i += 1
                    a = x[i]
                else:
                    j += 1
                    b = y[j]
            at_x.append(i)
            at_y.append(j)
            i, j = i + 1, j + 1
    return at_x, at_y


@dataclass
class Aligned:
    n_groups: int
    digest: str
    pairs: np.ndarray
    times: np.ndarray


def align(tools: Tokenizers, a: np.ndarray, b: np.ndarray) -> Aligned:
    """Groups and links of one text's tokens; a pair is a's id * number of B's tokens + b's id."""
    x, y = tools.a_sizes[a].cumsum(), tools.b_sizes[b].cumsum()
    at_x, at_y = (np.array(v) for v in common_ends(x.tolist(), y.tolist()))
    # Where each token comes in the written groups: behind all tokens of groups before, A's tokens first.
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[at_x], last_b[at_y] = True, True
    before_a = np.append(0, at_y + 1)[np.cumsum(last_a) - last_a] + np.arange(len(a))
    before_b = (at_x + 1)[np.cumsum(last_b) - last_b] + np.arange(len(b))
    written, size_a, size_b = np.empty(len(a) + len(b), np.int64), len(tools.a_sizes), len(tools.b_sizes)
    written[before_a] = a + size_a * last_a
    written[before_b] = b + (2 * size_a + size_b * last_b)
    names = tools.names
    groups = "".join([names[k] for k in written.tolist()])[:-1]
    # Between two neighbouring ends of either lies one overlap of an A and a B token.
    ends_a, ends_b = np.zeros(int(x[-1]) + 1, np.int32), np.zeros(int(x[-1]) + 1, np.int32)
    ends_a[x], ends_b[y] = 1, 1
    ends = np.flatnonzero(ends_a | ends_b)
    links = a[np.cumsum(ends_a)[ends - 1]].astype(np.int64) * size_b + b[np.cumsum(ends_b)[ends - 1]]
    pairs, times = np.unique(links, return_counts=True)
    return Aligned(len(at_x), hashlib.sha256(groups.encode()).hexdigest(), pairs, times)


_ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{kind}>, times array<int>"


def _aligned(text: str, folder: str, kind: pa.DataType):
    def compute():
        tools = loaded(folder)

        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            rows: list[tuple] = []
            for ids in tools.encode(batch.column(text).to_pylist()):
                if ids is None:
                    rows.append((0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)))
                else:
                    found = align(tools, *ids)
                    rows.append((len(ids[0]), len(ids[1]), found.n_groups, int(found.times.sum()), found.digest, found.pairs, found.times))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(kind), pa.list_(pa.int32())]
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]

        return of

    return compute


def pair_counts(scratch: Scratch, aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of each pair in all rows, and whether no pair with the same B token has more."""
    each = aligned.select("times", F.posexplode("pairs").alias("i", "pair")).select("pair", F.col("times")[F.col("i")].alias("k"))
    counts = scratch.table(each.groupBy("pair").agg(F.sum("k").alias("n")))
    token = F.col("pair") % size_b
    most = counts.groupBy(token.alias("b")).agg(F.max("n").alias("most"))  # a row per token of B's vocabulary at most
    return scratch.table(counts.withColumn("b", token).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two from which at most `most` pairs have that many links."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("log")).count().collect())
    total, level = 0, max(sizes, default=0) + 1
    while level > 0 and total + sizes.get(level - 1, 0) <= most:
        level -= 1
        total += sizes.get(level, 0)
    return 1 << level


def _looked_up(frequent):
    def compute():
        keys, n, best = frequent.value

        def of(batch: pa.RecordBatch) -> list[pa.Array]:
            rows: list[tuple] = []
            offsets = batch.column("pairs").offsets.to_numpy()
            pairs, times = (batch.column(c).values.to_numpy() for c in ("pairs", "times"))
            place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums, bests = (np.append(0, np.cumsum(np.where(known, times * v[place], 0) if len(keys) else np.zeros(len(pairs), np.int64))) for v in (n, best))
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                rest = ~known[lo:hi]
                rows.append((int(bests[hi] - bests[lo]), int(sums[hi] - sums[lo]), pairs[lo:hi][rest], times[lo:hi][rest]))
            kinds = [pa.int64(), pa.int64(), pa.list_(batch.schema.field("pairs").type.value_type), pa.list_(pa.int32())]
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]

        return of

    return compute


def align_tokenizers(df: DataFrame, text: str = "text", keep: list[str] | None = None, folder: str = FOLDER, frequent: int = FREQUENT) -> DataFrame:
    """df's columns named in keep (all, if None) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A encodes a blank and the text, B the text, before which it puts a blank itself; strings of special tokens are text.
    Where both end, their tokens are cut into groups. A link is an A and a B token that overlap; a pair's count is its number
    of links in all rows, repeated rows included. n_best counts links whose pair has the most links of its B token, count_sum
    adds up counts over links. Null and empty texts, and those that either tokenizer's tokens do not spell, have no tokens:
    zeros and an empty groups_sha256. Every row is kept; columns of the added names are replaced. Texts are encoded whole.
    """
    scratch = Scratch(bounded(df.sparkSession), "alignment")
    tools = loaded(folder)
    size_b = len(tools.b_sizes)
    small = len(tools.a_sizes) * size_b < 1 << 31
    added = _ALIGNED.format(kind="int" if small else "bigint")
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "n_best", "count_sum", "__row"]
    wanted = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*dict.fromkeys([*wanted, text])).withColumn("__row", F.monotonically_increasing_id())
    aligned = scratch.table(add_columns(source, added, _aligned(text, folder, pa.int32() if small else pa.int64()), [*wanted, "__row"]))
    counts = pair_counts(scratch, aligned, size_b)
    least = frequent_from(counts, frequent)
    top = counts.where(F.col("n") >= least).orderBy("pair").toPandas()
    shared = df.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    looked_up = "n_best bigint, count_sum bigint, pairs array<{kind}>, times array<int>".format(kind="int" if small else "bigint")
    partly = scratch.table(add_columns(aligned, looked_up, _looked_up(shared)))
    scratch.drop(aligned)
    rest = partly.select("__row", "times", F.posexplode("pairs").alias("i", "pair")).select("__row", "pair", F.col("times")[F.col("i")].alias("k"))
    more = rest.join(counts.where(F.col("n") < least), "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    total = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).cast("long").alias(c)
    out = partly.join(more, "__row", "left")
    return out.select(*wanted, "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")

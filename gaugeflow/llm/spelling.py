"""Spelling variants by a trie held in tables.

Words are walked through a path-compressed trie whose edges are rows. A frontier of states (word, what is left of it, node,
edits) meets the edges by node, level by level; a state that ends at a word with one edit is a pair of near words. Each word
is walked twice, from the middle on: forwards through the trie of words for edits in its second half, backwards through the
trie of reversed words for edits in its first half. So no state begins at a root, where all words would meet, and nodes of
the lower halves have few edges. The levels are the branching nodes below the middle, whatever the length of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm._carry import bounded, slices
from gaugeflow.llm._hashing import _powers, mix
from gaugeflow.llm._native import lower_ascii
from gaugeflow.llm._scratch import Scratch

#: Letters of a run once A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]+"
#: Code points and occurrences of a word at least, and how many times as frequent a form has to be.
LENGTH, OCCURRENCES, RATIO = 5, 3, 2
#: One run in so many loses a code point, by hash of id and run.
ERRORS = 97
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)




def noised(run: Column, id: Column) -> Column:  # noqa: A002
    """The run, less one code point where ERRORS divides the crc32 of "<id>:<run>"."""
    h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % ERRORS == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:  # noqa: A002
    """(word, n) of the words of all texts with so many code points and occurrences. Null and empty texts have none; every
    row counts, repeated ones too."""
    runs = df.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.char_length("run") >= length).select(noised(F.col("run"), F.col("id")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= occurrences) & (F.char_length("word") >= length))


def _prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: hashes of the prefixes (the empty one and the whole word included), which word each belongs to, its
    length, and the next code point, -1 at the end."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(0x51ED270B)) * _powers(_BASE, len(codes)), dtype=np.uint64)))
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(owner)) - np.repeat(starts + np.arange(len(words)), sizes + 1)
    begin = starts[owner]
    hashes = mix((run[begin + at] - run[begin]) * _powers(_INVERSE, len(codes) + 1)[begin] + at.astype(np.uint64))
    following = np.append(codes.astype(np.int64), -1)[begin + at]
    following[at == sizes[owner]] = -1
    return hashes.view(np.int64), owner, at, following


def word_ids(words: list[str]) -> np.ndarray:
    """64-bit hashes of whole words."""
    hashes, _, _, following = _prefixes(words)
    return hashes[following == -1]


def _both_ways(words: list[str]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """The words as they are and reversed, with the prefix from which each is walked."""
    sizes = np.array([len(w) for w in words])
    yield 0, words, sizes // 2
    yield 1, [w[::-1] for w in words], sizes - sizes // 2


_PREFIXES = "node bigint, id bigint, way int, at int, following int, first boolean"


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes from the middle on, of words and reversed words."""
    for batch in slices(batches):
        words = batch.column("word").to_pylist()
        ids = batch.column("id").to_numpy() if words else np.empty(0, np.int64)
        for way, texts, middle in _both_ways(words):
            node, owner, at, following = _prefixes(texts)
            low = at >= middle[owner] if words else np.empty(0, bool)
            node, owner, at, following = node[low] ^ way, owner[low], at[low], following[low]
            columns = [node, ids[owner], np.full(len(node), way, np.int32), at.astype(np.int32), following.astype(np.int32), at == middle[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "id", "way", "at", "following", "first"])


def _state_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states from which words are walked."""
    for batch in slices(batches):
        words = batch.column("word").to_pylist()
        for way, texts, middle in _both_ways(words):
            node, owner, at, _ = _prefixes(texts)
            first = at == middle[owner] if words else np.empty(0, bool)
            rest = [t[m:] for t, m in zip(texts, middle, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rest, pa.string()), pa.array(node[first] ^ way), pa.array(np.zeros(len(words), np.int32))], ["id", "rest", "node", "edits"])


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = word_ids(batch.column("word").to_pylist()) if batch.num_rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("word"), batch.column("n")], ["id", "word", "n"])


def trie_edges(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(node, label, child, ends, begins) of both tries of words (id, word): ends is the id of the word that ends at the child,
    begins the first code points of the edges from there.

    Nodes are prefixes where words part, end, or are walked from. What lies between two nodes of a word is an edge's label.
    """
    prefixes = scratch.table(words.select("id", "word").mapInArrow(_prefix_rows, _PREFIXES))
    parts = (F.min("following") != F.max("following")) | (F.min("following") == -1) | F.max("first")
    nodes = prefixes.groupBy("node").agg(parts.alias("is_node")).where("is_node").select("node")
    path = prefixes.join(nodes, "node").groupBy("id", "way").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("path")).join(words.select("id", "word"), "id")
    text = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    step = F.explode(F.sequence(F.lit(0), F.size("path") - 2))
    steps = path.where(F.size("path") > 1).select("id", "path", text.alias("text"), step.alias("i")).select("id", "text", F.col("path")[F.col("i")].alias("a"), F.col("path")[F.col("i") + 1].alias("b"))
    edges = steps.select(
        F.col("a.node").alias("node"), F.substr("text", F.col("a.at") + 1, F.col("b.at") - F.col("a.at")).alias("label"),
        F.col("b.node").alias("child"), F.when(F.col("b.at") == F.char_length("text"), F.col("id")).alias("ends"),
    )
    bare = scratch.table(edges.groupBy("node", "label", "child").agg(F.max("ends").alias("ends")))
    begins = bare.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.left("label", F.lit(1))), "").alias("begins"))
    out = scratch.table(bare.join(begins, "child", "left").select("node", "label", "child", "ends", F.coalesce("begins", F.lit("")).alias("begins")))
    scratch.drop(prefixes, bare)
    return out


def walked() -> Column:
    """What is left of a word after an edge, with the edits so far, of columns rest, label and edits: as it stands, or in the
    first edge where they part with a code point replaced or one deleted. A deletion behind the label's end is left to the
    next edges."""
    size, fresh = F.char_length("label"), (F.col("edits") == 0) & ~F.startswith("rest", "label")
    way = lambda when, left, edits: F.when(when, F.struct(left.alias("left"), edits.alias("edits")))
    one_apart = lambda n: (F.char_length("rest") >= n) & (F.levenshtein(F.left("rest", n), F.col("label"), 1) == 1)
    return F.filter(F.array(
        way(F.startswith("rest", "label"), F.substr("rest", size + 1), F.col("edits")),
        way(fresh & one_apart(size), F.substr("rest", size + 1), F.lit(1)),
        way(fresh & one_apart(size + 1), F.substr("rest", size + 2), F.lit(1)),
    ), lambda x: x.isNotNull())


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rest, node, edits, found): states behind the edges that they met, and the ids of words found. Behind an edit only
    the edge that goes on as the word does counts, and only if something follows there as the word has it."""
    met = states.join(edges, (states["node"] == edges["node"]) & ((F.col("edits") == 0) | F.startswith("rest", "label"))).drop(states["node"]).drop(edges["node"])
    on = met.select("id", "child", "ends", "begins", F.explode(walked()).alias("to")).select("id", "child", "ends", "begins", "to.left", "to.edits")
    found = F.when(((F.col("edits") == 1) & (F.col("left") == "")) | ((F.col("edits") == 0) & (F.char_length("left") == 1)), F.col("ends"))
    goes_on = (F.col("begins") != "") & F.when(F.col("edits") == 0, F.col("left") != "").otherwise(F.contains("begins", F.left("left", F.lit(1))) & (F.col("left") != ""))
    return on.select("id", F.when(goes_on, F.col("left")).alias("rest"), F.col("child").alias("node"), "edits", found.alias("found")).where("rest is not null or found is not null")


def near_pairs(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(a, b): ids of all words (id, word; three code points or more) that differ by one inserted, deleted or replaced, both
    ways round.

    A level is one join by node and one written table; nodes that many states have reached are split by adaptive skew joins.
    """
    edges = trie_edges(scratch, words)
    states = scratch.table(words.select("id", "word").mapInArrow(_state_rows, "id bigint, rest string, node bigint, edits int"))
    found: DataFrame | None = None
    while found is None or not states.isEmpty():
        after = scratch.table(_advance(states, edges))
        pairs = after.where("found is not null").select(F.col("id").alias("a"), F.col("found").alias("b"))
        found = pairs if found is None else found.union(pairs)
        states = after.where("rest is not null").select("id", "rest", "node", "edits")
    return scratch.table(found.union(found.select("b", "a")).distinct())


def spelling_forms(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:  # noqa: A002
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    Words are runs of letters, A-Z lower-cased, of which one in ERRORS loses a code point, with so many code points and
    occurrences. A word's form is its near word of largest n (of these the first in code-point order) if that n is at least
    ratio times its own; root is where forms lead in the end, the word itself without a form. Forms grow at least ratio-fold
    (above 1), so that no path comes back. Null and empty texts have no words, an empty table gives no rows; ids may be null
    or repeat, other columns are not read. Words and prefixes are told apart by 64-bit hashes. length is 3 at least.
    """
    if length < 3:
        raise ValueError("words of fewer than three code points have no middle to walk from")
    scratch = Scratch(bounded(df.sparkSession), "spelling")
    words = scratch.table(word_counts(df, id, text, length, occurrences).mapInArrow(_with_ids, "id bigint, word string, n bigint"))
    pairs = near_pairs(scratch, words)
    other = words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = pairs.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"), F.col("b"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    rows = scratch.table(words.join(best.withColumnRenamed("a", "id"), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"), F.when(fits, F.col("best.b")).alias("to"),
    ))
    leads = rows.where("to is not null").select("id", F.col("to").alias("root_id"))
    while True:  # paths halve each round
        on = leads.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        leads = scratch.table(leads.join(on, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")))
        if leads.where("moved").isEmpty():
            break
        leads = leads.drop("moved")
    roots = leads.drop("moved").join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return rows.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

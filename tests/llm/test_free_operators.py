"""N-gram join, decontamination, both deduplications, toxicity and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import chunk_dedup, column_dedup, decontaminate, mixing, ngram_join, toxicity
from gaugeflow.llm._hashing import ALNUM, SPACED, word_hashes
from gaugeflow.llm._native import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_word_hashes_tell_words_apart(docs, monkeypatch):
    texts = [r["text"] for r in docs.collect()] + ["Aa-b\x00é", "x" * 5000 + " y"]
    raw = [None if t is None else t.encode() for t in texts]
    for table, split in ((SPACED, spaced), (ALNUM, alnum)):
        whole = list(word_hashes(raw, table))
        names = {}
        for t, h in zip(texts, whole, strict=True):
            assert len(split(t)) == len(h)
            for w, x in zip(split(t), h.tolist(), strict=True):
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)
        monkeypatch.setattr("gaugeflow.llm._hashing.PIECE", 300)
        assert all(np.array_equal(a, b) for a, b in zip(whole, word_hashes(raw, table), strict=True))
        monkeypatch.undo()


def brute_components(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = spaced(text)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    label = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            label[i] = min(ids) if ids else None
    return Counter((rows[i][0], len(sets[i]), label[i]) for i in range(len(rows)))


@pytest.mark.parametrize(("width", "num", "crowd"), [(3, 90, 64), (3, 90, 1), (5, 80, 64), (2, 60, 1)])
def test_components_equal_all_pairs(spark, docs, monkeypatch, width, num, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "CROWD_BLOCK", 4)
    g = random.Random(3)
    base = [f"w{g.randrange(50)}" for _ in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(40):  # a crowd of near copies
        w = list(base)
        for _ in range(g.randint(0, 4)):
            w[g.randrange(60)] = f"n{g.randrange(1000)}"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_components(df, width, num, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, width, num, 100)


def test_components_of_an_empty_table(empty):
    assert ngram_join.ngram_components(empty).count() == 0


def brute_hits(text, items):
    w, hit, found = alnum(text), set(), set()
    for name, item in items:
        v = alnum(item)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SEGMENT", 25)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is null or doc_id < 40").collect()]
    texts = [alnum(t) for _, t in rows if t]
    items = [("1", " ".join(texts[2][5:60]).upper()), ("2", " ".join(texts[7][:13])), ("3", " ".join(texts[9][3:6])), ("4", ""), ("5", None), ("6", "no such words at all here"), ("7", " ".join(texts[2][20:50]))]
    rows.append((900, " ".join(texts[2][10:40]) + " other " + " ".join(texts[2][12:24]) + " " + " ".join(texts[2][5:60])))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, items string")
    got = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id string, text string")).collect()
    want = Counter()
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want[i, n, hit, tuple(found), hit > 0 and 20 * hit >= n] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want


def test_contamination_with_nothing_to_find(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.find_contamination(empty, none).count() == 0


def brute_removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("shared", "piece", "block"), [(5_000, 1 << 20, 20_000), (2, 1 << 20, 20_000), (5_000, 1000, 5)])
def test_repeats_equal_brute_force(spark, docs, monkeypatch, shared, piece, block):
    monkeypatch.setattr(column_dedup, "SHARED", shared)
    monkeypatch.setattr(column_dedup, "PIECE", piece)
    monkeypatch.setattr(column_dedup, "SORTED", block)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is null or doc_id <> 64").collect()]
    g = random.Random(5)
    rows += [(200 + i, rows[3][1][: g.randint(0, 200)] + "x" * i + rows[8][1] + rows[8][1][:150]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = column_dedup.remove_repeats(df, 100, 16).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_removed([(t or "").encode() for _, t in rows], 100), strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_repeats_of_an_empty_table(empty):
    assert column_dedup.remove_repeats(empty).count() == 0


def test_column_rounds_find_common_strings():
    texts = [b"abcdefghij", b"zbcdefghiz", b"bcdefghi", b"qqqqqqqqqq"]
    found = column_dedup.column_repeats(np.array([1, 1, 1, 1]), texts, np.array([3, 3, 2, 3]), 6)
    assert [f.tolist() for f in found] == [[1, 2, 3], [1, 2, 3], [0, 1, 2], []]
    assert all(not len(f) for f in column_dedup.column_repeats(np.array([1, 2]), texts[:2], np.array([3, 3]), 6))


def test_chunks_cover_texts_and_resist_shifts():
    g = random.Random(1)
    text = "".join(g.choices("abcdefgh ", k=20_000)).encode()
    ends = chunk_dedup.cut_points(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    assert all(chunk_dedup.LEAST <= b - a <= chunk_dedup.MOST for a, b in zip([0, *ends[:-2]], ends[:-1], strict=True))
    moved = {e - 7 for e in chunk_dedup.cut_points(b"shifted" + text)}
    assert len(moved & set(ends)) > 0.9 * len(ends)
    assert chunk_dedup.cut_points(b"") == []


def test_chunk_repeats_equal_plain_python(docs, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    places = defaultdict(list)
    for i, t in rows:
        start = before = 0
        for end in chunk_dedup.cut_points(t):
            short = end - start < chunk_dedup.LEAST  # an ending counts with the chunk before it
            places[short, t[before if short else start : end]].append((i, start, end - start))
            before, start = start, end
    want = defaultdict(list)
    for at in places.values():
        for i, s, n in sorted(at)[1:]:
            want[i].append((s, n))
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in chunk_dedup.repeated_chunks(once).collect()}
    assert len(got) == len(rows) and sum(map(len, want.values())) > 20
    for i, t in rows:
        assert [tuple(s) for s in got[i]["spans"]] == sorted(want[i])
        assert (got[i]["n_bytes"], got[i]["n_repeats"], got[i]["n_removed"]) == (len(t), len(want[i]), sum(n for _, n in want[i]))
    assert chunk_dedup.repeated_chunks(empty).count() == 0 and chunk_dedup.repeated_chunks(docs).count() == len(rows) + 1


def test_later_copies_go_whole_and_other_endings_stay(spark):
    g = random.Random(6)
    text = lambda n: "".join(g.choices("abcdefgh ", k=n))
    rows = [(i, text(n)) for i, n in enumerate([1, 5, 39, 40, 41, 300, 513, 2000, 0])]
    copies = [(100 + i, t) for i, t in rows] + [(200 + i, t) for i, t in rows]
    other = [(300 + i, text(400) + " the end.") for i in range(20)]
    got = {r["doc_id"]: r for r in chunk_dedup.repeated_chunks(spark.createDataFrame(rows + copies + other, "doc_id long, text string")).collect()}
    assert all(got[i]["n_removed"] == len(t) for i, t in copies)
    assert all(got[i]["n_removed"] == 0 for i, _ in rows + other)


def test_passages_of_fifty_words_are_caught(spark):
    g = random.Random(2)
    word = lambda: "".join(g.choices("abcdefghijklmnop", k=g.randint(3, 8)))
    rows = []
    for i in range(100):
        passage = " ".join(word() for _ in range(55))
        rows += [(2 * i, " ".join([*(word() for _ in range(40)), passage])), (2 * i + 1, " ".join([*(word() for _ in range(33)), passage, word()]))]
    got = chunk_dedup.repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] > 0 for r in got if r["doc_id"] % 2) >= 98 and not any(r["n_removed"] for r in got if r["doc_id"] % 2 == 0)


def toxic_table(spark):
    g = random.Random(4)
    plain = ["".join(g.choices("aeioulnrst", k=g.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        w = g.choices(plain, k=g.randint(5, 200))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(g.randint(1, 3)):
                w.insert(g.randrange(len(w)), g.choice(["zdumbkopf", "vyxoloser", "qwazscum"]))
        rows.append((i, " ".join(w)))
        if i % 10 != 9:
            labels.append((i, int(g.random() < 0.8), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    df, labels = toxic_table(spark)
    got = toxicity.score_toxicity(df, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100
    hits = sum(r["predicted"] == 1 for r in got if r["toxic"])
    assert hits >= 0.9 * sum(r["toxic"] for r in got) and sum(r["predicted"] for r in got if not r["toxic"]) <= 0.02 * len(got)


def test_toxicity_uses_no_held_out_label(spark):
    df, labels = toxic_table(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, x).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got) and {"shard", "source"} <= set(got[0].asDict())
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_evidence_doesnt_depend_on_pieces(spark, monkeypatch):
    df, labels = toxic_table(spark)
    model = toxicity.fit(df, labels)
    texts = [r["text"].encode() for r in df.limit(50).collect()] + [b"", None, b"x"]
    whole = model.evidence(texts)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert np.allclose(whole, model.evidence(texts), atol=1e-6)


def test_mixture_meets_its_targets(spark):
    df, labels = toxic_table(spark)
    mixture = mixing.fit_mixture(df, labels, {"high": 0.6, "low": 0.3, "toxic": 0.1})
    rows = mixing.with_rates(df, mixture).collect()
    n, p, rate = np.array([r["n_tokens"] for r in rows]), np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])
    assert [int(x) for x in n] == [len(r["text"].split()) for r in rows] and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.abs((n * rate) @ p / n.sum() - [0.6, 0.3, 0.1]).max() < 0.01
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)


def test_mixture_of_odd_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.with_rates(docs, mixing.fit_mixture(docs, none)).collect()
    assert len(rows) == docs.count() and all(len(r["posterior"]) == 3 for r in rows)
    assert mixing.mix(docs, mixing.fit_mixture(docs, none)).columns == docs.columns
    assert mixing.with_rates(empty, mixing.fit_mixture(empty, none)).count() == 0

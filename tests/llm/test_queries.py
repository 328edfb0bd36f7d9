"""The registered queries over the smallest tables, against plain Python and SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from gaugeflow.llm import chunk_dedup, licenses, queries
from gaugeflow.llm._native import UPPER

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1_keeps_every_document(spark, texts):
    got = rows_of(spark, "op1_soft_mixing")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["n_tokens"] == len(texts[i].encode().split()) and abs(r["p_high"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9
        assert r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1
    total = sum(r["n_tokens"] for r in got.values())
    assert abs(sum(r["n_tokens"] * r["rate"] * r["p_high"] for r in got.values()) / total - 0.7) < 0.02


def test_op2_columns(spark, texts):
    got, slots = rows_of(spark, "op2_kd_shards"), defaultdict(list)
    assert got.keys() == texts.keys()
    for i, r in got.items():
        raw = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op3_base(spark, texts):
    for i, r in rows_of(spark, "op3_license_scan").items():
        w = WORD.findall(texts[i].translate(LOWER))
        places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        labels = sorted({x for _, x in places})
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), *ends, ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_op6_edits_and_likeness(spark, texts):
    ids = sorted(texts, reverse=True)
    follow = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}

    def shingles(t):
        w = WORD.findall(t.translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    same = defaultdict(set)
    for i, r in rows_of(spark, "op6_scaled_sketch").items():
        t, u = texts[i], texts[follow[i]]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same[t].add(r["fingerprint"])
        for other, near in ((edited, r["near_edited"]), (u, r["near_next"])):
            a, b = shingles(t), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) < (1e-12 if max(len(a), len(b)) <= 256 else 0.25)
    assert all(len(s) == 1 for s in same.values())


def test_op8_columns(spark, texts):
    got = rows_of(spark, "op8_toxicity")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op9_spans(spark, texts):
    places = defaultdict(list)
    for i, t in texts.items():
        start, before, raw = 0, 0, t.encode()
        for end in chunk_dedup.cut_points(raw):
            short = end - start < chunk_dedup.LEAST  # an ending counts with the chunk before it
            places[short, raw[before if short else start : end]].append((i, start, end - start))
            before, start = start, end
    want = defaultdict(list)
    for at in places.values():
        for i, s, n in sorted(at)[1:]:
            want[i].append((s, n))
    for i, r in rows_of(spark, "op9_chunk_dedup").items():
        spans = ",".join(f"{s}+{n}" for s, n in sorted(want[i]))
        assert (r["n_bytes"], r["n_repeats"], r["n_removed"], r["spans_sha256"]) == (len(texts[i].encode()), len(want[i]), sum(n for _, n in want[i]), hashlib.sha256(spans.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    titles = [c[0] for c in found.description]
    want = Counter(tuple(dict(zip(titles, r, strict=True))[c] for c in sorted(titles)) for r in found.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(titles)
    assert Counter(tuple(r[c] for c in sorted(titles)) for r in df.collect()) == want

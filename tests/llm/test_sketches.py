"""Sketches of short documents, and the following row where keys are spread badly."""

import re

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import fingerprints
from gaugeflow.llm._native import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_documents_with_words_have_a_sketch(docs):
    for r in docs.select("text", fingerprints.document_sketch(F.col("text")).alias("s")).collect():
        n = len(shingles(r["text"]))
        assert r["s"]["n"] == n and (len(r["s"]["hashes"]) > 0) == (n > 0)
        assert n > fingerprints.WHOLE or len(r["s"]["hashes"]) == n


def test_likeness_of_short_documents_is_exact(spark):
    texts = ["", None, "!?", "one", "One", "two", "a b c d e f g", "a b c d e f h", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(50, 250))]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select("a", "b", fingerprints.likeness(fingerprints.document_sketch(F.col("a")), fingerprints.document_sketch(F.col("b"))).alias("x")).collect()
    for r in found:
        a, b = shingles(r["a"]), shingles(r["b"])
        assert r["x"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_likeness_of_long_and_unequal_documents(spark):
    text = lambda lo, hi: " ".join(f"w{i}" for i in range(lo, hi))
    pairs = [(text(0, 6000), text(2000, 8000)), (text(0, 300), text(0, 2000)), (text(0, 200), text(0, 1000)), (text(0, 5), text(0, 5000)), (text(0, 3000), text(5000, 9000))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", fingerprints.likeness(fingerprints.document_sketch(F.col("a")), fingerprints.document_sketch(F.col("b"))).alias("x")).collect():
        a, b = shingles(r["a"]), shingles(r["b"])
        assert abs(r["x"] - len(a & b) / len(a | b)) < 0.08


def test_containment_of_very_unequal_documents(spark):
    text = lambda lo, hi: " ".join(f"w{i}" for i in range(lo, hi))
    inside = [(text(9 * k, 9 * k + 9), text(0, 409)) for k in range(40)]  # 5 shingles each, all of them inside
    part = [(text(0, 4000), text(2000, 9_000)), (text(0, 1000), text(900, 9_000)), (text(0, 200), text(100, 150)), (text(0, 250), text(125, 6_000)), (text(0, 9), text(5000, 9000)), ("", text(0, 9)), (text(0, 9), ""), (None, None)]
    df = spark.createDataFrame(inside + part, "a string, b string")
    one, two = (fingerprints.document_sketch(F.col(c)) for c in "ab")
    found = df.select("a", "b", fingerprints.document_containment(one, two).alias("c")).collect()
    known = 0
    for r in found:
        a, b = shingles(r["a"]), shingles(r["b"])
        c = len(a & b) / len(a) if a else 1.0
        if r["c"] is None:
            assert len(a) <= fingerprints.WHOLE < len(b)
            continue
        known += 1
        exact = len(a) <= fingerprints.WHOLE and len(b) <= fingerprints.WHOLE
        error = 0.0 if exact else (c * (1 - c) * fingerprints.SCALE / max(1, len(a))) ** 0.5
        assert abs(r["c"] - c) <= 4 * error + 1e-9
    assert known >= 15


def test_merged_sketches_are_those_of_both_texts(spark):
    text = lambda lo, hi: " ".join(f"w{i}" for i in range(lo, hi))
    pairs = [(text(0, 100), text(50, 200)), (text(0, 100), text(500, 3000)), (text(0, 2000), text(1000, 5000)), ("", text(0, 9)), (None, "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    one, two = (fingerprints.document_sketch(F.col(c)) for c in "ab")
    every = F.array_sort(F.array_union(*[fingerprints.sketch(F.col(c), scale=1) for c in "ab"]))
    for r in df.select("a", "b", fingerprints.document_merge(one, two).alias("m"), fingerprints.document_containment(one, fingerprints.document_merge(one, two)).alias("c"), every.alias("all")).collect():
        n = len(shingles(r["a"]) | shingles(r["b"]))
        assert r["m"]["hashes"] == [h for h in r["all"] if h <= r["m"]["bound"]]
        assert r["c"] in (1.0, None)
        assert r["m"]["n"] == n if r["m"]["bound"] == fingerprints.LARGEST else abs(r["m"]["n"] - n) < 0.25 * n


@pytest.mark.parametrize("most", [5, 2_000])
def test_next_row_with_outliers_hot_keys_and_nulls(spark, monkeypatch, most):
    monkeypatch.setattr(fingerprints, "NEIGHBOUR_ROWS", most)
    keys = [*range(100), (1 << 62), -(1 << 62), *[7] * 60, *[None] * 40]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "doc_id long, text string").repartition(3)
    tied = df.withColumn("tie", F.xxhash64("text"))
    got = fingerprints.with_next(tied, "doc_id", F.col("tie"), ["doc_id", "text"])
    order = [r["text"] for r in sorted(tied.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["tie"]))]
    assert {r["text"]: r["next"]["text"] for r in got.collect()} == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}
    if most == 5:
        placed = tied.withColumn("__tie", F.col("tie")).select(fingerprints._placed(tied.withColumn("__tie", F.col("tie")), "doc_id", len(keys)).alias("r"))
        assert placed.groupBy("r").count().agg(F.max("count")).first()[0] <= 25

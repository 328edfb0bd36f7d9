"""Sharding, license scan, sketches and chat formatting against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gaugeflow.llm import chat, fingerprints, kd_shards, licenses
from gaugeflow.llm._native import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_shards_are_near_equal_and_slots_gapless(docs):
    placed = kd_shards.kd_shards(docs.where("doc_id <> 64 or doc_id is null"), 4)
    rows = kd_shards.with_slots(placed.select("doc_id", "text", "shard", "size"), [F.col("doc_id"), F.crc32("text")]).collect()
    assert len(rows) == docs.count() - 1
    total = Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        total[r["shard"]] += r["size"]
    assert sorted(total) == [0, 1, 2, 3]
    assert max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in rows)
    for s in total:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_one_hot_text_is_spread_over_shards(spark):
    df = spark.createDataFrame([(i, "the same words " * 20, "en", "src0") for i in range(400)], "doc_id long, text string, lang string, source string")
    sizes = [r["count"] for r in kd_shards.kd_shards(df, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 20


def test_shards_of_an_empty_table(empty):
    assert kd_shards.with_slots(kd_shards.kd_shards(empty, 5), [F.col("doc_id")]).count() == 0


def test_license_base_places(docs, spark):
    rows = [(i, f"CC-BY cc by x{'y' * i} All  rights\nReserved general PUBLIC license. {t or ''} cc by") for i, t in enumerate(r["text"] for r in docs.limit(20).collect())]
    rows += [(100, None), (101, ""), (102, "cc by"), (103, "ccby scc by")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        w, places = words(r["text"]), []
        for phrase in licenses.BASE:
            p = phrase.split()
            places += [(k, licenses.BASE[phrase]) for k in range(len(w)) if w[k : k + len(p)] == p]
        assert r["n_words"] == len(w)
        assert sorted(places) == sorted((d["first"], d["label"]) for d in r["detections"] if d["base"])


def test_license_rules_suppress_what_they_contain(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "Licensed under CC BY-NC 4.0."), (3, "SPDX-License-Identifier: MIT"), (4, "the mit of no kind"), (5, "Copyright (c) 2020 x")]
    found = {r["doc_id"]: r["detections"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(d["label"], d["first"], d["end"]) for d in found[1]] == [("apache", 0, 8)]
    assert {d["label"] for d in found[2]} == {"cc-by", "cc-by-nc"}
    assert {d["label"] for d in found[3]} == {"mit"} and not found[4] and {d["label"] for d in found[5]} == {"copyright"}
    assert len(licenses.default_rules()) >= 300


def test_license_scan_keeps_rows_and_columns(docs, empty):
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert set(docs.columns) <= set(licenses.scan_licenses(docs).columns)
    assert licenses.scan_licenses(empty).count() == 0


def test_sketches_keep_every_low_hash(docs):
    every = docs.select("text", fingerprints.sketch(F.col("text"), scale=1).alias("all"), fingerprints.sketch(F.col("text"), scale=16).alias("low")).collect()
    bound = -(1 << 63) + (1 << 64) // 16
    for r in every:
        w = words(r["text"])
        assert len(r["all"]) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
        assert r["low"] == [h for h in r["all"] if h < bound]


def test_likeness_of_sketches(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 6000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
    r = df.select(fingerprints.jaccard(F.col("x"), F.col("y")).alias("j"), fingerprints.containment(F.col("x"), F.col("y")).alias("c"), F.size(fingerprints.merge(F.col("x"), F.col("y"))).alias("m")).first()
    assert abs(r["j"] - 1 / 3) < 0.1 and abs(r["c"] - 0.5) < 0.12 and r["m"] > 250


def test_next_row_wraps_and_takes_every_row(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "NEIGHBOUR_ROWS", 5)
    base = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    got = {r["doc_id"]: r["next"]["doc_id"] for r in fingerprints.with_next(base, "doc_id", F.xxhash64("text"), ["doc_id"]).collect()}
    ids = sorted(got, reverse=True)
    assert got == {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    assert fingerprints.with_next(docs, "doc_id", F.xxhash64("text"), ["doc_id"]).count() == docs.count()


def test_next_row_of_one_and_of_none(spark, empty):
    one = spark.createDataFrame([(9, "x")], "doc_id long, text string")
    assert fingerprints.with_next(one, "doc_id", F.lit(0), ["doc_id"]).first()["next"]["doc_id"] == 9
    assert fingerprints.with_next(empty, "doc_id", F.lit(0), ["doc_id"]).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "&lt;&amp;lt;&lsqb;[", "", None, "a\nb&", "&", "<|end|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", None, "<|end|>")[(c + t) % 4], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(8) for t in range(6)] + [(0, 0, "user", NASTY[0])] * 2 + [(None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(chat.message_events(df))
    read = done.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss"), "formatted").collect()
    assert len(read) == 9
    for r in read:
        mine = sorted(((t, role, text) for c, t, role, text in rows if c == r["conv_id"]), key=lambda x: (x[0], x[1] or "", x[2] or ""))
        assert sorted((x["role"], x["text"]) for x in r["turns"]) == sorted((role or "", text or "") for _, role, text in mine)
        assert sorted(r["loss"]) == sorted("".join(text or "" for _, role, text in mine if role == "assistant"))
        assert r["formatted"].count("<") == 3 * len(mine) and "[INST]" not in r["formatted"]


def test_events_are_folded_in_order(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "Hel"), (1, 2, "delta", 1, None, "lo"), (1, 3, "regenerate", 1, "assistant", "Good "), (1, 4, "delta", 1, None, "day"),
        (1, 5, "edit", 0, None, "hi there"), (1, 6, "message", 2, "user", "bye"), (1, 7, "delete", 2, None, "zzz"), (1, 8, "typing", 3, "user", "?"), (2, 0, "delta", 0, "user", None),
        (3, 0, "message", 0, "user", "x"), (3, 1, "delete", 0, None, "y"), (3, 2, "delta", 0, None, "z"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(4)
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold_events(df).collect())
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "Good day"), (2, 0, "user", ""), (3, 0, "user", "z")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_helpers_agree_with_hashlib(spark):
    r = spark.range(1).select(F.sha2(F.lit("é"), 256).alias("h"), F.crc32(F.lit("é")).alias("c")).first()
    assert r["h"] == hashlib.sha256("é".encode()).hexdigest() and r["c"] == zlib.crc32("é".encode())

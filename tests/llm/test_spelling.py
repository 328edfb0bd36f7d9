import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.llm import spelling
from gaugeflow.llm._scratch import Scratch

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(words):
    """Pairs that meet in what is left without one letter, at the same place or as a word."""
    words, out = set(words), set()
    less = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            less[i, v].add(w)
            if v in words:
                out |= {(v, w), (w, v)}
    for group in less.values():
        out |= {(a, b) for a in group for b in group if a != b}
    return out


def expected(rows, length=5, occurrences=3):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= occurrences}
    by = collections.defaultdict(list)
    for a, b in near(n):
        by[a].append(b)
    best = {a: min(bs, key=lambda b: (-n[b], b)) for a, bs in by.items()}
    form = {a: b for a, b in best.items() if n[b] >= 2 * n[a]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None)
    return out


def forms(df, **kw):
    got = spelling.spelling_forms(df, **kw).collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def test_equals_plain_python_on_odd_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert forms(docs) == expected(rows)


def test_chains_of_forms_lead_to_the_root(spark):
    g = random.Random(3)
    chain = {"stone": 96, "stono": 44, "stoni": 20, "shoni": 9, "chonis": 4, "choni": 4, "alone": 3}
    words = [w for w, n in chain.items() for _ in range(n)] + ["Éclair", "éclair", "éclair", "éclair"]
    g.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = forms(df)
    assert got == expected(rows)
    assert got["shoni"][1] == "stone" and got["shoni"][0] == "stoni"
    assert "Éclair" not in got  # É stays, so it occurs once


def test_empty_tables_and_texts_without_words(spark, empty):
    assert forms(empty) == {}
    assert forms(spark.createDataFrame([(1, None), (2, ""), (3, "12 ab")], "doc_id bigint, text string")) == {}


def test_very_long_words_take_few_levels(spark):
    g = random.Random(5)
    long = "".join(g.choices("abc", k=30_000))
    near_copy = long[:100] + ("a" if long[100] != "a" else "b") + long[101:]
    shorter, run = long[:29_000] + long[29_001:], "z" * 20_000
    rows = [(i, " ".join([long, near_copy, shorter, run, run + "z"])) for i in range(4)]
    got = forms(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = expected(rows)
    assert got == want and sum(x[3] for x in want.values()) >= 6


def test_length_below_three_is_refused(docs):
    with pytest.raises(ValueError):
        spelling.spelling_forms(docs, length=2)


def pairs(spark, words):
    scratch = Scratch(spark, "test")
    ids = dict(zip(spelling.word_ids(words).tolist(), words, strict=True))
    df = spark.createDataFrame(list(ids.items()), "id bigint, word string")
    return {(ids[r["a"]], ids[r["b"]]) for r in spelling.near_pairs(scratch, df).collect()}


@settings(max_examples=5, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=7) | st.text("abcé", min_size=3, max_size=5), min_size=2, max_size=120))
def test_pairs_of_any_short_words(spark, words):
    words = sorted(words)
    assert pairs(spark, words) == near(words)


def test_words_under_one_prefix(spark):
    g = random.Random(9)
    words = sorted({"prefix" + "".join(g.choices("abcde", k=g.randint(1, 6))) for _ in range(2500)})
    assert pairs(spark, words) == near(words)

import random
import zlib

import numpy as np
import pytest

from gaugeflow.llm import quality


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def corpus(n=600, seed=4):
    """Plain prose of quality 1, shouted, symbol-ridden or repeating text of quality 0."""
    g = random.Random(seed)
    words = ["".join(g.choices("abcdefghij", k=g.randint(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        t, good = g.choices(words, k=g.randint(15, 120)), g.random() < 0.7
        kind = g.randrange(3)
        if not good:
            t = [w.upper() + "!!" for w in t] if kind == 0 else [w + g.choice(["$$$", "###", "%%"]) for w in t] if kind == 1 else t[:1] * len(t)
        rows.append((i, " ".join(t)))
        labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(rows), dict(labels)


def test_held_out_rows_are_told_apart(tables):
    docs, labels, _, truth = tables
    got = quality.score_quality(docs, labels, keep=["doc_id"]).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    out = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)


def test_held_out_labels_and_unknown_columns_do_not_matter(spark, tables):
    docs, labels, _, truth = tables
    turned = spark.createDataFrame([(i, 1 - q if held(i) else q) for i, q in truth.items()], "doc_id bigint, quality int")
    a = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels, keep=["doc_id"]).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, turned, keep=["doc_id"]).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_model_equals_plain_densities(tables):
    """Class means, shrunk covariances and log-densities by a plain formula on the rows that the model learnt from."""
    docs, labels, texts, truth = tables
    model = quality.fit(docs, labels)
    x = quality.statistics([t.encode() for t in texts.values()])
    spark = docs.sparkSession
    tuned = {r["id"] for r in spark.createDataFrame([(i,) for i in texts], "id bigint").where("pmod(xxhash64(id), 5) = 0").collect()}
    learnt = np.array([not held(i) and i not in tuned for i in texts])
    y = np.array([truth[i] for i in texts])
    z = np.clip((x - x[learnt].mean(axis=0)) / np.where(x[learnt].std(axis=0) > 1e-9, x[learnt].std(axis=0), 1), -quality.REACH, quality.REACH)
    wanted = set()
    for pooled in quality.POOLED:
        for diagonal in quality.DIAGONAL:
            log = []
            common = sum((learnt & (y == k)).sum() * np.cov(z[learnt & (y == k)].T, bias=True) for k in (0, 1)) / learnt.sum()
            for k in (0, 1):
                own = z[learnt & (y == k)]
                c = (1 - pooled) * np.cov(own.T, bias=True) + pooled * common
                c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
                off = z - own.mean(axis=0)
                prior = np.log((len(own) + 1) / (learnt.sum() + 2))
                log.append(prior - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off))
            wanted.add(tuple(np.round((log[1] - log[0])[:50], 3)))
    got = np.round(model.evidence(x)[:50], 3)
    assert any(np.allclose(got, w, atol=2e-2) for w in wanted)


def test_statistics_of_pieces_equal_those_of_whole_texts(monkeypatch):
    g = random.Random(2)
    texts = ["".join(g.choices("abcABC 1$\n", k=g.choice([0, 1, 95, 96, 97, 500, 3000]))).encode() for _ in range(40)]
    whole = quality.statistics(texts)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert np.allclose(whole, quality.statistics(texts))


def test_statistics_by_hand():
    x = dict(zip(quality.NAMES, quality.statistics([b"ab ab CD.\n1$"])[0], strict=True))
    assert x["length"] == pytest.approx(np.log(13)) and x["upper"] == pytest.approx((2 / 12) ** 0.5) and x["digit"] == pytest.approx((1 / 12) ** 0.5)
    assert x["words"] == pytest.approx(np.log(5)) and x["commonest"] == pytest.approx(0.5**0.5) and x["same_next"] == pytest.approx((1 / 3) ** 0.5)
    assert x["worst_symbol"] == pytest.approx(2 / 12) and x["worst_upper"] == pytest.approx(2 / 12)


def test_odd_rows_keep_their_columns(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 0), (4, 1)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    scores = {}
    for r in got:
        scores.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in scores.values())
    assert quality.score_quality(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    for few in (none, one):
        assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, few).collect())

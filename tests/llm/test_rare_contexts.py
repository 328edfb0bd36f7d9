import random

import numpy as np

from gaugeflow.llm import toxicity


def table(spark, n=1200):
    """Ordinary rows of very many contexts; toxic ones say one rare word each, in contexts that are toxic only."""
    g = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    scrap = lambda k: "".join(g.choices(letters, k=k))
    rows = [(i, scrap(400) + (" ~#%~@ " if i % 100 == 0 else "") + scrap(400)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_no_context_of_the_labelled_rows_is_left_out(spark):
    df, labels = table(spark)
    model = toxicity.fit(df, labels)
    learnt = toxicity.training_labels(labels).where("not tune").select("id").collect()
    texts = {r["doc_id"]: r["text"].encode() for r in df.collect()}
    assert model.evidence([b"~#%~@ " * 4])[0] > 0.3
    contexts = set()
    for r in learnt:
        t = b"   " + texts[r["id"]]
        contexts |= {t[i : i + 3] for i in range(len(t) - 3)}
    assert len(contexts) > 1 << 15
    assert sum(len(b.value.contexts) for b in model.blocks) == len(contexts)


def test_blocks_of_a_model_make_no_difference(spark, monkeypatch):
    df, labels = table(spark, 200)
    texts = [r["text"].encode() for r in df.limit(40).collect()] + [b"", None, "é~#%~@\x00\xff".encode()]
    one = toxicity.fit(df, labels)
    monkeypatch.setattr(toxicity, "BLOCK_GRAMS", 5_000)
    many = toxicity.fit(df, labels)
    assert len(one.blocks) == 1 and len(many.blocks) > 4
    assert max(len(b.value.values) for b in many.blocks) <= 5_001
    assert np.array_equal(one.evidence(texts), many.evidence(texts)) and (one.slope, one.shift) == (many.slope, many.shift)

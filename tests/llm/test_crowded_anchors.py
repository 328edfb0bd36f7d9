import random

from gaugeflow.llm import column_dedup
from test_free_operators import brute_removed


def test_a_gram_twice_in_a_text_is_no_repeat(spark, monkeypatch):
    """Crowded or not, strings that hold their anchor at two places occur once."""
    g = random.Random(11)
    length, gram = 100, 16
    word = lambda k: "".join(g.choices("abcdefghijklmnop", k=k))
    hot = min((word(gram) for _ in range(3000)), key=lambda x: int(column_dedup._strings(column_dedup._running(_bytes(x)), column_dedup.np.array([0]), column_dedup.np.array([gram]))[0]))
    texts = [word(90) + hot + word(20 + i) + hot + word(90) for i in range(12)]
    texts += [texts[0][50:210] + word(60), word(40) + texts[1][60:180]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(brute_removed([t.encode() for t in texts], length)))
    assert sum(n > 0 for _, n, *_ in want.values()) == 4
    for shared in (5_000, 2):
        monkeypatch.setattr(column_dedup, "SHARED", shared)
        assert {r["doc_id"]: tuple(r)[1:] for r in column_dedup.remove_repeats(df, length, gram).collect()} == want


def _bytes(text):
    return column_dedup.np.frombuffer(text.encode(), column_dedup.np.uint8)

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score string, size string"


def make_docs(seed=7, n=60):
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing columns."""
    g = random.Random(seed)
    vocabulary = ["".join(g.choices("abcdefgé", k=g.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(g.choices(vocabulary, k=k))
    passage = text(90)
    out = []
    for i in range(n):
        t = text(g.randint(1, 150))
        if i % 10 == 3:
            t = out[g.randrange(len(out))][1] if out else t
        if i % 10 == 5 and out:
            words = (out[g.randrange(len(out))][1] or "x").split(" ")
            words[g.randrange(len(words))] = "Changed"
            t = " ".join(words)
        if i % 7 == 2:
            t = t + ". " + passage + "\n" + text(20)
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "word"), (None, text(30)), (n + 4, text(30_000)), (5, out[5][1]), (6, out[6][1]), (n + 5, "a " * 900)]
    return [(i, t, g.choice(["en", "de", None]), g.choice(["s1", "s2", None]), None, "clash", "clash", "clash") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.llm import alignment


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(alignment.FOLDER)


class Plain:
    """Whole texts through the libraries, tokens compared pair by pair."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.BY_PIECES}")

    def tokens(self, text):
        if not text:
            return None
        letters = alignment.byte_of_letter()
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = b" " + text.encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return None
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        return spans

    def rows(self, texts):
        held, counts = [], collections.Counter()
        for t in texts:
            spans = self.tokens(t)
            links = []
            if spans:
                a, b = spans
                j = 0
                for s, e, i in a:
                    while b[j][1] <= s:
                        j += 1
                    k = j
                    while k < len(b) and b[k][0] < e:
                        links.append((i, b[k][2]))
                        k += 1
            counts.update(links)
            held.append((spans, links))
        best = collections.Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        for spans, links in held:
            if not spans:
                yield 0, 0, 0, 0, 0, 0, ""
                continue
            a, b = spans
            both = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
            groups, low = [], 0
            for end in both:
                groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= end) for side in spans))
                low = end
            n_best = sum(counts[x] == best[x[1]] for x in links)
            yield len(a), len(b), len(groups), len(links), n_best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()


def values(df, *more):
    return sorted(tuple(r) for r in df.select(*more, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


ODD = [None, "", " ", "  two  blanks ", "▁x", "a▁b c", "<s> hi </s>", "<|endoftext|> end", "<0x41>", "tab\tand\r\nline \n x", "日本語 テキスト", "🙂 smile🙂🙂", "é è ﬁ", "\x00\x1c\x85 \xa0x", "x" * 5000, "no-break space a   b"]


@pytest.mark.parametrize("frequent", [0, 40, 1_000_000])
def test_equals_plain_python(spark, plain, frequent):
    g = random.Random(1)
    words = ["".join(g.choices("etaoinshrdluéü", k=g.randint(1, 11))) for _ in range(200)]
    texts = ODD + [" ".join(g.choices(words, k=g.randint(1, 60))) for _ in range(60)]
    texts += texts[20:26]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = values(alignment.align_tokenizers(df, keep=["doc_id"], frequent=frequent), "doc_id")
    assert got == [(i, *r) for i, r in enumerate(plain.rows(texts))]


def test_whole_documents_of_the_test_table(spark, plain):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = values(alignment.align_tokenizers(df, keep=["doc_id"]), "doc_id")
    assert got == sorted((r["doc_id"], *x) for r, x in zip(rows, plain.rows([r["text"] for r in rows]), strict=True))


def test_odd_rows_keep_their_columns(spark, plain, docs, empty):
    df = docs.withColumnRenamed("shard", "n_a").withColumnRenamed("size", "Pairs")
    out = alignment.align_tokenizers(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    texts = [r["text"] for r in docs.select("text").collect()]
    assert values(out) == sorted(plain.rows(texts))
    assert alignment.align_tokenizers(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeno ,.\n\t▁é1!") | st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=3))
def test_words_one_by_one_give_the_tokens_of_the_text(tools, plain, texts):
    for text, ids in zip(texts, tools.encode(texts), strict=True):
        spans = plain.tokens(text)
        assert (ids is None) == (spans is None)
        if spans:
            assert [x.tolist() for x in ids] == [[i for _, _, i in side] for side in spans]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_common_ends(a, b):
    x, y = sorted(a | {61}), sorted(b | {61})
    both = [v for v in x if v in set(y)]
    assert alignment.common_ends(x, y) == ([x.index(v) for v in both], [y.index(v) for v in both])


def test_long_stretches_are_jumped():
    class Counted(list):
        looks = 0

        def __getitem__(self, key):
            Counted.looks += 1
            return super().__getitem__(key)

    x = list(range(1, 100_001))
    y = x[:50_000] + x[50_001:]
    got = alignment.common_ends(Counted(x), Counted(y))
    assert got == ([i for i in range(100_000) if i != 50_000], list(range(99_999)))
    assert Counted.looks < 300


def test_memo_is_bounded(tools, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 50)
    before = [[x.tolist() for x in ids] for ids in tools.encode([f"word{i} other{i}" for i in range(200)])]
    after = [[x.tolist() for x in ids] for ids in tools.encode([f"word{i} other{i}" for i in range(200)])]
    assert before == after and len(tools.known) <= 400
    assert np.array_equal(tools.a_sizes, [len(x) for x in tools.a_bytes])

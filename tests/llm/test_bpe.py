import base64
import random

import pytest

pytest.importorskip("palimpsest.llm")

import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import bpe

RANKS = bpe.DEFAULT_VOCABULARY.replace(".json", ".tiktoken")

ODD = [
    "", " ", "\n\n  x", "it's I'LL we'd 'tis", "a  b   c", "tabs\t\tand\r\nlines   x", "x\x1c\x1d y\x85z", "<|endoftext|>", "naïve café ﬁn Ⅳ ½ ²", "汉字 漢字　仮名",
    "퟿�\U0001f600\U0001f468‍\U0001f469", "=" * 1001, "ab" * 777, "a" * 4000, "\\begin{equation}\\alpha_{12}^{-3}\\end{equation}", "1234567890" * 30, "_" * 7 + "é" * 500,
]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_every_token_of_the_vocabulary_is_encoded_as_by_the_library(reference):
    enc, ranks = reference
    words = [t.decode() for t in ranks if t.isascii() and len(t) > 1]
    got = bpe.encoder(bpe.DEFAULT_VOCABULARY).encode(words)
    assert [x.tolist() for x in got] == [enc.encode_ordinary(w) for w in words]


def test_odd_and_random_texts(reference):
    enc, _ = reference
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcxyz  \n'\"é漢́.,;12\\{}") for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += ["".join(rng.choice("etaoin") for _ in range(6000)), "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(3000))]
    got = bpe.encoder(bpe.DEFAULT_VOCABULARY).encode(texts)
    for t, x in zip(texts, got):
        assert x.tolist() == enc.encode_ordinary(t), t[:50]
        assert enc.decode(x.tolist()) == t


def test_rounds_and_recursion_agree(reference, monkeypatch):
    enc, _ = reference
    monkeypatch.setattr(bpe, "LONG_PIECE", 2)
    assert bpe.Encoder(bpe.DEFAULT_VOCABULARY).encode(["unbelievably strange aaaaaaa"])[0].tolist() == enc.encode_ordinary("unbelievably strange aaaaaaa")


def test_a_full_cache_changes_nothing(reference, monkeypatch):
    enc, _ = reference
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 5)
    texts = ["first words", "other words", "", "first again"]
    assert [x.tolist() for x in bpe.Encoder(bpe.DEFAULT_VOCABULARY).encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_no_word_runs_on(reference, monkeypatch):
    enc, _ = reference
    monkeypatch.setattr(bpe, "SLICE_CHARS", 7)
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("ab1'.\x1c \n\t\u3000é") for _ in range(400)) for _ in range(50)]
    for t in texts:
        assert "".join(bpe.text_parts(t)) == t
    assert max(len(bpe.text_parts(t)) for t in texts) > 10
    assert [x.tolist() for x in bpe.Encoder(bpe.DEFAULT_VOCABULARY).encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_columns_nulls_and_repeats(spark, reference):
    enc, _ = reference
    rows = [(1, None, 9), (2, "", 9), (3, "hello world", 9), (3, "hello world", 9), (None, "x", 9), (4, "long " * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode_column(df)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in out.collect()))
    assert got == sorted((i or 0, enc.encode_ordinary(t or "")) for i, t, _ in rows)
    assert bpe.encode_column(df.limit(0)).count() == 0
    assert out.filter(F.col("ids").isNull()).count() == 0

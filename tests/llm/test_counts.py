"""Counts against the libraries' own of whole texts."""

import random

import pytest

from plumbline.llm import counts as C
from plumbline.llm.queries import tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def whole(name, text):
    if name.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=tokenizer(name)).encode(text or ""))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids)


def texts(seed=5):
    r = random.Random(seed)
    bits = ["word", "Words", "it's", "123", "4.5", "é", "é", "日本", "😀", "<|endoftext|>", "▁", "...", "\n", "\t", "  ", " ", "　", "\x1c", "\x00", "-", "ΑΣ", "İ."]
    mixed = lambda n: "".join(r.choice(bits) + " " * (r.random() < 0.6) for _ in range(n))
    return [
        None, "", " ", "short text", mixed(400), mixed(3000), "a " * 900, " " * 1500, "x" * 2500, "one " + "y" * 1200 + " two " * 300, "no-space-" * 300,
        "<|endoftext|>" * 120, "́" * 700 + " end", ("line one\nline two\n\n" * 90), "日本語" * 400 + " " + "汉字" * 300,
    ]


@pytest.mark.parametrize("name", FILES)
def test_counts_of_the_library(spark, name):
    rows = [(k, t, "extra") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in C.count_tokens(docs, tokenizer(name), limit=100, chunk=128, overlap=16).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        assert (got[k].n_tokens, got[k].n_bytes) == (whole(name, t), len((t or "").encode())), (name, k)
        assert got[k].over_limit == (got[k].n_tokens > 100)


def test_boundaries_need_both_sides():
    c = C.counter(tokenizer("word_bpe_49k.json"))
    assert c.kind == "dropped"
    ids, begin, end = c.offsets("alpha beta gamma")
    assert [x[:2] for x in c.boundaries("alpha beta gamma", 0, 16, ids, begin, end)] == [(6, int((begin < 6).sum())), (11, int((begin < 11).sum()))]
    assert c.boundaries("alpha beta gamma", 11, 16, ids, begin, end) == []  # the overlap's first character may be another's last


def test_keys_and_nothing(spark):
    schema = "doc_id long, text string"
    path = tokenizer("word_bpe_49k.json")
    assert C.count_tokens(spark.createDataFrame([], schema), path).count() == 0
    rows = [(None, "a b " * 200), (3, "a b c " * 100), (3, "a"), (None, None)]
    got = sorted((str(r.doc_id), r.n_tokens) for r in C.count_tokens(spark.createDataFrame(rows, schema), path, chunk=64, overlap=8).collect())
    assert got == [("3", 1), ("3", 300), ("None", 0), ("None", 400)]

"""Words made to meet under sums modulo a power of two: those of Thue and Morse and their complements."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm import _tok
from plumbline.llm.jaccard import jaccard_join
from plumbline.llm.lm import language_model_scores
from plumbline.llm.queries import tokenizer
from plumbline.llm.rules import quality_rules

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def pairs(low=8, high=14):
    a, b = "a", "b"
    for k in range(1, high + 1):
        a, b = a + b, b + a
        if k >= low:
            yield a, b


def library(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]


def ids(encoder, texts):
    return [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(texts)]


def test_hashes_differ():
    some = {T.word_hash(w) for pair in pairs(3) for w in pair}
    assert len(some) == 2 * len(list(pairs(3)))
    value = lambda w: sum((b + 1) * pow(T.BASE, i, T.PRIME) for i, b in enumerate(w)) % T.PRIME
    for w in (b"x", "né\u0000".encode(), bytes(range(33, 128)) * 40):
        want = int(T.sealed(np.array([value(w)], np.uint64), np.array([len(w)], np.uint64))[0])
        raw = np.frombuffer(b" " + w, np.uint8)
        assert int(T.hashes(raw, np.array([1]), np.array([len(raw)]))[0]) == want
        assert T.joined_hash([raw[1:2], raw[2:]]) == want


@pytest.mark.parametrize("name", FILES)
def test_ids(name):
    texts = [t for a, b in pairs() for t in (f"{a} x", f"{b} x", b, a)] + [f"{a[:180]} {b[:180]} {a[:180]}" for a, b in pairs()]
    assert ids(_tok.Encoder(tokenizer(name)), texts) == library(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_ids_where_all_words_have_one_hash(name, monkeypatch):
    monkeypatch.setattr(T, "hashes", lambda text, begin, end, lower=False: np.full(len(begin), 7, np.uint64))
    texts = ["one two three", "one", "two one", "x" * 300 + " y", "z" * 300, "three\none two"]
    e = _tok.Encoder(tokenizer(name))
    assert ids(e, texts) == library(name, texts) and ids(e, texts) == library(name, texts)
    big = "one two three four " * 80_000
    raw, off = T.buffers(pa.array([big + "end"], pa.large_string()))
    assert np.concatenate([x for x, _ in e.encode_texts(raw, off)]).tolist() == library(name, [big + "end"])[0]


def test_a_part_with_more_words_than_the_table(monkeypatch):
    e = _tok.Encoder(tokenizer(FILES[1]))
    e.table = _tok._Table(100)
    text = " ".join(f"w{i}" for i in range(200_000)) + " end"
    assert ids(e, [text]) == library(FILES[1], [text])


def test_links_counts_and_scores(spark):
    (a, b), *_ = pairs(10)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y {b} x y\n{a}\n{b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(docs).collect()} == {1: 1, 2: 2, 3: 3}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    r = quality_rules(docs, labels).where("doc_id = 3").first()
    assert (r.n_repeat_words, r.n_dup_lines) == (0, 0)
    known = {r.doc_id: r.n_known for r in language_model_scores(docs.where("doc_id < 3"), F.col("doc_id") == 1).collect()}
    assert known == {1: 2, 2: 1}  # the end of a text is known

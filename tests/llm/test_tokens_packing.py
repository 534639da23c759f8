import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import _text as T
from plumbline.llm import _tok
from plumbline.llm import tokens as K
from plumbline.llm._tok import Encoder
from plumbline.llm.packing import pack_documents, place_pieces

TEXTS = [
    "", None, "a", " a", "a ", "a  b", "a\n\nb", "x\ty z", "<|endoftext|> foo<|endoftext|>\nbar", "foo <|endoftext|>", "é b", "a b c", "Don't I'll 'S\n's",
    "\x1c a\x1db", "a\r\nb c", "\rq w", "w \re", "123 4567\n89", "日本 語。x", "ΣΑΣ Σ", "x!! \n.. Ab,c. É!", "İa ÉÈ, ab_ µ.", "a<|endoftext|>.. b", "İ.", "aİ, İİ?! i̇.", "word " * 9000, "z" * 5000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    path = public_tokenizers.path(name)
    texts = [t or "" for t in TEXTS]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(path)
    assert enc.kind != "whole"
    for _ in range(2):
        assert [np.frombuffer(b, np.uint32).tolist() for b in enc.encode(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_letters_before_punctuation(name):
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), Encoder(path)
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xA0, 0x250), 0x300, 0x307, 0x345, 0x3A3, 0x1E9E, 0x212B]]
    texts = [h + a + b + p + t for a in letters for b in ("", "i") for p in (".", ",!", "'s", "-x") for h, t in (("", ""), ("b ", " c"))]
    r = random.Random(3)
    texts += ["".join(r.choices([*letters, *" \n.,;:'\"-!?()", "1", "İ", "<|endoftext|>"], k=r.randint(1, 9))) for _ in range(20_000)]
    want = [np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_in_segments(name, monkeypatch):
    monkeypatch.setattr(_tok, "SEGMENT", 20)
    monkeypatch.setattr(T, "SLICE", 15)
    path = public_tokenizers.path(name)
    r = random.Random(8)
    texts = ["".join(r.choices(["word", "İa.", "don't", "é", "日本", "12", " ", " ", " ", "\n", "  ", "\t", "<|endoftext|>", "Σ", "_"], k=r.randint(0, 90))) for _ in range(400)]
    tok, enc = Tokenizer.from_file(path), Encoder(path)
    want = [np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and max(len(enc._segments(t)) for t in texts) > 5
    plain = [" ".join(t.split()) for t in texts]
    assert enc.encode(plain) == [np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(plain, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_table_begins_anew(name):
    path = public_tokenizers.path(name)
    tok, enc = Tokenizer.from_file(path), Encoder(path)
    enc.table = _tok._Table(300)
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(900)}" for _ in range(r.randint(0, 60))) for _ in range(300)] + ["long" * 90 + " a " + "long" * 90, "x" * 300 + "\n" + "x" * 300]
    want = [np.array(e.ids, np.uint32).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert sum([enc.encode(texts[k : k + 5]) for k in range(0, len(texts), 5)], []) == want and enc.encode(texts) == want


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 32), st.data())
def test_pack_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=60)), np.uint32)
    raw = K.pack(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    i = data.draw(st.integers(0, len(ids)))
    j = data.draw(st.integers(i, len(ids)))
    assert K.unpack(raw, width, i, j).tolist() == ids[i:j].tolist()


@pytest.mark.parametrize("n,width", [(2, 1), (32_000, 15), (49_408, 16), (65_536, 16), (65_537, 17)])
def test_width(n, width):
    assert K.width_of(n) == width


def rows():
    return [(k * 7 % 31, t, "x") for k, t in enumerate(TEXTS)]


def test_written_and_read(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame(rows(), "doc_id long, text string, ids string").repartition(3)
    K.write_tokens(df, f"{tmp_path}/t", path, 2)
    got = K.read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect()
    start = 0
    for r, (k, t, _) in zip(got, sorted(rows()), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (k, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = K.read_range(spark, f"{tmp_path}/t", 3, 60).collect()
    assert {r.doc_id for r in some} == {r.doc_id for r in got if r.start < 60 and r.start + r.n_tokens > 3}


def test_odd_tables(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    K.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", path, 2)
    assert K.read_tokens(spark, f"{tmp_path}/e").collect() == []
    df = spark.createDataFrame([(None, "b"), (4, "a"), (4, "a"), (4, None)], "doc_id long, text string")
    K.write_tokens(df, f"{tmp_path}/n", path, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in K.read_tokens(spark, f"{tmp_path}/n").collect())
    assert [x[1] for x in got] == [None, 4, 4, 4] and sum(x[2] for x in got) == 7
    assert pack_documents(df.limit(0), path).collect() == []


def plain(lengths, capacity):
    """The rule as stated, by trying every place."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for b in [*sorted(range(len(gaps)), key=lambda b: gaps[b]), len(gaps)]:
            if b < len(gaps) and gaps[b] < s:
                continue
            after = [*gaps, capacity] if b == len(gaps) else list(gaps)
            after[b] -= s
            n = np.bincount([g for g in after if g], minlength=1)
            cost = int((n * n).sum())
            if best is None or cost < best[0]:
                best = (cost, b, after)
        gaps = best[2]
        out.append(gaps[best[1]])
    return sorted(gaps), out


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_rule(lengths):
    b, at, gap = place_pieces(np.array(lengths, np.int64), 20)
    used = {}
    for i, s in enumerate(lengths):
        assert used.get(b[i], 0) == at[i]
        used[b[i]] = at[i] + s
    assert all(u <= 20 for u in used.values())
    assert all(20 - used[b[i]] == gap[i] for i in range(len(lengths)))
    assert sorted(20 - u for u in used.values()) == plain(lengths, 20)[0]


def test_packed(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    data = rows() + [(100 + i, "some words here " * (i * 13 % 170), "y") for i in range(300)]
    got = pack_documents(spark.createDataFrame(data, "doc_id long, text string, row string").repartition(3), path).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    total = 0
    for k, t, _ in data:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        p = sorted(by[k], key=lambda r: r.piece)
        assert b"".join(bytes(r.tokens) for r in p) == ids.tobytes()
        assert [r.piece for r in p] == list(range(len(p))) and all(r.length == 2048 for r in p[1:])
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.tokens)) and r.length == len(r.tokens) // 4 for r in p)
        assert [r.start for r in p] == [sum(x.length for x in p[:i]) for i in range(len(p))]
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 2

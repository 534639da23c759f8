"""Alignment of whole texts by both libraries, in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import align as A
from plumbline.llm.queries import tokenizer

NAMES = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    both = A.Pair(*map(tokenizer, NAMES))
    found, counts = [], Counter()
    for t in texts:
        want = (" " + (t or "")).encode()
        a = both.a.encode(" " + (t or ""), add_special_tokens=False).ids
        b = both.b.encode(t or "")
        x, y = [both.a_bytes[i] for i in a], [both.b_bytes.get(i, b"?") for i in b]
        if not t or b"".join(x) != want or b"".join(y) != want:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in x]).tolist(), np.cumsum([len(p) for p in y]).tolist()
        links = [(p, q) for p, (e, s) in zip(a, zip(ends_a, [0, *ends_a], strict=False), strict=True) for q, (f, r) in zip(b, zip(ends_b, [0, *ends_b], strict=False), strict=True) if s < f and r < e]
        counts.update(links)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        found.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, q), c in counts.items():
        most[q] = max(most[q], c)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for f in found
    ]


def odd_texts(seed, n):
    r = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", " \n", " ", "　", " ", "a", "The", "tokenization", "123", "4567.89", "é", "naïve", "日本語", "𝒳", "😀👍🏽", "<|endoftext|>", "</s>", "<0x41>", "don't", ",", "...", "-", "ﬁ", "é", "\x00", "\x1c", "’", "“", "aaaaaaaa", "\r\n"]
    return ["".join(r.choice(bits) + (" " if r.random() < 0.4 else "") for _ in range(r.randrange(1, 14))) for _ in range(n)]


TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a ", "a\n", "the same words, the same words", "the same words, the same words", "x▁y", "<|endoftext|> and </s>", "𝒳" * 40, "ab" * 3000, "0123456789" * 50]


def test_whole_texts_by_brute_force(spark):
    texts = TEXTS + odd_texts(1, 300)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, seg string")
    got = {r[0]: tuple(r[1:]) for r in A.align(docs, *map(tokenizer, NAMES)).select("doc_id", *COLUMNS).collect()}
    want = brute(texts)
    for k, w in enumerate(want):
        assert got[k] == w, (texts[k], got[k], w)


def test_words_spell_what_whole_texts_do():
    both = A.Pair(*map(tokenizer, NAMES))
    assert both.words
    for t in odd_texts(2, 3000):
        raw = np.frombuffer((" " + t).encode(), np.uint8)
        at = [*A.starts(raw, 0, len(raw)).tolist(), len(raw)]
        a, b, good = both.tokens([raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])
        assert good.all()
        assert [i for x in a for i in x] == both.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        assert [i for x in b for i in x] == both.b.encode(t), repr(t)


@pytest.mark.parametrize("small", [False, True])
def test_small_books_and_whole_texts_as_words(spark, monkeypatch, small):
    texts = odd_texts(3, 40)
    if small:  # tasks run in this test's machine but in other processes: a smaller book by its bound's default
        texts = [t * 3 for t in texts]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in A.align(docs, *map(tokenizer, NAMES)).select("doc_id", *COLUMNS).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_nothing_nulls_and_repeated_keys(spark):
    schema = "doc_id long, text string"
    assert A.align(spark.createDataFrame([], schema), *map(tokenizer, NAMES)).count() == 0
    rows = [(None, "one two"), (7, "one two"), (7, "three"), (None, None)]
    got = sorted((str(r.doc_id), r.n_a, r.n_links) for r in A.align(spark.createDataFrame(rows, schema), *map(tokenizer, NAMES)).collect())
    assert [g[0] for g in got] == ["7", "7", "None", "None"] and {g[1] for g in got if g[0] == "None"} == {0, 2}


def test_codes_come_back():
    r = np.random.default_rng(1)
    for codes in (np.zeros(0, np.int64), np.array([0, 1, 32767, 32768, A.CODES - 1]), r.integers(0, A.CODES, 5000)):
        assert A.unpacked(A.packed(codes), len(codes)).tolist() == codes.tolist()

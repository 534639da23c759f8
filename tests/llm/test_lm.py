import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm


def learn():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


def made():
    r = random.Random(2)
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = a if i % 2 else b  # two languages
        rows.append((i, " ".join(r.choices(w, [1 / (k + 1) for k in range(60)], k=r.randint(5, 120))) + (f" rare{i % 90} Rare{i % 3}" if i % 3 else ""), 1))
    return [*rows, (1000, None, 1), (1001, "", 1), (1002, "never seen", 1), (1003, " a1\tA1\n", 1)]


def test_scores(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(4)
    got = {x.doc_id: x for x in lm.language_model_scores(docs, learn()).collect()}
    assert len(got) == len(rows)
    c = Counter()
    words = {k: (t or "").encode().lower().split() + [None] for k, t, _ in rows}
    for k, w in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    held = base = 0
    for k, w in words.items():
        x = got[k]
        want = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[t] > 0 for t in w), n)
        assert abs(x.base_score - want) < 1e-6 and x.score < 0
        if not x.learnt and len(w) > 5:
            held, base = held + x.score, base + x.base_score
    assert held > 0.95 * base  # context tells the two languages apart


@pytest.mark.parametrize("words", [0, 5, 960, 961, 991, 992, 5000, 40_000])
def test_sums_to_one(words):
    rng = np.random.default_rng(0)
    common = np.unique(rng.integers(1, 1 << 62, words).astype(np.uint64))
    v = lm.Vocabulary.of(common, rng.integers(1, 900, len(common)), 30_000_000, 90_000, 50)
    m = lm.Model(v)
    m.outer += rng.standard_normal(m.outer.shape).astype(np.float32)
    m.inner += rng.standard_normal(m.inner.shape).astype(np.float32)
    codes = np.concatenate([np.arange(len(common)), [lm.ENDS, lm.OUTSIDE]])
    h = np.full(len(codes), 12345, np.uint64)
    assert abs((10 ** m.log10(h, h, codes)).sum() - 1) < 1e-3


def test_rows_grow():
    size = lambda n: lm.Vocabulary(n, 1, 1, *[np.zeros(0, np.int64)] * 3).rows
    assert [size(n) for n in (0, 1 << 22, 1 << 25, 1 << 28, 1 << 60)] == [13, 13, 14, 15, 18]


def test_tokens():
    h = np.arange(10, 15, dtype=np.uint64)
    e, own, one, two = lm.tokens(h, np.array([0, 2, 2, 5]))
    E, S = lm.END, lm.START
    assert e.tolist() == [10, 11, E, E, 12, 13, 14, E]
    assert own.tolist() == [0, 0, 0, 1, 2, 2, 2, 2]
    assert one.tolist() == [S, 10, 11, S, S, 12, 13, 14]
    assert two.tolist() == [S, S, 10, S, S, S, 12, 13]


def test_odd_tables(spark):
    df = spark.createDataFrame([(2, "a b", 0), (2, "a b", 0), (None, "a", 0), (None, None, 0)], "doc_id long, text string, key int")
    got = sorted(((x.doc_id, x.n_tokens, x.n_known, x.train_tokens) for x in lm.language_model_scores(df, learn()).collect()), key=str)
    assert got == [(2, 3, 3, 6), (2, 3, 3, 6), (None, 1, 1, 6), (None, 2, 2, 6)]
    assert lm.language_model_scores(df.limit(0), learn()).collect() == []
    got = lm.language_model_scores(df, F.lit(False)).collect()
    assert {(x.n_known, x.train_tokens) for x in got} == {(0, 0)} and all(math.isfinite(x.score) for x in got)


def test_slopes_are_summed_as_by_reduceat_but_faster():
    r = np.random.default_rng(3)
    rows, slope = np.concatenate([np.arange(1500), r.integers(0, 400, 548)]), r.normal(size=(2048, lm.WIDTH)).astype(np.float32)
    o = np.argsort(rows, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(rows[o]) > 0]))
    n = np.diff(np.append(cut, len(rows)))
    plain = lambda: np.add.reduceat(slope.take(o, axis=0), cut, axis=0)
    assert (lm._summed(slope, o, cut, n) == plain()).all() and set(n) >= {1, 2, 3}

    def best(f):
        out = []
        for _ in range(30):
            t = time.perf_counter()
            f()
            out.append(time.perf_counter() - t)
        return min(out)

    assert best(lambda: lm._summed(slope, o, cut, n)) < best(plain)

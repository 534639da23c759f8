import random

import numpy as np
import pyarrow as pa

from plumbline.llm import _text as T
from plumbline.llm import knn


def test_svd():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 40))
    s, v = knn.randomised_svd(x, 5)
    assert np.allclose(s, np.linalg.svd(x)[1][:5])
    assert np.allclose(x @ v @ v.T, x)


def test_votes_are_brute_force():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))(rng.standard_normal((n, 6)).astype(np.float32))
    m = knn.NeighbourModel(np.zeros((1, 6)), unit(90), rng.integers(0, 2, 90).astype(float))
    v = unit(700)
    for got, x in zip(m.votes(v), v, strict=True):
        cos = m.vectors @ x
        near = np.argsort(cos)[-knn.NEIGHBOURS :]
        w = np.maximum(cos[near], 0).astype(float) ** knn.POWER
        assert abs(got - (w * m.labels[near]).sum() / w.sum()) < 1e-4
    assert m.votes(np.zeros((2, 6), np.float32)).tolist() == [m.prior] * 2


def test_project_in_parts():
    texts = ["a b c", "", "x " * 70_000 + "y", "z"]
    raw, off = T.buffers(pa.array(texts))
    table = np.random.default_rng(2).standard_normal((knn.WORDS + knn.SHAPES, 3)).astype(np.float32)
    got = knn._unit(knn._sums(*knn.text_features(raw, off)[:3], table))
    w, s, f, _ = knn.text_features(raw, off)
    for k in range(4):
        want = (table[w[f[k] : f[k + 1]]].astype(float) + table[s[f[k] : f[k + 1]]]).sum(axis=0)
        assert np.allclose(got[k], want / (np.linalg.norm(want) or 1), atol=1e-3)


def test_held_out(spark):
    r = random.Random(3)
    good, junk = [f"wo{i}" for i in range(200)], [f"wo{i}!!" for i in range(200)]
    rows = [(i, " ".join(r.choices(junk if i % 5 == 0 else good, k=60)), 1) for i in range(600)] + [(1000, None, 1), (None, "", 1), (7, "wo1 wo2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = knn.fit(docs, labels, most=200)
    assert len(model.labels) == 200
    got = knn.knn_quality(docs, model).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is not None and 300 <= x.doc_id < 600:
            assert x.predicted == int(x.doc_id % 5 != 0)
        assert 0 <= x.score <= 1
    assert abs([x.score for x in got if x.doc_id == 1000][0] - model.prior) < 1e-9
    none = knn.fit(docs, labels.limit(0))
    assert {x.score for x in knn.knn_quality(docs, none).collect()} == {0.5}
    assert knn.knn_quality(docs.limit(0), model).collect() == []

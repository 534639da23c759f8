"""Very long texts are worked on in pieces; cut small, the pieces give what whole texts give."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import _text as T
from plumbline.llm import decontam, jaccard, knn, lm, rules
from tests.llm.test_rules import plain

SIZES = [7, 40, 300]


def made(seed=5):
    r = random.Random(seed)
    words = ["a", "b", "İa", "C#", "the", "x" * 30, "é", "9|9"]
    line = lambda: r.choice([" ", "  ", "\t"]).join(r.choices(words, k=r.randint(0, 9)))
    lines = [line() for _ in range(12)] + ["", " ", "\x0b"]
    out = ["\n".join(r.choices(lines, k=r.randint(1, 60))) for _ in range(12)]
    return out + ["", "one", "one two three", "y" * 900, "y" * 900 + "\n" + "y" * 900 + " ", " ".join(["q" * 200] * 7), "\n" * 500, " " * 500, "z " * 400 + "\n" + "z " * 400]


@pytest.fixture(params=SIZES)
def both(request, monkeypatch):
    """f of the texts in whole and in pieces."""
    raw, off = T.buffers(pa.array(made()))
    size = T.SLICE

    def run(f):
        monkeypatch.setattr(T, "SLICE", size)
        whole = f(raw, off)
        monkeypatch.setattr(T, "SLICE", request.param)
        return whole, f(raw, off)

    return run


def test_shingles(both):
    for a, b in zip(*both(lambda raw, off: list(jaccard.shingle_sets(raw, off, 5))), strict=True):
        assert np.array_equal(a, b)


def test_plain_counts(both):
    a, b = both(rules.counts)
    assert a.tolist() == b.tolist() == [plain(t) for t in made()]


def test_ratios(both):
    w = np.random.default_rng(1).standard_normal(1 << 12).astype(np.float32)
    a, b = both(lambda raw, off: rules._mean_weight(raw, off, w, 12))
    assert np.allclose(a, b)


def test_tokens_with_their_histories(both):
    def f(raw, off):
        out = [[] for _ in off[1:]]
        for p, (e, own, one, two) in lm._sliced(raw, off):
            for row in zip(own.tolist(), e.tolist(), one.tolist(), two.tolist(), strict=True):
                out[p.low + row[0]].append(row[1:])
        return out

    a, b = both(f)
    assert a == b


def test_scores_of_neighbours(both):
    r = np.random.default_rng(2)
    m = knn.NeighbourModel(r.standard_normal((knn.WORDS + knn.SHAPES, 8)).astype(np.float32), knn._unit(r.standard_normal((40, 8)).astype(np.float32)), r.integers(0, 2, 40).astype(float))
    a, b = both(lambda raw, off: m.score_arrow(pa.array(made())))
    assert np.allclose(a, b, atol=1e-4)
    a, b = both(lambda raw, off: list(knn._sparse([pa.RecordBatch.from_arrays([pa.array(range(len(off) - 1)), pa.array([1] * (len(off) - 1)), pa.array(made())], ["key", "label", "text"])])))
    assert a == b


def test_sketch_and_search(both, monkeypatch):
    monkeypatch.setattr(decontam, "SPAN", 11)
    monkeypatch.setattr(decontam, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = pa.RecordBatch.from_arrays([pa.array(made())], ["text"])
    for a, b in zip(*both(lambda raw, off: list(decontam._gather([texts]))), strict=True):
        assert a.slice(0, 1).column("df") == b.column("df") and a.column("texts") == b.column("texts")
        x, y = (np.frombuffer(t.column("sketch")[0].as_py(), np.float32) for t in (a, b))
        assert np.allclose(x, y, atol=1e-2)
    table = np.random.default_rng(3).standard_normal((decontam.FEATURES, 8)).astype(np.float32)
    items = decontam.Items.of([(k, " ".join(t.split()[3:15])) for k, t in enumerate(made()) if len(t.split()) > 15], table)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(made()))), pa.array(made())], ["key", "text"])
    got = both(lambda raw, off: [(r["key"], r["item"], r["common"], r["answered"]) for b in decontam._search(SimpleNamespace(value=items), SimpleNamespace(value=table))([rows]) for r in b.to_pylist()])
    assert sorted(got[0]) == sorted(got[1]) and len(got[0]) > 5

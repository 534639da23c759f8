import random

import numpy as np

from plumbline.llm import decontam as D


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 20))] for _ in range(2))
        assert D.common(a, b) == lcs(a, b)


def test_nystrom():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((200, 8)) @ rng.standard_normal((8, 50))
    g = rng.standard_normal((50, 16)) * rng.uniform(0.2, 3, (50, 1))
    v = D.right_vectors(a.T @ a @ g, g, 8)
    assert np.linalg.norm(a - a @ v @ v.T) < 1e-3 * np.linalg.norm(a)


def test_every_document_is_fitted(spark, monkeypatch):
    n, r = 24_000, random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 5))) for _ in range(n - 1)] + [" ".join(r.choices(words, k=70))]
    seen = {}

    def spy(y, g, rank):
        seen["y"], seen["g"] = y, g
        return right(y, g, rank)

    right = D.right_vectors
    monkeypatch.setattr(D, "right_vectors", spy)
    of = {w: int(D._hashed(D.hashes(w))[0]) for w in words}
    t = [{of[w] for w in x.split()[a : a + D.PASSAGE]} for x in texts for a in range(0, len(x.split()), D.PASSAGE)]
    rows = np.zeros((len(t), D.FEATURES), bool)
    for i, features in enumerate(t):
        rows[i, list(features)] = True
    used = sorted(set(of.values()))
    m = rows[:, used].astype(float)
    df = np.zeros(D.FEATURES)
    for x in texts:
        df[list({of[w] for w in x.split()})] += 1
    weight = (np.log((1 + n) / (1 + df)) + 0.1) ** 2
    want = m.T @ (m @ D._random(D.RANK + D.OVER)[used]) * weight[used, None]
    for key in (range(n), [None] * n):
        D.latent_table(spark.createDataFrame(list(zip(key, texts, strict=True)), "key long, text string").repartition(3))
        assert np.abs(seen["y"][used] - want).max() < 1e-4 * np.abs(want).max()


def test_windows_cover():
    first = np.array([0, 0, 5, 45, 46])
    for size in (4, 8, 12, 16, 64):
        doc, start, end = D.windows(first, size)
        assert set(doc) == {1, 2, 3}
        for d in (1, 2, 3):
            own = doc == d
            assert start[own].min() == first[d] and end[own].max() == first[d + 1]
            assert (np.diff(start[own]) == max(1, size // 4)).all()


def test_windows_of_spans_are_all_windows():
    for n in (1, 5, 40, 41):
        for size in (4, 12, 64):
            parts = [D.windows(np.array([0, n]), size, a, a + 7) for a in range(0, n, 7)]
            for x, y in zip(D.windows(np.array([0, n]), size), zip(*parts, strict=True), strict=True):
                assert x.tolist() == np.concatenate(y).tolist()


def test_finds_what_leaks(spark):
    r = random.Random(4)
    words = ["the", "of", "and", "to"] * 40 + [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, text(r.choice([9, 13, 20, 36, 50, 58, 120])) + ". " + text(4) + ".") for i in range(30)]
    rows, want = [], set()
    for k in range(400):
        t = text(r.randint(0, 400)).split()
        if k % 4 == 0:
            i = r.randrange(30)
            leak = items[i][1].split()
            if k % 8 == 0:  # every sixth word another, or a word more
                leak = [r.choice(words) if p % 6 == 5 else x for p, x in enumerate(leak)] if len(leak) > 20 else [leak[0].upper(), *leak[1:]]
            p = r.randint(0, len(t))
            t[p:p] = leak
            want.add((k, i))
        rows.append((k, " ".join(t), 0))
    rows += [(1000, None, 0), (1001, "", 0), (None, items[3][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (3, items[3][1])], "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want | {(None, 3)}
    by = dict((k, t) for k, t, _ in rows)
    for x in got:
        assert x.common <= lcs(items[x.item_id][1].lower().split(), by[x.doc_id].lower().split())
    assert D.contaminated(docs.limit(0), bench).collect() == []
    assert D.contaminated(docs, bench.limit(0)).collect() == []

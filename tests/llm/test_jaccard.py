import random

import pytest

from plumbline.llm import jaccard
from plumbline.llm.jaccard import jaccard_join


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO"), (1005, "a b c d e f"), (1006, "a b c d e f g")]
    passage = r.choices(words, k=60)
    k = 0
    for _ in range(40):
        base = r.choices(words, k=r.choice([3, 6, 9, 12, 20, 60, 200]))
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                p = r.randrange(len(t))
                t[p : p + 1] = r.choices(words, k=r.choice([0, 1, 2]))
                t = t or ["x"]
            if r.random() < 0.2:
                t = passage + t
            rows.append((k := k + 1, " ".join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard_join(df).collect())) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(df).collect() == []
    df = spark.createDataFrame([(7, "a b c", 1), (7, "x y z", 1), (None, "a b c", 2), (3, "x y z", 2)], "doc_id long, text string, n int")
    got = sorted(map(tuple, jaccard_join(df).collect()), key=str)
    assert got == [(3, 1, 3), (7, 1, 3), (7, 1, 7), (None, 1, 7)]


def test_boilerplate_under_the_threshold(spark, monkeypatch):
    """Pages that share just too little: none link, and their lists' pairs aren't formed."""
    common = " ".join(f"c{i}" for i in range(200))
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(30)) + " " + common) for i in range(600)] + [(5000 + i, f"x{i} " + common.replace("c", "y")) for i in range(40)]
    seen = []
    cross = jaccard._crossing
    monkeypatch.setattr(jaccard, "_crossing", lambda *a: seen.append(cross(*a)) or seen[0])
    monkeypatch.setattr(jaccard, "discard", lambda _: None)
    got = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert all(got[i] == i for i in range(600)) and all(got[5000 + i] == 5000 for i in range(40))
    assert seen[0].count() < len(rows)


def test_lists_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 3)
    rows = made(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard_join(df).collect())) == brute(rows)


def test_very_long_text(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(400_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df).collect()}
    sizes = {len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in (text.split(), (text + " end").split())}
    assert {got[1][0], got[2][0]} == sizes and got[1][1] == got[2][1] == 1 and got[3] == (1, 3) and got[4] == (0, 4)

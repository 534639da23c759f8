"""Nested selection against refitting every model by itself."""

import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.operators.nested import nested_selection

WEIGHTS = {"graph": 0.7, "text": 0.3}


def fit(x, y, penalty=1.0, weigh=True):
    """Balanced logistic regression over standardised columns by plain Newton steps."""
    m, s = x.mean(0), x.std(0)
    s = np.where(s == 0, 1, s)
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    if y.min() == y.max():
        return lambda q: np.zeros(len(q))
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if weigh else np.ones(len(y))
    b, keep = np.zeros(z.shape[1]), penalty * np.append(np.ones(x.shape[1]), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(keep) + 1e-12 * np.eye(len(b)), z.T @ (w * (y - p)) - keep * b)
    return lambda q: np.column_stack([(q - m) / s, np.ones(len(q))]) @ b


def f_beta(y, hit):
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    p, r = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
    return (3.25 * p * r / (2.25 * p + r) if p + r else 0.0), (2 * p * r / (p + r) if p + r else 0.0), r


def state(y, s, g):
    t = min(sorted(set(s.tolist())), key=lambda t: (-round(f_beta(y, s >= t)[0], 12), t))
    per = [f_beta(y[g == k], s[g == k] >= t) for k in sorted(set(g.tolist()))]
    return t, np.mean([p[1] for p in per]), min(p[2] for p in per)


def brute(rows, gain=0.01):
    g, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([r[3:5] for r in rows])
    kinds = {"graph": x[:, 0], "text": x[:, 1], "weighted": (x[:, 0] * 0.7 + x[:, 1] * 0.3)}
    out = {}
    for o in sorted(set(g.tolist())):
        rest = g != o
        margin = np.zeros(len(rows))
        for i in sorted(set(g[rest].tolist())):
            seen = rest & (g != i)
            margin[g == i] = fit(x[seen], y[seen])(x[g == i])
        oof = {**{k: v[rest] for k, v in kinds.items()}, "stacking": 1 / (1 + np.exp(-margin[rest]))}
        st = {k: state(y[rest], v, g[rest]) for k, v in oof.items()}
        best = max(kinds, key=lambda k: (round(st[k][2], 12), round(st[k][1], 12)))
        pick = "stacking" if st["stacking"][1] - st[best][1] >= gain and st["stacking"][2] >= st[best][2] else best
        own = fit(x[rest], y[rest])(x[g == o])
        curve = fit(margin[rest][:, None], y[rest], 1e-6, False)(own[:, None])
        score = 1 / (1 + np.exp(-own)) if pick == "stacking" else kinds[pick][g == o]
        cal = 1 / (1 + np.exp(-curve)) if pick == "stacking" else score
        for k, a, b in zip(np.flatnonzero(g == o).tolist(), score.tolist(), cal.tolist(), strict=True):
            out[rows[k][0]] = (pick, st[pick][0], a, b)
    return out


@pytest.mark.parametrize("strength", [0.2, 3.0])
def test_every_model_refitted(spark, strength):
    r = random.Random(8)
    rows = []
    for k in range(240):
        y = int(r.random() < 0.4)
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        graph, text = (1 / (1 + np.exp(-(strength * (y - 0.4) + u + 0.8 * v))) for u, v in ((a, b), (-a, b)))
        rows.append((k, "abcde"[k % 5], y, round(float(graph), 3), round(float(text), 3)))
    df = spark.createDataFrame([*rows, (900, None, 1, 0.5, 0.5), (901, "a", None, 0.5, 0.5)], "user_id long, campaign string, label int, graph double, text double")
    got = {x.user_id: x for x in nested_selection(df, "campaign", WEIGHTS).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, (kind, t, score, cal) in want.items():
        x = got[k]
        assert x.kind == kind and x.threshold == pytest.approx(t, abs=1e-6) and x.score == pytest.approx(score, abs=1e-6) and x.calibrated == pytest.approx(cal, abs=1e-5)
        assert x.predicted == int(x.score >= x.threshold)


def test_jobs_do_not_depend_on_the_groups(spark):
    def jobs(n):
        r, tracker = random.Random(n), spark.sparkContext.statusTracker()
        rows = [(k, f"g{k % n}", int(r.random() < 0.5), r.random(), r.random()) for k in range(300)]
        group = f"nested-{n}"
        spark.sparkContext.setJobGroup(group, group)
        count = nested_selection(spark.createDataFrame(rows, "user_id long, campaign string, label int, graph double, text double"), "campaign", WEIGHTS).count()
        ids = tracker.getJobIdsForGroup(group)
        spark.sparkContext.setJobGroup("default", "default")
        assert count == 300
        return len(ids)

    few, many = jobs(4), jobs(16)
    assert many <= few * 1.5


def test_one_group_or_none(spark):
    schema = "user_id long, campaign string, label int, graph double, text double"
    assert nested_selection(spark.createDataFrame([], schema), "campaign", WEIGHTS).count() == 0
    assert nested_selection(spark.createDataFrame([(1, "a", 1, 0.5, None)], schema), "campaign", WEIGHTS).count() == 0
    rows = [(1, "a", 1, 0.9, None), (2, "b", 1, 0.8, 0.1), (3, "a", 1, 0.2, 0.4)]
    assert nested_selection(spark.createDataFrame(rows, schema), "campaign", WEIGHTS).count() == 3

"""The neighbour aggregator: gradients by finite differences, and a graph whose labels only neighbours tell."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph_learner as G
from plumbline.operators import metrics, models


def test_gradient_by_finite_differences():
    r = np.random.default_rng(2)
    w = G.Weights.of(5, 4, 1)
    own, near, y, weight = r.standard_normal((7, 5)), r.standard_normal((7, 3, 5)), r.integers(0, 2, 7).astype(float), r.random(7)
    mask = np.array([[1 / k if i < k else 0 for i in range(3)] if k else [0, 0, 0] for k in (0, 1, 2, 3, 3, 1, 2)])
    _, g = G.gradient(w, own, near, mask, y, weight)
    flat = w.flat()
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        up, down = (G.gradient(w.like(flat + s * e), own, near, mask, y, weight)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def planted(spark, n=900):
    r = random.Random(7)
    x = [r.gauss(0, 1) for _ in range(n)]
    ties = [(a, b) for a in range(n) for b in r.sample(range(n), 4) if a != b]
    near = {k: set() for k in range(n)}
    for a, b in ties:
        near[a].add(b)
        near[b].add(a)
    # the label is that most neighbours are far from 0: neither an account's own feature nor their mean tells it
    y = [int(np.mean([abs(x[u]) > 0.7 for u in near[k]]) > 0.5) for k in range(n)]
    nodes = spark.createDataFrame([(k, x[k], y[k], ["train", "test"][k % 3 == 0]) for k in range(n)], "user_id long, x double, label int, split string")
    return nodes, spark.createDataFrame(ties, "source long, target long")


def test_learns_what_a_linear_model_cannot(spark):
    nodes, edges = planted(spark)
    rows = G.neighbourhoods(edges, nodes, ["x"], sample=20).join(nodes.select("user_id", "label", "split"), "user_id").cache()
    w = G.train(rows.where("split = 'train'"), hidden=24, rounds=24, passes=6, step=0.1)
    got = G.scores(rows.where("split = 'test'"), w).join(nodes.select("user_id", "label"), "user_id")
    auc = metrics.evaluate(got, "label", "model_score").first().roc_auc
    flat = models.propagate(edges, nodes.select("user_id", "x"), ["x"]).join(nodes.select("user_id", F.col("label").cast("double").alias("label"), "split"), "user_id")
    linear = models.scores(models.feature_model(flat.where("split = 'train'"), ["x", "x_hop1", "x_hop2"], "logistic"), flat.where("split = 'test'"))
    base = metrics.evaluate(linear, "label", "model_score").first().roc_auc
    assert auc > 0.75 and auc > base + 0.15


def test_no_ties_one_class_no_rows(spark):
    nodes = spark.createDataFrame([(1, 2.0, 1), (2, None, 1)], "user_id long, x double, label int")
    none = spark.createDataFrame([], "source long, target long")
    rows = G.neighbourhoods(none, nodes, ["x"])
    assert [(len(r.own), r.near) for r in rows.collect()] == [(2, []), (2, [])]
    assert G.train(rows.join(nodes, "user_id")) is None
    assert {r.model_score for r in G.scores(rows, None).collect()} == {0.5}
    assert G.scores(rows, G.Weights.of(2, 3, 0)).count() == 2
    assert G.scores(rows.limit(0), G.Weights.of(2, 3, 0)).count() == 0

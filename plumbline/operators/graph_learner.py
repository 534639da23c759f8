"""A two-layer mean aggregator over sampled neighbours, trained by averaged gradient steps.

What the first layer reads of an account is its features and the mean of its
neighbours', made once by a join.  A training row holds that vector of the
account and those of a bounded sample of its neighbours, so that tasks train
on rows alone: minibatches within a task, weights averaged over all tasks
after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import quota
from plumbline.operators.skew import spread_join
from plumbline.store import stash

#: Neighbours that a row holds, hidden units, rounds, passes over a task's rows in each, rows of a minibatch, step size, weight of squared weights.
SAMPLE, HIDDEN, ROUNDS, PASSES, BATCH, STEP, DECAY = 10, 16, 12, 2, 64, 0.05, 1e-4
#: Rows into which tasks' weights are added before they reach the driver.
SUMS = 64


@dataclass
class Weights:
    """h = relu(first x); score = sigmoid(last . [own h, mean of neighbours' h] + bias)."""

    first: np.ndarray
    last: np.ndarray
    bias: float

    @staticmethod
    def of(inputs: int, hidden: int, seed: int) -> Weights:
        r = np.random.default_rng(seed)
        return Weights(r.standard_normal((hidden, inputs)) * np.sqrt(2 / inputs), r.standard_normal(2 * hidden) * np.sqrt(1 / hidden), 0.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first.ravel(), self.last, [self.bias]])

    def like(self, flat: np.ndarray) -> Weights:
        n = self.first.size
        return Weights(flat[:n].reshape(self.first.shape).copy(), flat[n:-1].copy(), float(flat[-1]))


def neighbourhoods(edges: DataFrame, features: DataFrame, columns: list[str], sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(user_id, own, near): each account's features, standardised, with the mean of its neighbours', and those of its first `sample` neighbours in seeded order.

    Ties count in both directions, once.  Missing features are 0, as are the means of an account without ties.
    """
    stats = features.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")), F.lit(0.0)) for c in columns]
    x = stash(features.join(F.broadcast(stats)).select("user_id", *(v.alias(c) for v, c in zip(z, columns, strict=True))), "standardised")  # one row
    und = edges.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    und = stash(und.union(und.select("b", "a")).distinct(), "ties")
    mean = spread_join(und, x.withColumnRenamed("user_id", "b"), ["b"], F.col("a")).groupBy(F.col("a").alias("user_id")).agg(*(F.avg(c).alias(f"near_{c}") for c in columns))
    own = F.array(*columns, *(F.coalesce(f"near_{c}", F.lit(0.0)) for c in columns))
    m = stash(x.join(mean, "user_id", "left").select("user_id", own.alias("own")), "inputs")
    few = quota(und.withColumn("o", F.xxhash64(F.lit(seed), "a", "b")), ["a"], ["o", "b"], sample).select("a", "b")
    near = spread_join(few, m.toDF("b", "x"), ["b"], F.col("a")).groupBy(F.col("a").alias("user_id")).agg(F.array_sort(F.collect_list("x")).alias("near"))  # `sample` at most
    return m.join(near, "user_id", "left").select("user_id", "own", F.coalesce("near", F.array().cast("array<array<double>>")).alias("near"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, near padded with zeros, how much each neighbour counts) of rows with columns own and near."""
    own = batch.column(batch.schema.names.index("own"))
    x = own.flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
    near = batch.column(batch.schema.names.index("near"))
    n = near.value_lengths().to_numpy()
    k = max(1, int(n.max(initial=0)))
    flat = near.flatten()
    out, mask = np.zeros((len(batch), k, x.shape[1])), np.zeros((len(batch), k))
    row, place = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[row, place] = flat.flatten().to_numpy().reshape(-1, x.shape[1]) if len(flat) else np.zeros((0, x.shape[1]))
    mask[row, place] = 1 / np.repeat(n, n)
    return x, out, mask


def gradient(w: Weights, own: np.ndarray, near: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, its gradient as flat weights): the weighted mean cross entropy, and the squared weights."""
    h, g = np.maximum(own @ w.first.T, 0), np.maximum(near @ w.first.T, 0)
    both = np.concatenate([h, (g * mask[:, :, None]).sum(1)], 1)
    s = both @ w.last + w.bias
    total = max(weight.sum(), 1e-12)
    loss = float((weight * (np.logaddexp(0, s) - y * s)).sum() / total + DECAY / 2 * ((w.first**2).sum() + (w.last**2).sum()))
    d = weight * (1 / (1 + np.exp(-s)) - y) / total
    last = both.T @ d + DECAY * w.last
    k = h.shape[1]
    dh = d[:, None] * w.last[None, :k] * (h > 0)
    dg = (d[:, None] * w.last[None, k:])[:, None, :] * mask[:, :, None] * (g > 0)
    first = dh.T @ own + np.einsum("nkh,nkm->hm", dg, near) + DECAY * w.first
    return loss, np.concatenate([first.ravel(), last, [d.sum()]])


def _round(sent, step: float, passes: int, batch: int):
    """Of each task: its weights after its minibatches times its rows, and its rows."""

    def run(batches):
        w, task = sent.value, TaskContext.get().partitionId()
        flat, rows = w.flat(), 0
        for b in batches:
            if not len(b):
                continue
            x, near, mask = _arrays(b)
            y, weight = b.column(0).to_numpy().astype(float), b.column(1).to_numpy()
            rng = np.random.default_rng([task, rows])
            for _ in range(passes):
                order = rng.permutation(len(y))
                for a in range(0, len(order), batch):
                    i = order[a : a + batch]
                    flat = flat - step * gradient(w.like(flat), x[i], near[i], mask[i], y[i], weight[i])[1]
            rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([task % SUMS], pa.int32()), pa.array([rows], pa.int64()), pa.array([(flat * rows).tobytes()], pa.binary())], ["part", "n", "w"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's weights and rows, added."""
    part, n, w = None, 0, 0.0
    for b in batches:
        for part, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            n, w = n + c, w + np.frombuffer(x.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["part", "n", "w"])


def train(rows: DataFrame, label: str = "label", hidden: int = HIDDEN, rounds: int = ROUNDS, step: float = STEP, passes: int = PASSES, batch: int = BATCH, seed: int = 42) -> Weights | None:
    """Weights fitted to rows (own, near, label 0 or 1), both classes weighing the same; None without rows of both."""
    d = rows.where(F.col(label).isNotNull()).select((F.col(label) > 0.5).cast("int").alias("y"), "own", "near")
    n, pos, inputs = d.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.max(F.size("own"))).first()
    if not 0 < pos < n:
        return None
    weight = F.when(F.col("y") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    d = stash(d.select("y", weight.alias("weight"), "own", "near"), "training")
    w, kind = Weights.of(inputs, hidden, seed), "part int, n long, w binary"
    for k in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(w)  # a matrix of the features
        sums = d.mapInArrow(_round(sent, step / (1 + k / 4), passes, batch), kind).groupBy("part").applyInArrow(_added, kind).collect()
        w = w.like(sum(np.frombuffer(r.w) for r in sums) / sum(r.n for r in sums))
    return w


def scores(rows: DataFrame, w: Weights | None, key: str = "user_id") -> DataFrame:
    """(key, model_score) of rows (key, own, near); 0.5 each where there was nothing to train on."""
    if w is None:
        return rows.select(key, F.lit(0.5).alias("model_score"))
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            x, near, mask = _arrays(b)
            w = sent.value
            both = np.concatenate([np.maximum(x @ w.first.T, 0), (np.maximum(near @ w.first.T, 0) * mask[:, :, None]).sum(1)], 1) if len(b) else np.zeros((0, len(w.last)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-(both @ w.last + w.bias))))], ["key", "model_score"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "own", "near").mapInArrow(run, f"key {kind}, model_score double").withColumnRenamed("key", key)

"""Quality by nearest neighbours among labelled latent-semantic vectors.

A text's features are hashed words and word shapes, weighted by inverse
document frequency.  A randomised SVD of the labelled texts' feature matrix
gives their latent vectors; at most `most` labelled texts, the first by a hash
of their key, so that what is broadcast has a fixed size.  Every text is then
projected, its exact cosine with all labelled vectors taken in blocks, and the
labels of the nearest ones averaged, weighted by a power of the cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.store import arrow_bytes

#: Labelled texts at most, features (words, then shapes), latent dimensions, neighbours.
MOST, WORDS, SHAPES, RANK, NEIGHBOURS = 4096, 3072, 1024, 64, 25
#: A neighbour weighs its cosine to this power.
POWER = 4
BLOCK = 128

_CLASS = np.full(256, 7, np.int64)  # other bytes of non-ASCII characters
_CLASS[:128] = 5  # punctuation
for _range, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2)):
    _CLASS[list(_range)] = _k
_CLASS[list(b".,;:?")] = 3
_CLASS[list(b"!")] = 4
_CLASS[list(b"#*$%&|<>")] = 6


def text_features(raw: np.ndarray, offsets: np.ndarray, before: int | None = None):
    """(features of each word, in two columns; the first word of each text; the hash of the last word, which `before` is of the text so far)."""
    h, first, begin, end = T.words(raw, offsets, lower=False)
    word = (h % np.uint64(WORDS)).astype(np.int64)
    if len(h):
        again = np.zeros(len(h), np.int64)
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][np.diff(first) > 0]] = 0  # a text's first word repeats none
        again[0] = before is not None and int(h[0]) == before
        size = np.minimum(end - begin, 16) // 2
        second = _CLASS[raw[np.minimum(begin + 1, end - 1)]] % 4
        shape = WORDS + ((((_CLASS[raw[begin]] * 8 + _CLASS[raw[end - 1]]) * 4 + second) * 2 + again) * 9 + size) % SHAPES
    else:
        shape = word
    return word, shape, first, int(h[-1]) if len(h) else before


def _pieces(raw: np.ndarray, off: np.ndarray):
    """(first text, end, features) of slices; a very long text comes in several pieces."""
    for i, j in T.slices(off):
        low, high = int(off[i]), int(off[j])
        if high - low <= 2 * T.SLICE:
            yield i, j, text_features(raw, off[i : j + 1])[:3]
        else:
            last = None
            for a, b in T.cuts(raw, low, high):
                word, shape, first, last = text_features(raw, np.array([a, b], np.int64), last)
                yield i, j, (word, shape, first)


def _sums(word, shape, first, table: np.ndarray) -> np.ndarray:
    """The sum of the table's rows for each text."""
    out = np.zeros((len(first) - 1, table.shape[1]), np.float32)
    # a bounded number of words at a time, whatever one text holds
    for a in range(0, len(word), 1 << 14):
        b = min(a + (1 << 14), len(word))
        at = np.clip(first, a, b)
        have = np.flatnonzero(np.diff(at))
        rows = table[word[a:b]] + table[shape[a:b]]
        out[have] += np.add.reduceat(rows, at[have] - a, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _sparse(batches):
    """The distinct features of each text with their counts."""
    for batch in batches:
        raw, off = T.buffers(batch.column(2))
        index, count = [b""] * (len(off) - 1), [b""] * (len(off) - 1)
        long: dict[int, np.ndarray] = {}
        for i, j, (word, shape, first) in _pieces(raw, off):
            if j - i == 1:
                long[i] = long.get(i, 0) + np.bincount(word, minlength=WORDS + SHAPES) + np.bincount(shape, minlength=WORDS + SHAPES)
                continue
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True), i):
                f, n = np.unique(np.concatenate([word[a:b], shape[a:b]]), return_counts=True)
                index[k], count[k] = f.astype(np.int32).tobytes(), n.astype(np.float32).tobytes()
        for k, n in long.items():
            f = np.flatnonzero(n)
            index[k], count[k] = f.astype(np.int32).tobytes(), n[f].astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(count, pa.binary())], ["key", "label", "f", "n"])


def randomised_svd(x: np.ndarray, rank: int, over: int = 16, rounds: int = 2, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of the largest ones."""
    rng = np.random.default_rng(seed)
    rank = min(rank, *x.shape)
    q = rng.standard_normal((x.shape[1], min(rank + over, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    return s[:rank], (q @ vt.T)[:, :rank]


@dataclass
class NeighbourModel:
    """What is broadcast: (WORDS + SHAPES) x RANK projection, MOST x RANK labelled vectors, their labels."""

    table: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def votes(self, v: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The neighbours' mean label, weighted by similarity; the prior where nothing is similar."""
        out = np.full(len(v), self.prior)
        k = min(k, len(self.labels))
        for a in range(0, len(v) if k else 0, BLOCK):
            cos = v[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(float) ** POWER
            total = w.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[a : a + BLOCK] = np.where(total > 0, (w * self.labels[near]).sum(axis=1) / total, self.prior)
        return np.clip(out, 0, 1)

    def score_arrow(self, column) -> np.ndarray:
        raw, off = T.buffers(column)
        out = np.zeros((len(off) - 1, self.table.shape[1]), np.float32)
        for i, j, features in _pieces(raw, off):
            out[i:j] += _sums(*features, self.table)
        return self.votes(_unit(out))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST) -> NeighbourModel:
    """A model from the labelled rows of docs: the `most` first by a hash of their key.

    Null keys and labels are ignored; of a key's labels, and of its texts, the smallest counts.
    """
    arrow_bytes(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label is not null").groupBy("key").agg(F.min("label").alias("label"))
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = d.select("key").distinct().join(known, "key").orderBy(F.xxhash64("key"), "key").limit(most)
    rows = d.join(F.broadcast(chosen), "key").select("key", "label", "text").mapInArrow(T.tidied(_sparse), f"key {dict(d.dtypes)['key']}, label int, f binary, n binary").collect()
    by = {}
    for r in rows:
        if r.key not in by or (r.f, r.n) < (by[r.key].f, by[r.key].n):
            by[r.key] = r
    rows = [by[k] for k in sorted(by)]
    x = np.zeros((len(rows), WORDS + SHAPES), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.f, np.int32)] = np.frombuffer(r.n, np.float32)
    y = np.array([r.label for r in rows], np.float64)
    if not len(rows) or not x.any():
        return NeighbourModel(np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((len(rows), 1), np.float32), y)
    idf = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    x = _unit(x)
    _, v = randomised_svd(x, RANK)
    return NeighbourModel(np.ascontiguousarray(idf[:, None] * v, np.float32), np.ascontiguousarray(_unit(x @ v), np.float32), y)


def _scorer(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score_arrow(batch.column(1)))], ["key", "score"])

    return run


def _keeper(model, text: str, threshold: float):
    def run(batches):
        for batch in batches:
            score = model.value.score_arrow(batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(score >= threshold))

    return run


def keep_good(docs: DataFrame, model: NeighbourModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Those rows of docs, with all their columns, that :func:`knn_quality` predicts as 1; nothing is shuffled."""
    arrow_bytes(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(T.tidied(_keeper(sent, text, threshold)), docs.schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def knn_quality(docs: DataFrame, model: NeighbourModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) for each row of docs.

    A null text is the empty text; a text without words, or like no labelled
    one, gets the share of label 1.  Keys aren't looked at.  An empty table
    gives no rows; further columns are ignored.
    """
    arrow_bytes(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = d.mapInArrow(T.tidied(_scorer(sent)), f"key {dict(d.dtypes)['key']}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

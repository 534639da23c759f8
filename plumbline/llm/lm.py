"""A hashed maximum-entropy language model with a class-factored softmax in nested classes.

A word's place in a tree of classes has a digit for each level, and
P(word | history) is the product over levels of P(digit | digits before it,
history).  Each factor is a softmax over weights found by hashing features of
the history (the last word, the last two, and, skipping one, the word before
the last; below the second level the last word alone) with the node.  The end
of a text is a leaf of the root; frequent words are two levels deep; the rest
of the vocabulary is below one class of the root, as deep as their number
needs.  A word outside the vocabulary is a leaf there too, and has its add-one
share of what training saw outside.

Counts come first: exact, in packed buckets of the hash space.  The vocabulary
and the tables of weights grow with what was counted.  Then the documents are
trained on, each in one of the rounds: tasks take minibatch gradient steps over
their documents from the same weights, and every hashed row of weights becomes
the mean of the tasks' rows, weighted by how often they met it, added level by
level.  Scoring is the same sparse gather in batches; counts of words too rare
to broadcast are joined by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._keys import unique_rows
from plumbline.llm._merge import merged
from plumbline.llm.jaccard import planes, unplanes
from plumbline.store import arrow_bytes, stash

#: Slots of a node; root slots of the rest and the end before those of frequent words.
WIDTH, REST, STOP, FIRST = 32, 0, 1, 2
#: Words of the two upper levels.
FREQUENT = (WIDTH - FIRST) * WIDTH
#: Words of the vocabulary, the square root of this much per training token: at least, at most.
WORDS_LEAST, WORDS_MOST, WORDS_PER = 1 << 13, 1 << 20, 8
#: log2 of the rows of the root's weights for 2**22 tokens, more for each eightfold, at most; the other nodes share twice as many.
ROWS, ROWS_MOST = 13, 18
#: Tokens of a minibatch, rounds, step size.
BATCH, ROUNDS, STEP = 2048, 2, 0.15
PARTS = 8
_ONES = np.ones(WIDTH, np.float32)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Codes of tokens outside the vocabulary and of ends; those of words are their rank from 0.
OUTSIDE, ENDS = -1, -2


def tokens(h: np.ndarray, first: np.ndarray):
    """(hash, text, hash before, hash before that) of every token: the words of each text and its end."""
    n = np.diff(first)
    doc = np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n))])
    e = np.empty(len(h) + len(n), np.uint64)
    at = np.arange(len(h)) + doc[: len(h)]
    ends = first[1:] + np.arange(len(n))
    e[at], e[ends] = h, END
    own = np.repeat(np.arange(len(n)), n + 1)
    begin = first[:-1] + np.arange(len(n))
    one, two = np.full(len(e), START), np.full(len(e), START)
    one[1:], two[2:] = e[:-1], e[:-2]
    one[begin] = START
    two[begin] = START
    two[(begin + 1)[n > 0]] = START
    return e, own, one, two


@dataclass
class Vocabulary:
    """Broadcast: the common words with their counts and codes; words of the vocabulary are those that are common."""

    total: int  # N: training tokens, ends included
    distinct: int  # V: different ones
    texts: int
    common: np.ndarray  # sorted hashes
    counts: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, common: np.ndarray, counts: np.ndarray, total: int, distinct: int, texts: int) -> Vocabulary:
        codes = np.empty(len(common), np.int32)
        codes[np.lexsort((common, -counts))] = np.arange(len(common))
        return cls(total, distinct, texts, common, counts, codes)

    @property
    def outside(self) -> float:
        """What a word outside the vocabulary is divided by: its tokens, its words, and one for unseen ones."""
        return float(self.total - self.texts - self.counts.sum() + self.distinct - (self.texts > 0) - len(self.common) + 1)

    @property
    def rows(self) -> int:
        """log2 of the rows of the root's weights."""
        return min(ROWS_MOST, ROWS + max(0, (max(self.total, 1).bit_length() - 23) // 3))

    def look(self, e: np.ndarray):
        """(training count, -1 if the word isn't common; code) of tokens."""
        if not len(self.common):
            count, codes = np.full(len(e), -1), np.full(len(e), OUTSIDE, np.int32)
        else:
            at = np.minimum(np.searchsorted(self.common, e), len(self.common) - 1)
            hit = self.common[at] == e
            count, codes = np.where(hit, self.counts[at], -1), np.where(hit, self.codes[at], OUTSIDE)
        end = e == END
        return np.where(end, self.texts, count), np.where(end, ENDS, codes)


def depth(words: int) -> int:
    """Levels below the root's class of the rest for so many words: its own, then as many as their number needs."""
    below, room = 1, WIDTH - 1
    while room < words - FREQUENT:
        below, room = below + 1, room * WIDTH
    return below


def paths(codes: np.ndarray, levels: int):
    """(root slot of each code; for each further level the places in codes, nodes and slots).

    Nodes: REST, and FIRST .. WIDTH - 1 for frequent words, by the slot of the
    root; from WIDTH on those below REST, level by level.  Words are dealt to
    slots by rank, so slots of a node are about equally likely.
    """
    root = np.where(codes >= FREQUENT, REST, np.where(codes >= 0, FIRST + codes % (WIDTH - FIRST), np.where(codes == ENDS, STOP, REST)))
    up, low, out = np.flatnonzero((codes >= 0) & (codes < FREQUENT)), np.flatnonzero(codes >= FREQUENT), np.flatnonzero(codes == OUTSIDE)
    rank = codes[low] - FREQUENT
    slot, left = rank % (WIDTH - 1), rank // (WIDTH - 1)
    steps = [(np.concatenate([up, low, out]), np.concatenate([root[up], np.full(len(low) + len(out), REST)]), np.concatenate([codes[up] // (WIDTH - FIRST), slot + 1, np.zeros(len(out), np.int64)]))]
    node, first, many = slot, WIDTH, WIDTH - 1
    for _ in range(levels - 1):
        slot, left = left % WIDTH, left // WIDTH
        steps.append((low, first + node, slot))
        node, first, many = node * WIDTH + slot, first + many, many * WIDTH
    return root, steps


def nodes(levels: int) -> int:
    return WIDTH + (WIDTH - 1) * sum(WIDTH**k for k in range(levels - 1))


class Model:
    """Weights: outer[row, slot of the root], inner[row, slot of another node], with biases from the counts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.levels = depth(len(v.common))
        self.bits = (v.rows, v.rows + 1)
        self.outer = np.zeros((1 << self.bits[0], WIDTH), np.float32)
        self.inner = np.zeros((1 << self.bits[1], WIDTH), np.float32)
        known = v.counts[np.argsort(v.codes)]
        n = np.concatenate([known, [v.texts, max(0, v.total - v.texts - known.sum())]])
        root, steps = paths(np.concatenate([np.arange(len(known)), [ENDS, OUTSIDE]]), self.levels)
        size = np.bincount(root, n, minlength=WIDTH)
        self.outer_bias = self._bias(size, np.bincount(root, minlength=WIDTH) > 0)
        size, there = np.zeros((nodes(self.levels), WIDTH)), np.zeros((nodes(self.levels), WIDTH), bool)
        for at, node, slot in steps:
            np.add.at(size, (node, slot), n[at])
            there[node, slot] = True
        self.inner_bias = self._bias(size, there)

    @staticmethod
    def _bias(size: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = np.log(size + 0.5)
        out -= np.log((np.exp(out) * there).sum(axis=-1, keepdims=True) + 1e-9)
        return np.where(there, out, -30).astype(np.float32)

    def rows(self, one: np.ndarray, two: np.ndarray):
        """Hashes of the three features."""
        return T.mix(one ^ _SALT[0]), T.mix(one * _SALT[1] + two), T.mix(two ^ _SALT[2])

    def logits(self, one, two, codes):
        """For the root, the level below, and all further levels: (table, places in codes, logits of all slots, slot, rows used)."""
        root, steps = paths(codes, self.levels)
        features = self.rows(one, two)
        f = [self._top(x, 0) for x in features]
        yield 0, np.arange(len(codes)), self._sum(self.outer, f, self.outer_bias), root, f
        for some, use in ((steps[:1], features), (steps[1:], features[:1])):
            at, node, slot = (np.concatenate([s[k] for s in some]) for k in range(3)) if some else [np.zeros(0, np.int64)] * 3
            if len(at):
                c = (node.astype(np.uint64) + np.uint64(1)) * _SALT[0]
                g = [self._top(T.mix(x[at] + c), 1) for x in use]
                yield 1, at, self._sum(self.inner, g, self.inner_bias.take(node, axis=0)), slot, g

    def _top(self, h: np.ndarray, table: int) -> np.ndarray:
        """The row that a hash names; 16 bits where they are enough, as these sort faster."""
        return (h >> np.uint64(64 - self.bits[table])).astype(np.uint16 if self.bits[table] <= 16 else np.uint32)

    @staticmethod
    def _sum(w: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        x = w.take(rows[0], axis=0)
        for r in rows[1:]:
            x += w.take(r, axis=0)
        x += bias
        return x

    @staticmethod
    def total(x: np.ndarray) -> np.ndarray:
        """x becomes exp(x), and its rows' sums are returned.  Logits are near log shares; should a sum overflow, rows are first drawn down."""
        before = x.copy() if (high := float(x.max(initial=0))) > 60 else None
        if before is not None:
            x -= high
        np.exp(x, out=x)
        n = x @ _ONES
        if before is not None and not (n > 0).all():
            x[:] = np.exp(before - before.max(axis=1, keepdims=True))
            n = x @ _ONES
        return n

    def log10(self, one, two, codes) -> np.ndarray:
        """log10 of the probability of each code after its history."""
        out = np.zeros(len(codes))
        for a in range(0, len(codes), BATCH):
            s = slice(a, a + BATCH)
            for _, at, x, slot, _ in self.logits(one[s], two[s], codes[s]):
                n = self.total(x)
                out[s] += np.bincount(at, np.log10(np.maximum(x[np.arange(len(at)), slot], 1e-30) / n), minlength=len(out[s]))
        return out


def _summed(slope: np.ndarray, o: np.ndarray, cut: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of slope's rows o, by groups of n from cut on; most groups are one row or two, which reduceat is slow at."""
    g = slope.take(o.take(cut), axis=0)
    two = np.flatnonzero(n == 2)
    g[two] += slope.take(o.take(cut[two] + 1), axis=0)
    more = np.flatnonzero(n > 2)
    if len(more):
        size = n[more]
        g[more] = np.add.reduceat(slope.take(o[np.repeat(n > 2, n)], axis=0), np.cumsum(size) - size, axis=0)
    return g


def _step(w: np.ndarray, power: np.ndarray, met: np.ndarray, rows: list[np.ndarray], slope: np.ndarray) -> None:
    """An update of all rows of a minibatch by each feature, each row with a step that shrinks with its past slopes."""
    for r in rows:
        o = np.argsort(r, kind="stable")
        r = r[o]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        n = np.diff(np.append(cut, len(r)))
        g = _summed(slope, o, cut, n)
        at = r[cut]
        power[at] += np.einsum("ij,ij->i", g, g) / WIDTH
        g *= (STEP / np.sqrt(power[at]))[:, None]
        w[at] -= g
        met[at] += n


CHANGED = "part int, task int, change binary, met binary"


def _train(sent):
    """The change of the weights by this task's documents, each row times how often it was met, in parts of both tables."""

    def run(batches):
        m = _copy(sent.value)
        tables = (m.outer, m.inner)
        before = [w.copy() for w in tables]
        power = [np.full(len(w), 1e-2, np.float32) for w in tables]
        met = [np.zeros(len(w), np.float32) for w in tables]
        for batch in batches:
            raw, off = T.buffers(batch.column(0))
            for _, (e, _, one, two) in _sliced(raw, off):
                _, codes = m.v.look(e)
                for a in range(0, len(e), BATCH):
                    s = slice(a, a + BATCH)
                    for k, at, p, slot, rows in m.logits(one[s], two[s], codes[s]):
                        p *= (1 / m.total(p))[:, None]
                        p[np.arange(len(at)), slot] -= 1
                        _step(tables[k], power[k], met[k], rows, p)
        if not met[0].any():
            return
        task = TaskContext.get().partitionId()
        for k, (w, w0, n) in enumerate(zip(tables, before, met, strict=True)):
            size = len(w) // PARTS
            for part in range(PARTS):
                s = slice(part * size, (part + 1) * size)
                yield _changed(k * PARTS + part, task, (w[s] - w0[s]) * n[s, None], n[s])

    return run


def _changed(part: int, task: int, change: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """A part's change as 16-bit means of its met rows."""
    mean = np.divide(change, met[:, None], out=np.zeros_like(change), where=met[:, None] > 0)[met > 0].astype(np.float16)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([met.tobytes()], pa.binary())], ["part", "task", "change", "met"])


def _unchanged(change, met) -> tuple[np.ndarray, np.ndarray]:
    met = np.frombuffer(met, np.float32)
    out = np.zeros((len(met), WIDTH), np.float32)
    out[met > 0] = np.frombuffer(change, np.float16).reshape(-1, WIDTH)
    return out, met


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the weights: the changes of several tasks, each row weighted by how often its task met it."""
    total = weight = 0
    part = task = None
    for b in batches:
        for part, task, change, met in zip(*(b.column(k) for k in range(4)), strict=True):
            c, n = _unchanged(change.as_buffer(), met.as_buffer())
            total, weight = total + c * n[:, None], weight + n
    yield _changed(part.as_py(), task.as_py(), total, weight)


def _copy(m: Model) -> Model:
    out = Model.__new__(Model)
    out.__dict__.update(m.__dict__)
    out.outer, out.inner = m.outer.copy(), m.inner.copy()
    return out


def _sliced(raw: np.ndarray, off: np.ndarray):
    """(the piece, its :func:`tokens`): in pieces of one text without the words that were in the one before, the end in the last only."""
    for p in T.pieces(raw, off, lead=2):
        t = tokens(p.words, p.first)
        if p.lead or not p.last:
            t = tuple(x[p.lead : len(x) - (not p.last)] for x in t)
        yield p, t


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _count(buckets: int):
    """Of each task: its words and their counts, dealt into buckets."""

    def run(batches):
        have, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        texts, todo = 0, []

        def fold():
            nonlocal have, n, todo
            u, c = np.unique(np.concatenate(todo), return_counts=True)
            todo = []
            h = np.concatenate([have, u])
            o = np.argsort(h, kind="stable")
            h, c = h[o], np.concatenate([n, c])[o]
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            have, n = h[cut], np.add.reduceat(c, cut)

        def rows():
            b = _bucket(have, buckets)
            cut = np.searchsorted(b, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(np.diff(cut)[some], pa.int64()), pa.array([planes(np.diff(have[cut[k] : cut[k + 1]], prepend=np.uint64(0))) for k in some], pa.binary()), pa.array([planes(n[cut[k] : cut[k + 1]]) for k in some], pa.binary())],
                ["bucket", "size", "words", "counts"],
            )

        size = 0
        for batch in batches:
            raw, off = T.buffers(batch.column(0))
            texts += len(off) - 1
            for p in T.pieces(raw, off):
                todo.append(p.words)
                size += len(todo[-1])
                if size >= 1 << 21:
                    fold()
                    size = 0
                    if len(have) > 1 << 22:
                        yield from rows()
                        have, n = have[:0], n[:0]
        if todo:
            fold()
        if len(have):
            yield from rows()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([texts], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], ["bucket", "size", "words", "counts"])

    return run


WORDS = "bucket int, size long, words binary, counts binary, total long, bins binary"


def _sum(group: pa.Table) -> pa.Table:
    """A bucket's words and total counts, with how many words have 2**k or more occurrences."""
    size = group["size"].to_pylist()
    b = group["bucket"][0].as_py()
    if b < 0:
        cols = [[b], [sum(size)], [b""], [b""], [0], [b""]]
    else:
        h = np.concatenate([np.cumsum(unplanes(w, k), dtype=np.uint64) for w, k in zip(group["words"].to_pylist(), size, strict=True)])
        n = np.concatenate([unplanes(c, k) for c, k in zip(group["counts"].to_pylist(), size, strict=True)]).astype(np.int64)
        o = np.argsort(h, kind="stable")
        h, n = h[o], n[o]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[cut], np.add.reduceat(n, cut)
        bins = np.bincount(np.minimum(np.log2(n).astype(int), 47), minlength=48)
        cols = [[b], [len(h)], [planes(np.diff(h, prepend=np.uint64(0)))], [planes(n)], [int(n.sum())], [bins.astype(np.int64).tobytes()]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], [x.split()[0] for x in WORDS.split(", ")])


def _frequent(least: int):
    def run(batches):
        for batch in batches:
            hs, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for size, w, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = unplanes(c, size).astype(np.int64)
                keep = n >= least
                hs.append(np.cumsum(unplanes(w, size), dtype=np.uint64)[keep])
                ns.append(n[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ns))], ["word", "n"])

    return run


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From counted buckets: sums, and words from such a power of two on that they are as many as the tokens allow, WORDS_MOST at the most."""
    total, distinct, texts, bins = 0, 0, 0, np.zeros(48, np.int64)
    # one short row for each bucket
    for r in counts.select("bucket", "size", "total", "bins").toLocalIterator():
        if r.bucket < 0:
            texts = r.size
        else:
            total, distinct, bins = total + r.total, distinct + r.size, bins + np.frombuffer(r.bins, np.int64)
    over = np.cumsum(bins[::-1])[::-1]
    k = int(np.argmax(over <= min(WORDS_MOST, max(WORDS_LEAST, int((WORDS_PER * total) ** 0.5)))))
    rows = counts.where("bucket >= 0").select("size", "words", "counts").mapInArrow(_frequent(1 << k), "word long, n long").toPandas()
    h, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    o = np.argsort(h)
    return Vocabulary.of(h[o], n[o], total + texts, distinct + (texts > 0), texts)


def train(docs: DataFrame, learn: Column, text: str = "text", rounds: int = ROUNDS, spread: str = "key", buckets: int | None = None) -> tuple[Model, DataFrame]:
    """A model of the texts of those docs for which learn is true, and their words' counts by bucket.

    Each document is learnt from in one of the rounds, by a hash of the column named by spread.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    buckets = min(buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1 << 31)
    d = docs.where(learn)
    kind = ", ".join(WORDS.split(", ")[:4])
    counts = stash(d.select(text).mapInArrow(T.tidied(_count(buckets)), kind).groupBy("bucket").applyInArrow(_sum, WORDS), "counts")
    model = Model(vocabulary(counts))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        part = d.where(F.pmod(F.xxhash64(F.lit("round"), spread), F.lit(rounds)) == k).select(text)
        changes = merged(part.mapInArrow(T.tidied(_train(sent)), CHANGED), "part", _add, CHANGED).collect()
        model = _copy(model)
        for r in changes:
            w = (model.outer, model.inner)[r.part // PARTS]
            size = len(w) // PARTS
            w[r.part % PARTS * size : (r.part % PARTS + 1) * size] += _unchanged(r.change, r.met)[0]
        sent.unpersist()
    return model, counts


SCORED = "bucket int, size int, base long, keys binary, words binary, many binary, sums binary"
SUMS = ["n_tokens", "n_known", "common", "model", "others"]  # others: tokens outside the vocabulary


def _score(sent, buckets: int):
    """Of each slice: a row of sums by text, and rare words with their texts, dealt into buckets."""

    def run(batches):
        m = sent.value
        v = m.v
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = T.buffers(batch.column(1))
            for piece, (e, own, one, two) in _sliced(raw, off):
                i, j = piece.low, piece.high
                count, codes = v.look(e)
                rare, n = codes == OUTSIDE, j - i
                lg = np.log10(np.maximum(count, 0) + 1.0)
                score = m.log10(one, two, codes)
                sums = [np.bincount(own, minlength=n).astype(float), np.bincount(own, count > 0, minlength=n), np.bincount(own, np.where(rare, 0, lg), minlength=n), np.bincount(own, score, minlength=n), np.bincount(own, rare, minlength=n)]
                k = np.ascontiguousarray(keys[i:j], np.int64)
                out = [[-1 - int(k[0]) % buckets, n, 0, k.tobytes(), b"", b"", np.concatenate(sums).tobytes()]]
                if rare.any():
                    # a word's occurrences in a text are one entry
                    w, d = e[rare], own[rare]
                    o = np.lexsort((d, w))
                    w, d = w[o], d[o]
                    cut = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]))
                    many = np.diff(np.append(cut, len(w)))
                    w, d = w[cut], k[d[cut]]
                    b = _bucket(w, buckets)
                    at = np.searchsorted(b, np.arange(buckets + 1))
                    base = int(k.min())
                    for c in np.flatnonzero(np.diff(at)):
                        s = slice(at[c], at[c + 1])
                        out.append([int(c), s.stop - s.start, base, planes((d[s] - base).astype(np.uint64)), planes(np.diff(w[s], prepend=np.uint64(0))), planes(many[s]), b""])
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in SCORED.split(", ")])

    return run


JOINED = "key long, n_tokens double, n_known double, common double, model double, others double"


def _join(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The sums of a bucket's texts: as they came, or what the counts of its rare words add."""
    if not rows.num_rows:
        return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 5], ["key", *SUMS])
    r = rows.to_pylist()
    if r[0]["bucket"] < 0:
        key = np.concatenate([np.frombuffer(x["keys"], np.int64) for x in r])
        cols = np.concatenate([np.frombuffer(x["sums"], float).reshape(5, -1) for x in r], axis=1)
    else:
        k = np.concatenate([unplanes(x["keys"], x["size"]).astype(np.int64) + x["base"] for x in r])
        w = np.concatenate([np.cumsum(unplanes(x["words"], x["size"]), dtype=np.uint64) for x in r])
        many = np.concatenate([unplanes(x["many"], x["size"]) for x in r]).astype(float)
        n = np.zeros(len(w))
        for c in counts.to_pylist():
            have, seen = np.cumsum(unplanes(c["words"], c["size"]), dtype=np.uint64), unplanes(c["counts"], c["size"])
            at = np.minimum(np.searchsorted(have, w), len(have) - 1)
            n = np.where(have[at] == w, seen[at], n)
        key, at = np.unique(k, return_inverse=True)
        lg = np.bincount(at, many * np.log10(n + 1), minlength=len(key))
        zero = np.zeros(len(key))
        cols = [zero, np.bincount(at, many * (n > 0), minlength=len(key)), lg, lg, zero]
    return pa.table([pa.array(key), *(pa.array(np.ascontiguousarray(c)) for c in cols)], ["key", *SUMS])


def score(docs: DataFrame, model: Model, counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) for docs (key, text) with unique keys."""
    spark = docs.sparkSession
    buckets = min(buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1 << 31)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select("key", "text").mapInArrow(T.tidied(_score(sent, buckets)), SCORED)
    have = counts.where("bucket >= 0").select("bucket", "size", "words", "counts")
    sums = rows.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(_join, JOINED).groupBy("key").agg(*(F.sum(c).alias(c) for c in SUMS))
    v = model.v
    out = sums.withColumn("base_score", F.col("common") - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1)))
    out = out.withColumn("score", F.col("model") - F.col("others") * float(np.log10(v.outside)))
    return out.select("key", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), "base_score", "score")


def language_model_scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, learnt, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    learn: a condition on the column named key; where it is null the row isn't learnt from.
    score is the model's log10 probability of the whole text and its end,
    base_score that of add-one counts of single tokens.  A null text is the
    empty text, whose only token is the end.  Repeated or null keys are rows
    of their own.  If nothing is learnt from, all counts are 0.  An empty
    table gives no rows; further columns are ignored.
    """
    d, names = unique_rows(docs, key, text)
    named = d.withColumn(key, F.col("key")) if names is None else d.join(names, "key").withColumnRenamed("name", key)
    named = named.select("key", "text", F.coalesce(learn, F.lit(False)).alias("learnt"))
    model, counts = train(named, F.col("learnt"))
    out = score(d, model, counts)
    out = out.join(names, "key").drop("key").withColumnRenamed("name", key) if names is not None else out.withColumnRenamed("key", key)
    return out.select(key, F.coalesce(learn, F.lit(False)).alias("learnt"), "n_tokens", "n_known", F.lit(model.v.total).cast("long").alias("train_tokens"), "base_score", "score")

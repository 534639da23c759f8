"""Benchmark passages in documents, by latent semantic retrieval and subsequence checks.

1. One scan of all documents gathers, per task, document frequencies of hashed
   words and a sketch T'(T G) of the passage matrix T, G being random.  With
   squared inverse document frequencies D it is a sketch of the TF-IDF matrix
   A = T D: D T'T G = A'A (D^-1 G).  From that the Nystrom form of a randomised
   SVD gives the leading right vectors.  The very first, which only tell
   languages apart, are left out.  All that reaches the driver has a fixed size.
2. A second scan projects windows of each document, as long as benchmark items
   are, four to a length; those whose cosine with an item is high enough are
   candidates.
3. A candidate leaks if the longest common subsequence of item and window
   (with a margin) has most of the item's words, or half of them and all of
   the answer: the item's last sentence.

Items are the stated query set: broadcast in blocks of bounded number, against
every window of every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._merge import merged
from plumbline.store import arrow_bytes

#: Hashed words, right vectors, the first of them that aren't used, further columns of the sketch, words of a passage, parts in which sums are dealt.
FEATURES, RANK, SKIP, OVER, PASSAGE, PARTS = 8192, 40, 8, 8, 32, 8
#: Passages that are added to the sketch in one go, about; words of a very long text whose windows are searched in one go.
PASSAGES, SPAN = 1 << 14, 1 << 16
#: Bytes of a block's items.
BYTES = 32 << 20
#: Items of a block; cosine of a candidate; shares of an item's words that leak alone and with the answer; words that always do.
ITEMS, COSINE, ALONE, WITH_ANSWER, LEAST = 20_000, 0.5, 0.6, 0.5, 10


def _random(columns: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, columns)).astype(np.float32)


def _hashed(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def _gather(batches):
    """Of each task: documents with each feature, documents, and T'(T G)."""
    g = np.concatenate([_random(RANK + OVER), np.zeros((1, RANK + OVER), np.float32)])  # the last row: no word, or one that the passage has already
    df, s, total = np.zeros(FEATURES, np.int64), np.zeros((FEATURES, g.shape[1])), 0
    seen, left = np.zeros(FEATURES, bool), np.zeros(0, np.int64)  # of a text that comes in pieces
    for batch in batches:
        raw, off = T.buffers(batch.column(0))
        total += len(off) - 1
        for p in T.pieces(raw, off):
            first, f = p.first, _hashed(p.words)
            if p.high - p.low == 1:
                f = np.concatenate([left, f])
                seen[f] = True
                full = len(f) if p.last else len(f) // PASSAGE * PASSAGE
                f, left = f[:full], f[full:]
                first = np.array([0, full])
                if p.last:
                    df, seen = df + seen, np.zeros(FEATURES, bool)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            for a in range(0, len(n) if p.high - p.low > 1 else 0, 64):
                some = slice(first[a], first[min(a + 64, len(n))])
                there = np.zeros((64, FEATURES), bool)
                there[doc[some] - a, f[some]] = True
                df += there.sum(axis=0)
            if not len(f):
                continue
            at = np.arange(len(f)) - first[doc]
            begin = np.concatenate([[0], np.cumsum(-(-n // PASSAGE))])
            for a, b in _bounded(begin):
                some = slice(first[a], first[b])
                passages = np.full((begin[b] - begin[a], PASSAGE), FEATURES, np.uint16)
                passages[begin[doc[some]] - begin[a] + at[some] // PASSAGE, at[some] % PASSAGE] = f[some]
                _add(s, g, passages)
    if total:
        step, task = FEATURES // PARTS, TaskContext.get().partitionId()
        for k in range(PARTS):
            yield _row(k, task, total, df[k * step : (k + 1) * step], s[k * step : (k + 1) * step])


SKETCH = "part int, task int, texts long, df binary, sketch binary"


def _row(part: int, task: int, texts: int, df: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([texts], pa.int64()), pa.array([zlib.compress(df.astype(np.int64).tobytes(), 1)], pa.binary()), pa.array([sketch.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SKETCH.split(", ")])


def _bounded(begin: np.ndarray):
    """Ranges of documents with about PASSAGES passages; begin has the first passage of each (a longer document is one range)."""
    a = 0
    while a < len(begin) - 1:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + PASSAGES, side="right")) - 1)
        yield a, b
        a = b


def _add(s: np.ndarray, g: np.ndarray, passages: np.ndarray) -> None:
    """Add T'(T G) of passages, whose rows are features, to s; a feature counts once in a passage."""
    passages.sort(axis=1)
    passages[:, 1:][passages[:, 1:] == passages[:, :-1]] = FEATURES
    rows = np.zeros((len(passages), g.shape[1]), np.float32)
    for c in range(PASSAGE):
        rows += g[passages[:, c]]
    flat = passages.ravel()
    order = np.argsort(flat, kind="stable")
    f = flat[order]
    have = int(np.searchsorted(f, FEATURES))
    f, order = f[:have], order[:have]
    cut = np.flatnonzero(np.diff(f.astype(np.int32), prepend=-1))
    s[f[cut]] += np.add.reduceat(rows[order // PASSAGE], cut, axis=0)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's document frequencies and sketches of several tasks."""
    texts, df, s, part, task = 0, 0, 0, None, None
    for b in batches:
        for part, task, n, d, x in zip(*(b.column(k) for k in range(5)), strict=True):
            texts, df, s = texts + n.as_py(), df + np.frombuffer(zlib.decompress(d.as_buffer()), np.int64), s + np.frombuffer(x.as_buffer(), np.float32).astype(float)
    yield _row(part.as_py(), task.as_py(), texts, df, s)


def latent_table(docs: DataFrame) -> np.ndarray:
    """FEATURES x (RANK - SKIP): a word's weight times its row of the right singular vectors of TF-IDF passages of docs (key, text)."""
    none = np.zeros((FEATURES, RANK - SKIP), np.float32)
    n = docs.count()
    if not n:
        return none
    rows = merged(docs.select("text").mapInArrow(T.tidied(_gather), SKETCH), "part", _sum, SKETCH).collect()
    rows.sort(key=lambda r: r.part)
    df = np.concatenate([np.frombuffer(zlib.decompress(r.df), np.int64) for r in rows])
    s = np.concatenate([np.frombuffer(r.sketch, np.float32).reshape(-1, RANK + OVER).astype(float) for r in rows])
    if not s.any():
        return none
    weight = (np.log((1 + n) / (1 + df)) + 0.1) ** 2
    v = right_vectors(s * weight[:, None], _random(RANK + OVER) / weight[:, None], RANK)[:, SKIP:]
    return np.ascontiguousarray(weight[:, None] * v, np.float32)


def right_vectors(y: np.ndarray, g: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix M from y = M g alone, in Nystrom's form with a small shift."""
    g = g.astype(float)
    shift = np.finfo(float).eps ** 0.5 * max(np.linalg.norm(y), 1e-9)
    y = y + shift * g
    b = g.T @ y
    w, q = np.linalg.eigh((b + b.T) / 2)
    w = np.maximum(w, w[-1] * 1e-12 if w[-1] > 0 else 1.0)
    u, _, _ = np.linalg.svd(y @ (q / np.sqrt(w)), full_matrices=False)
    return u[:, :rank]


def window_of(words: int) -> int:
    """The window for items of so many words: the nearest of 4, 8, 12, 16, 24, 32, 48, 64, 96, ..."""
    sizes = [4, 8, 12]
    while sizes[-1] < words:
        sizes += [sizes[-1] * 4 // 3, sizes[-1] * 2]
    return min(sizes, key=lambda w: (abs(np.log(w / words)), w))


@dataclass
class Items:
    """A block of benchmark items, by window length."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    groups: dict[int, tuple[np.ndarray, np.ndarray]]  # window: places of its items, their unit vectors

    @classmethod
    def of(cls, rows: list[tuple], table: np.ndarray) -> Items:
        out, by, vectors = cls([], [], [], {}), {}, []
        for key, text in rows:
            h = hashes(text)
            if len(h):
                by.setdefault(window_of(len(h)), []).append(len(out.ids))
                out.ids.append(key)
                out.words.append(h)
                out.answers.append(hashes(answer_of(text)))
                v = table[_hashed(h)].sum(axis=0)
                vectors.append(v / (np.linalg.norm(v) or 1))
        out.groups = {w: (np.array(at), np.array([vectors[i] for i in at], np.float32)) for w, at in by.items()}
        return out


def hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return T.words(b, np.array([0, len(b)], np.int64))[0]


def answer_of(text: str) -> str:
    """The last sentence."""
    return re.split(r"(?<=[.!?])\s+", text.strip())[-1]


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := at.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def verdict(item: list[int], answer: list[int], region: list[int]) -> tuple[int, bool] | None:
    """(words in common, whether the answer is there) of a leak, else None."""
    n, have = len(item), set(item)
    least = max(min(n, LEAST), -(-int(WITH_ANSWER * 1000) * n // 1000))
    if sum(x in have for x in region) < least or (k := common(item, region)) < least:
        return None
    there = common(answer, region) == len(answer)
    return (k, there) if k * 1000 >= int(ALONE * 1000) * n or there else None


def windows(first: np.ndarray, size: int, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of windows, each a quarter of its length after the one before; the last one ends with the text.

    low, high: only those that begin between these words, of a single text.
    """
    n, step = np.diff(first), max(1, size // 4)
    many = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
    if high is not None:
        start = np.arange(-(-low // step), min(int(many[0]), -(-high // step))) * step
        return np.zeros(len(start), np.int64), start, np.minimum(start + size, n[0])
    doc = np.repeat(np.arange(len(n)), many)
    start = first[doc] + (np.arange(len(doc)) - np.concatenate([[0], np.cumsum(many)])[doc]) * step
    return doc, start, np.minimum(start + size, first[doc + 1])


def _search(sent, tables, cosine: float | None = COSINE):
    least = -2.0 if cosine is None else cosine  # below any cosine

    def run(batches):
        items, table = sent.value, tables.value
        item_words, answers = [w.tolist() for w in items.words], [w.tolist() for w in items.answers]
        for batch in batches:
            found = []
            keys = batch.column(0)
            raw, off = T.buffers(batch.column(1))
            for i, j in T.slices(off):
                some = list(T.pieces(raw, off[i : j + 1]))
                h = np.concatenate([p.words for p in some])
                first = some[0].first if len(some) == 1 else np.array([0, len(h)])
                best: dict[tuple[int, int], tuple] = {}
                # a very long text is gone through in spans, so that its words' vectors aren't all there at once
                spans = [(0, None)] if len(some) == 1 else [(a, a + SPAN) for a in range(0, len(h), SPAN)]
                for low, high in spans:
                    stop = len(h) if high is None else min(len(h), high + max(items.groups, default=0))
                    run_ = np.zeros((stop - low + 1, table.shape[1]))
                    np.cumsum(table[_hashed(h[low:stop])], axis=0, out=run_[1:])
                    for size, (at, vectors) in items.groups.items():
                        doc, start, end = windows(first, size, low, high)
                        for a in range(0, len(doc), 1 << 14):
                            part = slice(a, a + (1 << 14))
                            v = (run_[end[part] - low] - run_[start[part] - low]).astype(np.float32)
                            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                            cos = v @ vectors.T
                            where, which = np.nonzero(cos >= least)
                            for w, k in zip(where.tolist(), which.tolist(), strict=True):
                                d, item = int(doc[a + w]), int(at[k])
                                lo, hi = max(int(first[d]), int(start[a + w]) - size // 4), min(int(first[d + 1]), int(end[a + w]) + size // 4)
                                if got := verdict(item_words[item], answers[item], h[lo:hi].tolist()):
                                    best[d, item] = max(best.get((d, item), (0, False, 0.0)), (*got, float(cos[w, k])))
                found += [(keys[i + d].as_py(), items.ids[item], n, len(item_words[item]), there, c) for (d, item), (n, there, c) in best.items()]
            cols = list(zip(*found, strict=True)) if found else [[]] * 6
            types = [keys.type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "item", "common", "words", "answered", "cosine"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", cosine: float | None = COSINE) -> DataFrame:
    """(key, item, common, words, answered, cosine) for each leak of an item into a document.

    common: words of the longest common subsequence, of words that the item
    has; answered: whether its last sentence is there whole; cosine: of the
    best window.  cosine: what a window needs to be compared word by word; None
    compares all windows with all items, which is exact and costs as much as
    it says.  Null and empty texts and items leak nothing.  An item of ten
    words or fewer must be there whole.  Rows with the same key are one
    document, null keys too; a repeated item id reports its best text.  Either
    table may be empty; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    queries = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("t")).where("t is not null and item is not null").distinct()
    many, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-many // ITEMS), -(-size // BYTES))
    table = latent_table(d)
    tables, out = spark.sparkContext.broadcast(table), None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).orderBy("item", "t").collect()
        sent = spark.sparkContext.broadcast(Items.of([(r.item, r.t) for r in rows], table))
        kind = f"key {dict(d.dtypes)['key']}, item long, common int, words int, answered boolean, cosine double"
        hits = d.mapInArrow(T.tidied(_search(sent, tables, cosine)), kind)
        out = hits if out is None else out.union(hits)
    best = out.groupBy("key", "item").agg(F.max(F.struct("common", "answered", "cosine", "words")).alias("x"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "x.common", "x.words", "x.answered", "x.cosine")

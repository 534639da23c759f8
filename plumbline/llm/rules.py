"""Quality rules: plain counts of every text, and a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of words are hashed to a fixed number of features.  Their
counts over all documents are the raw multinomial, those over trusted ones the
target.  A feature's weight is log((t + k) / (e + k)), t being its count in
the target and e the count expected there from the raw corpus: the log ratio
of both multinomials, drawn to 0 where neither has seen it often.  A text's
score is the mean weight of its features.  The threshold comes from trusted
and rejected documents that had no part in the counts; every document is
then decided by it alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._merge import merged
from plumbline.store import arrow_bytes

#: log2 of the features; the k above; parts in which counts are summed.
BITS, SHRINK, PARTS = 18, 2.0, 16
#: What a row counts for; trusted keys that are broadcast at most (about 100 bytes each in a hash relation: 50 MB).
RAW, BOTH, TARGET = 0, 1, 2
KEYS = 500_000
#: Characters that count as symbols, fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEATED = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each text.

    n_words: runs of bytes other than white space (\\x20, \\x09-\\x0D); word_chars:
    code points in them; n_dup_lines: \\n-split lines with a word that equal an
    earlier line; n_repeat_words: words in a window of three words that the text
    has twice or more.
    """
    out = np.zeros((len(offsets) - 1, 5), np.int64)
    for i, j in T.slices(offsets):
        off = offsets[i : j + 1]
        if off[-1] - off[0] > 2 * T.SLICE:
            out[i] = _long_counts(raw, int(off[0]), int(off[-1]))
            continue
        base = int(off[0])
        text, at = raw[base : int(off[-1])], off - base
        h, first, _, _ = T.words(raw, off, lower=False)
        n = np.diff(first)
        out[i:j, 0] = n
        for col, mark in zip((1, 2), _marks(text), strict=True):
            run = np.zeros(len(text) + 1, np.int64)
            np.cumsum(mark, out=run[1:])
            out[i:j, col] = run[at[1:]] - run[at[:-1]]
        doc = np.repeat(np.arange(j - i), n)
        if len(h) >= 3:
            g = T.mix(T.grams(h, 3) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = doc[2:] == doc[:-2]
            # a window that runs into the next text is none, and must not make an equal one count
            at3 = np.flatnonzero(own)
            _, which, often = np.unique(g[at3], return_inverse=True, return_counts=True)
            twice = np.zeros(len(h), bool)
            twice[at3[often[which] > 1]] = True
            covered = twice.copy()
            covered[1:] |= twice[:-1]
            covered[2:] |= twice[:-2]
            out[i:j, 4] = np.bincount(doc[covered], minlength=j - i)
        if len(text):
            line, of = _lines(text, at)
            _, once = np.unique(T.mix(line + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            again = np.ones(len(line), bool)
            again[once] = False
            out[i:j, 3] = np.bincount(of[again], minlength=j - i)
    return out


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin a character of a word, and symbols."""
    return ~T._SPACE[text] & ((text & 0xC0) != 0x80), _SYMBOL[text]


def _lines(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each line with a word; lines are cut after each \\n and where a text ends."""
    breaks, some = np.flatnonzero(text == 10), np.diff(at) > 0
    ends = np.unique(np.concatenate([breaks, at[1:][some]]))
    starts = np.unique(np.concatenate([breaks + 1, at[:-1][some]]))
    starts = starts[starts < len(text)]
    starts = starts[text[starts] != 10]
    ends = ends[np.searchsorted(ends, starts, side="right")]
    run = np.zeros(len(text) + 1, np.int64)
    np.cumsum(~T._SPACE[text], out=run[1:])
    full = run[ends] > run[starts]
    starts, ends = starts[full], ends[full]
    return T.hashes(text, starts, ends), np.searchsorted(at, starts, side="right") - 1


def _long_counts(raw: np.ndarray, low: int, high: int) -> list[int]:
    """The row of one very long text, in pieces: besides its bytes only hashes of its words and lines are held."""
    h = np.concatenate([p.words for p in T.pieces(raw, np.array([low, high]), lower=False)])
    chars = symbols = 0
    for a in range(low, high, T.SLICE):
        word, symbol = _marks(raw[a : min(a + T.SLICE, high)])
        chars, symbols = chars + int(word.sum()), symbols + int(symbol.sum())
    newline = np.zeros(256, bool)
    newline[10] = True
    lines, size = [np.zeros(0, np.uint64)], T.SLICE
    for a, b in T.cuts(raw, low, high, ends=newline):
        if b - a <= 2 * size:
            lines.append(_lines(raw[a:b], np.array([0, b - a]))[0])
        else:  # a very long line, which is hashed in parts, and perhaps short ones
            end = next((x + int(k[0]) for x in range(a, b, size) if len(k := np.flatnonzero(raw[x : min(x + size, b)] == 10))), b)
            if not all(T._SPACE[raw[x : min(x + size, end)]].all() for x in range(a, end, size)):
                lines.append(np.array([T.joined_hash(raw[x : min(x + size, end)] for x in range(a, end, size))], np.uint64))
            if end + 1 < b:
                lines.append(_lines(raw[end + 1 : b], np.array([0, b - end - 1]))[0])
    found = np.concatenate(lines)
    g = T.grams(h, 3)
    s = np.sort(g)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    del s
    covered = np.zeros(len(h), bool)
    for a in range(0, len(g) if len(twice) else 0, 1 << 20):
        at = np.searchsorted(twice, g[a : a + (1 << 20)])
        k = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == g[a : a + (1 << 20)]) + a
        covered[k] = covered[k + 1] = covered[k + 2] = True
    return [len(h), chars, symbols, len(found) - len(np.unique(found)), int(covered.sum())]


def features(h: np.ndarray, first: np.ndarray, bits: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all unigrams, but for the first `lead`, and bigrams."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = T.grams(h, 2)
    own = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    top = np.uint64(64 - bits)
    return np.concatenate([h[lead:] >> top, g[own[: len(g)]] >> top]).astype(np.int64), np.concatenate([doc[lead:], doc[1:][own]])


def _gather(bits: int):
    """Of each task: how often each feature occurs in the raw corpus and in the target."""

    def run(batches):
        both = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            raw, off = T.buffers(batch.column(0))
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for p in T.pieces(raw, off, lead=1):
                f, doc = features(p.words, p.first, bits, p.lead)
                of = part[p.low : p.high][doc]
                both[0] += np.bincount(f[of != TARGET], minlength=1 << bits)
                both[1] += np.bincount(f[of != RAW], minlength=1 << bits)
        if both.any():
            step = both.shape[1] // PARTS
            for k in range(PARTS):
                yield _row(k, TaskContext.get().partitionId(), both[:, k * step : (k + 1) * step])

    return run


def _row(part: int, task: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(counts).tobytes(), 1)], pa.binary())], ["part", "task", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's counts of several tasks."""
    total, part, task = 0, None, None
    for b in batches:
        for part, task, counts_ in zip(*(b.column(k) for k in range(3)), strict=True):
            total = total + np.frombuffer(zlib.decompress(counts_.as_buffer()), np.int64)
    yield _row(part.as_py(), task.as_py(), total)


def ratio_weights(docs: DataFrame, trusted: DataFrame, bits: int = BITS, shrink: float = SHRINK, keys: int = KEYS) -> np.ndarray:
    """The weight of each feature, from all docs (key, text) and those with a trusted key.  A fixed 2**bits numbers reach the driver.

    Up to `keys` trusted keys are broadcast and one scan counts both; beyond, trusted texts alone are shuffled.
    """
    if trusted.count() <= keys:
        marked = docs.join(F.broadcast(trusted.select("key", F.lit(BOTH).alias("part"))), "key", "left")
        d = marked.select("text", F.coalesce("part", F.lit(RAW)))
    else:
        d = docs.select("text", F.lit(RAW)).union(docs.join(trusted.select("key"), "key", "left_semi").select("text", F.lit(TARGET)))
    kind = "part int, task int, counts binary"
    parts = merged(d.mapInArrow(T.tidied(_gather(bits)), kind), "part", _add, kind).collect()
    if not parts:
        return np.zeros(1 << bits, np.float32)
    raw, target = np.concatenate([np.frombuffer(zlib.decompress(r.counts), np.int64).reshape(2, -1) for r in sorted(parts, key=lambda r: r.part)], axis=1)
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + shrink) / (expected + shrink)).astype(np.float32)


def _mean_weight(raw: np.ndarray, off: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The mean weight of each text's features, 0 without any."""
    s, n = np.zeros((2, len(off) - 1))
    for p in T.pieces(raw, off, lead=1):
        f, doc = features(p.words, p.first, bits, p.lead)
        s[p.low : p.high] += np.bincount(doc, w[f], minlength=p.high - p.low)
        n[p.low : p.high] += np.bincount(doc, minlength=p.high - p.low)
    return s / np.maximum(1, n)


def _score(weights, bits: int):
    def run(batches):
        for batch in batches:
            raw, off = T.buffers(batch.column(1))
            c = counts(raw, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(5)), pa.array(_mean_weight(raw, off, weights.value, bits))], ["key", *COUNTS, "ratio"])

    return run


def _ratios(weights, bits: int):
    """(label, ratio) of labelled texts."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(_mean_weight(*T.buffers(batch.column(1)), weights.value, bits))], ["label", "ratio"])

    return run


def best_threshold(good: dict[int, int], bad: dict[int, int], step: float) -> float:
    """The bin border with the fewest wrong labels, the middle one of a run of equals; minus infinity without rejected ones."""
    if not good or not bad:
        return float("-inf")
    low, high = min(min(good), min(bad)), max(max(good), max(bad)) + 1
    wrong, all_ = sum(bad.values()), {}
    for t in range(low, high + 1):  # at border t everything below is rejected
        all_[t] = wrong
        wrong += good.get(t, 0) - bad.get(t, 0)
    least = min(all_.values())
    run = [t for t in sorted(all_) if all_[t] == least]
    return run[len(run) // 2] * step


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float | None = None, bits: int = BITS) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) for each row.

    labels: (key, 1 trusted or 0 rejected) of some documents; half of the
    trusted ones, by a hash of their key, are the target, the rest and the
    rejected ones find the threshold unless it is given.  Without labels all
    ratios are near 0 and only the plain rules decide.  A document fails these
    with fewer than 50 words or more than half of its words repeated; a null
    text is the empty text, which fails.  Null keys have no label; a key that
    repeats is decided row by row; of several labels the smallest counts.
    An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    half = F.pmod(F.xxhash64(F.lit("half"), "key"), F.lit(2)) == 0
    if labels is None:
        weights = np.zeros(1 << bits, np.float32)
    else:
        known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label is not null").groupBy("key").agg(F.min("label").alias("label"))
        weights = ratio_weights(d, known.where(half & (F.col("label") == 1)), bits)
    sent = spark.sparkContext.broadcast(weights)
    scored = d.mapInArrow(T.tidied(_score(sent, bits)), f"key {dict(d.dtypes)['key']}, " + ", ".join(f"{c} long" for c in COUNTS) + ", ratio double")
    if threshold is None and labels is not None:
        step = 1 / 256
        told = known.where(~(half & (F.col("label") == 1)))
        few = told.count() <= KEYS
        judged = d.join(F.broadcast(told) if few else told, "key").select("key", "text", "label").mapInArrow(T.tidied(_ratios(sent, bits)), "label int, ratio double")
        bins = judged.select("label", F.floor(F.greatest(F.least("ratio", F.lit(16.0)), F.lit(-16.0)) / step).alias("bin")).groupBy("bin", "label").count().collect()
        threshold = best_threshold({r.bin: r["count"] for r in bins if r.label == 1}, {r.bin: r["count"] for r in bins if r.label == 0}, step)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= F.lit(float("-inf") if threshold is None else threshold)))
    return out.select(F.col("key").alias(key), *COUNTS, "base_failed", "ratio", "kept")

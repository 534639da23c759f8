"""Packing tokenised documents into sequences by the sum-of-squares rule.

A piece goes where the sum over gaps g of (open sequences with gap g) squared
becomes smallest; that keeps gaps of all sizes at hand, so later pieces fill
sequences up.  Pieces are packed in buckets of bounded size, longest first.
Sequences left with more than a small gap are opened again and their pieces
packed with those of other buckets, level by level, so what the split into
buckets costs shrinks with each level; a level holds only what the one before
left.  Lengths and row numbers move between tasks, never tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._tok import encoder
from plumbline.store import arrow_bytes, stash

#: Pieces of a bucket, about; the gap that a sequence may keep; levels at most.
BUCKET, GAP, LEVELS = 8192, 8, 6
PIECES = "row long, key long, piece int, start long, length long, ids_crc32 long, tokens binary"
PLACED = "row long, length int, bin int, offset int, gap int"


def place_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, and the gap its sequence keeps) of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, np.float32)  # open sequences by gap
    count[0] = -0.5  # a full sequence isn't open: filling one changes the sum by 1 - 2 * count[gap]
    free: dict[int, list[int]] = {}
    bins, offsets, gaps = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32), []
    for i, s in enumerate(lengths.tolist()):
        gap = 0
        if s < capacity:
            have = count[s:capacity]
            change = count[: capacity - s] - have  # half the change of the sum, less 1
            change[have <= 0] = np.inf
            g = int(change.argmin())  # the smallest gap among equals
            if change[g] + 1 < count[capacity - s] + 0.5:
                gap = g + s
        if gap:
            b = free[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(0)
        bins[i], offsets[i], gaps[b] = b, capacity - gap, gap - s
        if gap > s:
            count[gap - s] += 1
            free.setdefault(gap - s, []).append(b)
    return bins, offsets, np.array(gaps, np.int32)[bins] if len(bins) else np.zeros(0, np.int32)


def _cut(tokenizer: str, end_id: int, capacity: int):
    """Tokens of whole documents, cut where they are longer than a sequence."""

    def run(batches):
        enc = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for ids, ends in enc.encode_texts(*T.buffers(batch.column(1))):
                raw = np.insert(ids, ends, end_id).tobytes()
                cols, begin = [[] for _ in range(7)], 0
                for key, stop in zip(names[at : at + len(ends)], (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                    n = stop - begin
                    first = n if n <= capacity else n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        p = raw[4 * (begin + i) : 4 * (begin + j)]
                        for c, v in zip(cols, (row, key, k, i, j - i, zlib.crc32(p), p), strict=True):
                            c.append(v)
                        row += 1
                    begin = stop
                at += len(ends)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        enc.rest()

    return run


def _bucket(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        row, n = group["row"].to_numpy(), group["length"].to_numpy()
        o = np.lexsort((row, -n))
        b, at, gap = place_pieces(n[o], capacity)
        return pa.table([pa.array(row[o]), pa.array(n[o].astype(np.int32)), pa.array(b), pa.array(at), pa.array(gap)], ["row", "length", "bin", "offset", "gap"])

    return run


def sum_of_squares(pieces: DataFrame, capacity: int) -> DataFrame:
    """(row, sequence_id, offset) for pieces (row, length) of 1 .. capacity tokens; rows are unique.

    No pieces give no rows.  Sequence ids are unique numbers without further meaning.
    """
    done, left, before = None, pieces.select("row", F.col("length").cast("int").alias("length")), None
    for level in range(LEVELS):
        n = left.count()
        last = level == LEVELS - 1 or n == 0
        parts = max(1, -(-n // BUCKET))
        part = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(parts))
        at = left.withColumn("part", part).groupBy("part").applyInArrow(_bucket(capacity), PLACED)
        # the row decides the part again: the group's own number isn't carried along
        at = stash(at.withColumn("part", part), "placed")
        seq = F.shiftleft(F.lit(level + 1).cast("long"), 59) + F.shiftleft(F.col("part").cast("long"), 31) + F.col("bin")
        left = at.where(F.col("gap") > GAP).select("row", "length")
        last = last or n == before or (before is not None and n > 0.97 * before and parts == 1)
        kept = (at if last else at.where(F.col("gap") <= GAP)).select("row", seq.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
        done = kept if done is None else done.union(kept)
        if last:
            break
        before = n
    return done


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset, tokens) for each piece of each row of docs.

    A text's ids and then end_id are one piece, or if they are more than
    capacity pieces of capacity, of which the first may be shorter.  A null
    text is the empty one (only end_id).  Repeated or null keys are documents
    of their own.  No rows give no rows; further columns are ignored.
    tokens: the ids as little-endian unsigned 32-bit numbers; a sequence is its
    pieces' tokens by offset.
    """
    arrow_bytes(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = stash(d.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pieces")
    placed = sum_of_squares(pieces.where(F.col("length") < capacity).select("row", "length"), capacity)
    names = [F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "tokens"]
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return pieces.where(F.col("length") < capacity).join(placed, "row").select(*names).union(full.select(*names))

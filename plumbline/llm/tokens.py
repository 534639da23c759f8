"""Token ids in fixed-width bit-packed blocks.

A block is a run of whole documents in ascending key order (by text where keys
tie) and carries its own header, so it can be read alone, or cut out of a
memory-mapped file:

====== ========== =============================================================
bytes  type       meaning
====== ========== =============================================================
0-3    ascii      ``PLTB``
4-5    uint16     format version, 1
6-7    uint16     width: bits of an id, the fewest that hold vocabulary - 1
8-15   uint64     documents, d
16-23  uint64     ids, n
24-31  int64      ids before this block in its shard
..     int64[d]   keys (the least long for null)
..     int64[d]   end of each document, in ids from the block's start
..     bits       n ids of `width` bits, lowest bit first, zero-filled to a byte
====== ========== =============================================================

Id i of a block starts at bit i * width, so any run of ids is unpacked by
numpy without reading what is before it.  Blocks are rows of Parquet files
written by Spark's committed writer (a lost executor leaves nothing behind),
a shard being one range of keys; a manifest has the ids before each shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._tok import encoder
from plumbline.store import arrow_bytes

HEAD = struct.Struct("<4sHHQQq")
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK = 1 << 16
NULL_KEY = -(1 << 63)


def width_of(vocabulary: int) -> int:
    """Bits for ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive fields of `width` bits."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(bits, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop - 1 of packed ids, reading their bytes only."""
    raw = np.frombuffer(bits, np.uint8)
    if width in (8, 16, 32):
        k = width // 8
        return raw[start * k : stop * k].view(f"<u{k}").astype(np.uint32)
    low, high = start * width // 8, -(-stop * width // 8)
    b = np.unpackbits(raw[low:high], bitorder="little")[start * width - 8 * low :][: (stop - start) * width]
    return b.reshape(-1, width) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def write_block(keys: list[int], ids: np.ndarray, ends: np.ndarray, width: int, before: int) -> bytes:
    """A block from its documents' keys, all their ids, and where each document's end in these."""
    return HEAD.pack(b"PLTB", 1, width, len(keys), len(ids), before) + np.array(keys, np.int64).tobytes() + np.asarray(ends, np.int64).tobytes() + pack(ids, width)


class Block:
    """Random access to the documents of a block."""

    def __init__(self, raw):
        magic, version, self.width, d, self.n, self.before = HEAD.unpack_from(raw)
        if magic != b"PLTB" or version != 1:
            raise ValueError("not a token block of version 1")
        self.keys = np.frombuffer(raw, np.int64, d, HEAD.size)
        self.ends = np.frombuffer(raw, np.int64, d, HEAD.size + 8 * d)
        self.bits = memoryview(raw)[HEAD.size + 16 * d :]

    def document(self, i: int) -> np.ndarray:
        return unpack(self.bits, self.width, int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _writer(tokenizer: str, end_id: int, vocabulary: int | None):
    def run(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        width = width_of(vocabulary or max(enc.size, end_id + 1))
        keys, ids, ends, size, before, k = [], [], [], 0, 0, 0

        def block():
            raw = write_block(keys, np.concatenate(ids), np.concatenate(ends), width, before)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["shard", "block", "documents", "ids", "bytes"])

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for some, stop in enc.encode_texts(*T.buffers(batch.column(1))):
                some, stop = np.insert(some, stop, end_id), stop + np.arange(1, len(stop) + 1)
                d = begin = 0
                while d < len(stop):  # documents up to that which fills a block
                    e = min(int(np.searchsorted(stop, begin + BLOCK - size)) + 1, len(stop))
                    keys += [NULL_KEY if key is None else key for key in names[at + d : at + e]]
                    ids.append(some[begin : stop[e - 1]])
                    ends.append(stop[d:e] - begin + size)
                    size, begin, d = size + len(ids[-1]), int(stop[e - 1]), e
                    if size >= BLOCK:
                        yield block()
                        before, k = before + size, k + 1
                        keys, ids, ends, size = [], [], [], 0
                at += len(stop)
        if keys:
            yield block()
        enc.rest()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", vocabulary: int | None = None, shards: int | None = None) -> None:
    """Encode every whole text, add end_id, and write blocks below path in ascending order of key.

    A null text is the empty text (its only id is end_id); null keys come first;
    rows that share a key are in order of their texts; no rows write no blocks.
    Further columns are ignored.  shards: ranges of keys, spark.sql.shuffle.partitions
    unless given; a key with very many rows is split among several.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mark = F.xxhash64("text")
    d = d.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("key"), mark).sortWithinPartitions("key", mark, "text")
    d.mapInArrow(_writer(tokenizer, end_id, vocabulary), "shard int, block int, documents long, ids long, bytes binary").write.option("compression", "none").parquet(f"{path}/blocks")
    # one row for each shard: as many as tasks, whatever the documents
    n = {r.shard: r.ids for r in spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("ids").alias("ids")).collect()}
    rows, before = [], 0
    for s in sorted(n):
        rows.append((s, before, n[s]))
        before += n[s]
    spark.createDataFrame(rows, "shard int, before long, ids long").coalesce(1).write.parquet(f"{path}/manifest")


def _reader(with_ids: bool):
    def run(batches):
        for batch in batches:
            for base, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(raw.as_buffer())
                flat = unpack(b.bits, b.width, 0, b.n)
                begin = np.concatenate([[0], b.ends[:-1]])
                parts = [flat[i:j].astype("<u4").tobytes() for i, j in zip(begin, b.ends, strict=True)]
                cols = [pa.array(b.keys, mask=b.keys == NULL_KEY), pa.array(begin + base + b.before), pa.array(b.ends - begin), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["key", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, from the blocks below path."""
    arrow_bytes(spark)
    blocks, shards = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/manifest").select("shard", "before")
    at = blocks.select("shard", "bytes").join(F.broadcast(shards), "shard").select("before", "bytes")
    return at.mapInArrow(_reader(ids), "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids).withColumnRenamed("key", key)


def read_range(spark: SparkSession, path: str, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """The documents any of whose ids are among ids low .. high - 1 of the whole corpus; other shards aren't opened."""
    shards = [r.shard for r in spark.read.parquet(f"{path}/manifest").where((F.col("before") < high) & (F.col("before") + F.col("ids") > low)).collect()]
    at = spark.read.parquet(f"{path}/blocks").where(F.col("shard").isin(shards)).select("shard", "bytes")
    at = at.join(F.broadcast(spark.read.parquet(f"{path}/manifest").select("shard", "before")), "shard").select("before", "bytes")
    return at.mapInArrow(_reader(True), "key long, start long, n_tokens long, ids_crc32 long, ids array<int>").where((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low)).withColumnRenamed("key", key)

"""Token counts of texts of any length.

A huge text is cut into chunks that overlap; chunks are dealt to all tasks and
encoded with offsets.  Two neighbours are spliced within their overlap at a
boundary that is proven stable: one that the tokenizer's own rules make the end
of a token whatever is before and behind it.  Both must have a token boundary
there, followed by the same id.  What counts is one chunk's tokens before the
splice and the other's from there on.

======== ============================== =======================================
kind     tokenizer                      stable boundary, and why
======== ============================== =======================================
dropped  words, white space dropped     behind white space: no match reaches
                                        over what is dropped, no normal form
                                        joins a letter to white space
leading  byte-level, usual pattern      before a lone space between other
                                        characters: it begins a match
pieces   sentencepiece BPE without      before a lone space: no piece has a
         normal form                    space behind other characters
whole    any other                      none
======== ============================== =======================================

Where an overlap has no common boundary, its text is cut again with overlaps
(and, once they need it, chunks) eight times as wide, in the end one chunk, so
that only texts with very long words are ever encoded by one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._keys import unique_rows
from plumbline.llm._tok import encoder
from plumbline.store import arrow_bytes, stash

#: Characters of a chunk, of an overlap, and beyond which a text is huge.
CHUNK, OVERLAP = 1 << 15, 1 << 11
_STABLE = {"dropped": re.compile(r"(?<=[ \n\r\t])(?=\S)"), "leading": re.compile(r"(?<=\S)(?= \S)"), "pieces": re.compile("(?<=[^\\s▁])(?= [^\\s▁])")}
_COUNTERS: dict[str, Counter] = {}


class Counter:
    """A tokenizer with its stable boundaries."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
            self.kind = "pieces" if self._local() and not any("▁" in p.lstrip("▁") for p in names) else "whole"
        else:
            self.pieces, self.kind = None, encoder(path).kind

    def _local(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(self.pieces.serialized_model_proto())
        n, t = m.normalizer_spec, m.trainer_spec
        return not n.precompiled_charsmap and not n.normalization_rule_tsv and not n.remove_extra_whitespaces and t.model_type == t.BPE and not t.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in m.pieces)

    def counts(self, column) -> np.ndarray:
        """The number of each whole text's tokens."""
        if self.pieces is not None:
            return np.array([len(x) for x in self.pieces.encode([t or "" for t in column.to_pylist()], num_threads=1)], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *(np.diff(ends, prepend=0) for _, ends in encoder(self.path).encode_texts(*T.buffers(column)))])

    def offsets(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, where each token begins, where it ends) in characters."""
        if self.pieces is not None:
            p = self.pieces.encode(text, return_type="proto").pieces
            chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
            chars = np.concatenate([[0], chars])  # the library's offsets are bytes
            return [x.id for x in p], chars[[x.begin for x in p]], chars[[x.end for x in p]]
        e = encoder(self.path).tok.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return e.ids, at[:, 0], at[:, 1]

    def boundaries(self, text: str, low: int, high: int, ids: list[int], begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, tokens before it, next id) of the stable boundaries of text[low:high] where these tokens end."""
        if self.kind not in _STABLE:
            return []
        # matches look at a character on either side, which must be the text's own
        at = np.array([m.start() for m in _STABLE[self.kind].finditer(text, max(low, 1), high) if low < m.start() < high - 1], np.int64)
        n = np.searchsorted(begin, at)
        n, at = n[n < len(ids)], at[n < len(ids)]
        good = (n > 0) & (end[n - 1] <= at) if len(ids) else np.zeros(0, bool)
        return [(int(x), int(k), int(ids[k])) for x, k in zip(at[good], n[good], strict=True)]


def counter(path: str) -> Counter:
    """This process's counter for a tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _counted(path: str):
    def run(batches):
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.counts(b.column(2)), pa.int64())], ["key", "n_bytes", "n_tokens"])
        if c.pieces is None:
            encoder(path).rest()

    return run


def _chunks(chunk: int, overlap: int):
    """(key, n_bytes, text) to (key, n_bytes, no, parts, text) of each chunk, the bytes with the first."""

    def run(batches):
        for b in batches:
            for key, size, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = text.as_py()
                parts = max(1, -(-(len(t) - overlap) // chunk))
                for i in range(parts):
                    part = t[i * chunk : (i + 1) * chunk + overlap] if i + 1 < parts else t[i * chunk :]
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([size if i == 0 else 0], pa.int64()), pa.array([i], pa.int32()), pa.array([parts], pa.int32()), pa.array([part], pa.string())], ["key", "n_bytes", "no", "parts", "text"])

    return run


_SPLICE = pa.list_(pa.struct([("at", pa.int32()), ("id", pa.int32()), ("before", pa.int64())]))
_ENCODED = "key long, n_bytes long, no int, parts int, n long, first array<struct<at: int, id: int, before: long>>, last array<struct<at: int, id: int, before: long>>"


def _encoded(path: str, chunk: int, overlap: int):
    """Chunks to their numbers of tokens and the boundaries in their overlaps, whose places count from the overlap's start."""

    def run(batches):
        c = counter(path)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids, begin, end = c.offsets(r["text"])
                stable = lambda low: [{"at": at - low, "id": i, "before": n} for at, n, i in c.boundaries(text, low, low + overlap, ids, begin, end)]  # noqa: B023, E731
                text, more = r["text"], r["no"] + 1 < r["parts"]
                rows.append((r["key"], r["n_bytes"], r["no"], r["parts"], len(ids), stable(0) if r["no"] else [], stable(chunk) if more else []))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), _SPLICE, _SPLICE]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["key", "n_bytes", "no", "parts", "n", "first", "last"])

    return T.tidied(run)


def spliced(encoded: DataFrame) -> DataFrame:
    """Chunks (key, n_bytes, no, n, first, last) to (key, n_bytes, n_tokens), null where some neighbours have no common boundary."""
    right = encoded.where("no > 0").select("key", (F.col("no") - 1).alias("no"), "first")
    place = lambda x: F.struct(x["at"], x["id"])
    common = F.array_intersect(F.transform("last", place), F.transform("first", place))
    middle = F.element_at("common", F.floor(F.size("common") / 2).cast("int") + 1)
    before = lambda c: F.get(F.filter(c, lambda x: x["at"] == F.col("splice.at")), 0)["before"]
    both = encoded.select("key", "no", "n", "last").join(right, ["key", "no"]).select("key", "n", "last", "first", common.alias("common"))
    both = both.withColumn("splice", F.when(F.size("common") > 0, middle))
    pairs = both.select("key", (F.col("n") - before("last") + before("first")).alias("twice"))
    lost = pairs.groupBy("key").agg(F.sum("twice").alias("twice"), F.count("twice").alias("good"), F.count("*").alias("pairs"))
    whole = encoded.groupBy("key").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))
    n = F.when(F.col("pairs").isNull(), F.col("n")).when(F.col("good") == F.col("pairs"), F.col("n") - F.col("twice"))
    return whole.join(lost, "key", "left").select("key", "n_bytes", n.alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, as the tokenizer's library counts whole texts.

    A null text is the empty text: no bytes, no tokens.  Rows that repeat a key,
    or have none, count each for itself.  No rows give no rows; further columns
    are ignored.  Texts of over two chunks are cut as above.
    """
    arrow_bytes(docs.sparkSession)
    d, names = unique_rows(docs, key, text)
    d = d.select("key", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    huge = F.char_length("text") > 2 * chunk
    out = d.where(~huge).mapInArrow(_counted(tokenizer), "key long, n_bytes long, n_tokens long")
    left = d.where(huge)
    while left.head(1):
        pieces = left.mapInArrow(_chunks(chunk, overlap), "key long, n_bytes long, no int, parts int, text string")
        done = stash(spliced(stash(pieces.repartition("key", "no").mapInArrow(_encoded(tokenizer, chunk, overlap), _ENCODED), "chunks")), "spliced")
        out = out.union(done.where("n_tokens IS NOT NULL"))
        left = d.join(done.where("n_tokens IS NULL").select("key"), "key", "left_semi")
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    out = out.withColumn("over_limit", F.col("n_tokens") > limit)
    if names is not None:
        out = out.join(names, "key").drop("key").withColumnRenamed("name", "key")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", "over_limit")

"""Alignment of two tokenizers' tokens by where they end.

Both tokenizers are known to end a token before a space or line break that
follows another character, and between a letter and the digit or punctuation
behind it, if the one is byte-level with the usual pattern (whose matches end
there) and no piece of the other has such a place within it.  Texts are cut
there, into words with the white space before them, and no token, group or
link crosses a cut.  Each different
word of the corpus is aligned once, as the rows of a relation; for tokenizers
without that property a word is a whole text.

Words' tokens are exploded with their places, ends are windowed sums of their
bytes, a full equi-join on word and end merges the two sides, and running
counts of ends that both have number the groups.  Every merged end is one link:
of the A and the B token that reach over it, found by the same ordered window,
so that a group of n and m tokens costs n + m rows and not n * m.

Documents are kept as codes of their words; a block of documents has its own
code book of bounded size, and a block's documents are put together behind the
results for its book.  Rows are never joined by document, so repeated and null
keys are rows like others.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.llm._tok import _AS_IS, encoder
from plumbline.operators.skew import spread_join
from plumbline.store import arrow_bytes, discard, stash

#: Words, and bytes of them, after which a block's code book is closed.
BOOK, BOOK_BYTES = 1 << 19, 64 << 20
#: Id pairs up to which their counts are broadcast.
PAIRS = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_LETTER[33:127]
_BREAK = re.compile(r"[A-Za-z][!-@\[-`{-~]|[^▁]▁|.?\n", re.S)
_THIN = [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]


class Pair:
    """The two tokenizers: A of the tokenizers library, byte-level; B of sentencepiece."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        as_is = set(_AS_IS)
        rest = {256 + k: byte for k, byte in enumerate(x for x in range(256) if x not in as_is)}
        self.a_bytes = {i: bytes(rest.get(ord(c), ord(c) & 255) for c in piece) for piece, i in self.a.get_vocab().items() if all(ord(c) in as_is or ord(c) in rest for c in piece)}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.words = encoder(a).kind == "leading" and not any(_BREAK.search(p) for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))) and self._local()

    def _local(self) -> bool:
        """Whether B writes each character for itself: no normalising, bytes for what it lacks, one space before a text."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(self.b.serialized_model_proto())
        n, t = m.normalizer_spec, m.trainer_spec
        plain = not n.precompiled_charsmap and not n.normalization_rule_tsv and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        bpe = t.model_type == t.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in m.pieces)
        return bool(plain and bpe and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"])

    def tokens(self, words: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """(A's ids, B's ids, whether both spell the word) of each word."""
        a = [e.ids for e in self.a.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        if self.words:  # behind a line break, of which no piece is a part
            b = [ids[2:] for ids in self.b.encode(["\n" + w.decode() for w in words], num_threads=1)]
        else:
            b = self.b.encode([w[1:].decode() for w in words], num_threads=1)
        spells = lambda table, ids, w: b"".join([table.get(i, b"\xff") for i in ids]) == w
        return a, b, np.array([spells(self.a_bytes, x, w) and spells(self.b_bytes, y, w) for x, y, w in zip(a, b, words, strict=True)], bool)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """This process's tokenizers."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def starts(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    """Where words of raw[low:high] begin, whose first byte is a space."""
    out = [np.array([low], np.int64)]
    for p in range(low + 1, high, T.SLICE):
        x = raw[p : min(p + T.SLICE, high)]
        before = raw[p - 1 : p - 1 + len(x)]
        at = np.flatnonzero((((x == 32) | (x == 10)) & ~_BLANK[before]) | (_MARK[x] & _LETTER[before])) + p
        wide = np.flatnonzero(raw[at - 1] >= 128)
        if len(wide):  # white space of two or three bytes before it: no cut
            c, b, a = (raw[at[wide] - k] for k in (1, 2, 3))
            blank = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (((b == 0x80) & np.isin(c, _THIN)) | ((b == 0x81) & (c == 0x9F))))
            at = np.delete(at, wide[blank])
        out.append(at)
    return np.concatenate(out)


_CODED = "what string, block long, key long, codes binary, n int, code long, word binary, occurrences long"
#: Codes of a book are below this: fifteen bits, and eight more where a mark says so.
CODES = 1 << 23


def packed(codes: np.ndarray) -> bytes:
    """Codes as two bytes each, those of 2**15 or more marked and with a third byte behind all; common words come early and have small codes."""
    high = codes >= 1 << 15
    return ((codes & 0x7FFF) | high << 15).astype("<u2").tobytes() + (codes[high] >> 15).astype(np.uint8).tobytes()


def unpacked(raw, n: int) -> np.ndarray:
    """The n codes that were packed."""
    low = np.frombuffer(raw, "<u2", n).astype(np.int64)
    codes, high = low & 0x7FFF, low >= 1 << 15
    codes[high] |= np.frombuffer(raw, np.uint8, offset=2 * n).astype(np.int64) << 15
    return codes




def _coded(a: str, b: str):
    """(key, text) to documents as codes of their words, and the words of each block's book."""

    def row(schema, size, /, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches):
        schema = pa.schema([("what", pa.string()), ("block", pa.int64()), ("key", pa.int64()), ("codes", pa.binary()), ("n", pa.int32()), ("code", pa.int64()), ("word", pa.binary()), ("occurrences", pa.int64())])
        both, first = pair(a, b), TaskContext.get().partitionId() << 24
        block, book, seen, size = first, {}, np.zeros(0, np.int64), 0

        def closed():
            names = list(book)
            for i in range(0, len(names), 1 << 14):
                some = names[i : i + (1 << 14)]
                yield row(schema, len(some), what=["word"] * len(some), block=np.full(len(some), block), code=np.arange(i, i + len(some)), word=some, occurrences=seen[i : i + len(some)])

        for batch in batches:
            texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), batch.column(1).cast(pa.large_string()), pa.scalar("", pa.large_string()))
            raw, off = T.buffers(texts)
            keys = batch.column(0)
            for i, j in T.slices(off):
                if len(book) >= BOOK or size >= BOOK_BYTES:
                    yield from closed()
                    block, book, seen, size = block + 1, {}, np.zeros(0, np.int64), 0
                codes = [np.zeros(0, np.int64)] * (j - i)
                at = [starts(raw, int(off[k]), int(off[k + 1])) if both.words else np.array([off[k]]) for k in range(i, j)]
                # a text that is empty, or spells a space as B's mark of one, has no tokens
                full = [off[k + 1] - off[k] > 1 and not (both.words and b"\xe2\x96\x81" in raw[off[k] : off[k + 1]].tobytes()) for k in range(i, j)]
                kept = [k for k in range(j - i) if full[k]]
                if kept:
                    begin = np.concatenate([at[k] for k in kept])
                    stop = np.concatenate([np.append(at[k][1:], off[i + k + 1]) for k in kept])
                    words = _words(raw, begin, stop).dictionary_encode()
                    names = words.dictionary.to_pylist()
                    fresh = len(book)
                    to = np.array([book.setdefault(w, len(book)) for w in names], np.int64)
                    size += sum(map(len, list(book)[fresh:])) if len(book) > fresh else 0
                    local = words.indices.to_numpy()
                    if len(book) > len(seen):
                        seen = np.concatenate([seen, np.zeros(len(book) - len(seen), np.int64)])
                    seen[to] += np.bincount(local, minlength=len(to))
                    for k, part in zip(kept, np.split(to[local], np.cumsum([len(at[k]) for k in kept])[:-1]), strict=True):
                        codes[k] = part
                if len(book) > CODES:
                    raise ValueError("one text has more different words than codes")
                yield row(schema, j - i, what=["text"] * (j - i), block=np.full(j - i, block), key=keys.slice(i, j - i), codes=list(map(packed, codes)), n=list(map(len, codes)))
        yield from closed()

    return T.tidied(run)


def _words(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """raw[begin:stop] as an array of bytes; where words follow one another without a gap, without copying."""
    if len(begin) and (begin[1:] == stop[:-1]).all():
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, stop[-1])), pa.py_buffer(raw)])
    return pa.array([raw[x:y].tobytes() for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], pa.large_binary())


_TOKEN = pa.list_(pa.struct([("id", pa.int32()), ("len", pa.int32())]))
_TOKENS = "seg long, word binary, occurrences long, a array<struct<id: int, len: int>>, b array<struct<id: int, len: int>>"


def _tokens(a: str, b: str):
    """(seg, word, occurrences) with both tokenizers' ids and bytes; words that one of them doesn't spell have none."""

    def lists(ids, table):
        flat = [i for x in ids for i in x]
        st = pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array([len(table[i]) for i in flat], pa.int32())], names=["id", "len"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), st)

    def run(batches):
        both = pair(a, b)
        for batch in batches:
            for i in range(0, len(batch), 1 << 12):
                some = batch.slice(i, 1 << 12)
                x, y, good = both.tokens(some.column(1).to_pylist())
                if both.words and not good.all():
                    raise ValueError("a word isn't spelled by its tokens: these tokenizers can't be cut at white space")
                x, y = ([ids if g else [] for ids, g in zip(z, good, strict=True)] for z in (x, y))
                yield pa.RecordBatch.from_arrays([*some.columns, lists(x, both.a_bytes), lists(y, both.b_bytes)], ["seg", "word", "occurrences", "a", "b"])

    return T.tidied(run)


def links(segs: DataFrame) -> DataFrame:
    """segs (seg, word, occurrences, a, b: arrays of (id, len)) to rows (word, seg, occurrences, n_a, n_b, n_groups, n_links, groups, links: array of (a, b)).

    All steps work on one deal of segs: run it with COLOCATED.
    """
    dealt = segs.repartition("seg")

    def side(name):
        at = dealt.select("seg", F.posexplode(name).alias("pos", "token"))
        w = Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return at.select("seg", F.sum(F.col("token.len").cast("long")).over(w).alias("end"), F.col("token.id").alias(f"{name}_id"))

    both = side("a").join(side("b"), ["seg", "end"], "full")
    # from the end back, the last id seen is that of the token that reaches over this place
    back = Window.partitionBy("seg").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = lambda c: F.last(c, ignorenulls=True).over(back)
    cut = (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("long")
    rows = both.select("seg", "end", over("a_id").alias("a"), over("b_id").alias("b"), "a_id", "b_id", F.sum(cut).over(back).alias("grp"))
    ids = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c)))), lambda x: x[c].cast("string")), ",")
    groups = rows.groupBy("seg", "grp").agg(F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"), F.concat(ids("a_id"), F.lit("|"), ids("b_id")).alias("text"), F.collect_list(F.struct("a", "b")).alias("links"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grp", "text")), asc=False), lambda x: x["text"]), ";")
    groups = groups.groupBy("seg").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), texts.alias("groups"), F.flatten(F.collect_list("links")).alias("links"))
    return dealt.select("seg", "word", "occurrences").join(groups, "seg").withColumn("n_links", F.size("links").cast("long"))


#: A join on (seg, end) may use a deal by seg.
COLOCATED = "spark.sql.requireAllClusterKeysForCoPartition"


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_OUT = "key long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", groups_sha256 string"


#: The place of texts among their block's rows.
_LAST = 1 << 40


def _assembled(batches):
    """Rows (block, code, key, body) by block, words by code before texts (code: _LAST and how many they have), to a row a text; a word's body is its numbers and groups."""
    block, numbers, groups, table = None, [], [], None
    for batch in batches:
        blocks, codes = batch.column("block").to_numpy(), batch.column("code").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low == high:
                continue
            if blocks[low] != block:
                block, numbers, groups, table = int(blocks[low]), [], [], None
            k = low + int(np.searchsorted(codes[low:high], _LAST))
            if k > low:
                fields = pc.split_pattern(batch.column("body").slice(low, k - low).cast(pa.large_string()), ";", max_splits=len(_NUMBERS)).flatten()
                width = len(_NUMBERS) + 1
                at = np.arange(0, len(fields), width)
                numbers.append(np.stack([fields.take(pa.array(at + c)).cast(pa.int64()).to_numpy() for c in range(width - 1)], 1))
                groups += fields.take(pa.array(at + width - 1)).to_pylist()
            if k == high:
                continue
            table = table if table is not None else np.concatenate(numbers) if numbers else np.zeros((0, len(_NUMBERS)), np.int64)
            some = batch.slice(k, high - k)
            sums, digests = np.zeros((len(some), len(_NUMBERS)), np.int64), []
            for i, (raw, n) in enumerate(zip(some.column("body"), (codes[k:high] - _LAST).tolist(), strict=True)):
                sha, x = hashlib.sha256(), unpacked(raw.as_buffer(), n)
                for start in range(0, n, 1 << 16):
                    own = x[start : start + (1 << 16)]
                    sums[i] += table[own].sum(0)
                    # words of texts as a whole may have no tokens
                    texts = ";".join(filter(None, map(groups.__getitem__, own.tolist())))
                    sha.update((";" if start and texts else "").encode() + texts.encode())
                digests.append(sha.hexdigest() if sums[i, 0] else "")
            yield pa.RecordBatch.from_arrays([some.column("key"), *(pa.array(sums[:, c]) for c in range(len(_NUMBERS))), pa.array(digests, pa.string())], ["key", *_NUMBERS, "groups_sha256"])


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A reads a space and the text, B the text.  A text that is null or empty, or
    that the tokens of one of them don't spell, has no tokens: zeros and the
    empty string.  An id pair's count is its links over all rows, those of
    repeated texts each counted; a link is best if no pair of its B id counts
    more.  No rows give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    coded = stash(docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_coded(a, b), _CODED), "coded")
    words = coded.where("what = 'word'")
    segs = words.groupBy("word").agg(F.sum("occurrences").alias("occurrences")).select(F.monotonically_increasing_id().alias("seg"), "word", "occurrences")
    segs = stash(segs.mapInArrow(_tokens(a, b), _TOKENS), "segs")
    before = spark.conf.get(COLOCATED)
    spark.conf.set(COLOCATED, "false")
    try:
        linked = stash(links(segs), "links")
    finally:
        spark.conf.set(COLOCATED, before)
    discard(segs)
    each = linked.select("seg", "occurrences", F.explode("links").alias("link")).select("seg", "occurrences", "link.*")
    counts = stash(each.groupBy("a", "b").agg(F.sum("occurrences").alias("count"), F.count("*").alias("c")), "pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    scored = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    each = each.select("seg", "a", "b")
    if counts.count() <= PAIRS:
        sums = each.join(F.broadcast(scored), ["a", "b"])
    else:
        sums = spread_join(each, scored, ["a", "b"], F.col("seg"), counts=counts.select("a", "b", "c"), total=counts.agg(F.sum("c")).first()[0])
    sums = sums.groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    found = linked.drop("links", "occurrences").join(sums, "seg").select("word", F.concat_ws(";", *_NUMBERS, "groups").cast("binary").alias("body"))
    book = words.select("block", "code", "word").join(found, "word", "left")
    none = F.lit("0;" * len(_NUMBERS)).cast("binary")
    book = book.select("block", "code", F.lit(None).cast("long").alias("key"), F.coalesce("body", none).alias("body"))
    own = coded.where("what = 'text'").select("block", (F.lit(_LAST) + F.col("n")).alias("code"), "key", F.col("codes").alias("body"))
    out = book.union(own).repartition("block").sortWithinPartitions("block", "code")
    return out.mapInArrow(T.tidied(_assembled), _OUT).withColumnRenamed("key", key)

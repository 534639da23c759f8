"""N-gram Jaccard join by set size: subsets for small sets, inverted lists for large ones.

Pairs of texts with 100 * |A & B| >= percent * |A | B| over distinct word
shingles, without ever listing all pairs of a group:

1. One scan hashes every shingle.  Postings are packed per bucket of the hash
   space (about 8 bytes each); equal sets within a task are posted once.
2. Each bucket counts its shingles.  One that only one text has can't join
   anything, so only repeated shingles come back, with their counts.
3. Texts with equal sets are one class, kept by its smallest key.  Ordered by
   rarity, the first n - ceil(percent * n / 100) + 1 shingles of a set must
   meet those of any partner; a class whose prefix holds no repeated shingle
   ends here.
4. Light sets (size up to a boundary) are looked up by hashed subsets of the
   overlap that a partner of each possible size needs; heavy sets by the
   inverted lists of their prefixes.  The boundary is where enumerating
   subsets stops being cheaper than scanning the lists, from their measured
   lengths.
5. In each list a pivot per band of sizes is compared with the others, so a
   list costs what it is long.  Links join classes into components.
6. Lists that still touch several components have cross pairs compared, so no
   link is lost.  The join itself leaves out what can't link: sizes too far
   apart by their bands; pairs within a list's largest component; and pairs
   whose smaller set has its entry so late in its order that what follows is
   too little for any partner of its size or more (pages that share most of
   their shingles, but not enough, are all of that kind).  Long lists are dealt
   to several tasks.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _text as T
from plumbline.operators.components import connected_components
from plumbline.operators.skew import spread_join
from plumbline.store import arrow_bytes, discard, stash

#: Postings that a task packs at a time.
FLUSH = 1_000_000
#: Light sets never go beyond this size, whatever the cost says: above it subsets only explode.
LIGHT_MOST = 16
#: Entries of a list that one task compares with the others.
LIST = 4096
LOW48 = np.uint64((1 << 48) - 1)
PACKED = "bucket int, size int, base long, ids binary, marks binary"
FOUND = "kind byte, key long, gram long, cnt int"


def needed(a: int, b: int, percent: int) -> int:
    """Shared shingles that sets of sizes a and b need at least."""
    return -(-percent * (a + b) // (100 + percent))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, high zero planes left out."""
    x = np.ascontiguousarray(x, np.uint64)
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unplanes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    k = len(b) // n if n else 0
    out[:, :k] = np.frombuffer(b, np.uint8).reshape(k, n).T
    return out.reshape(-1).view(np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of x in order; x is sorted in place."""
    x.sort()
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int):
    """The sorted distinct n-word shingle hashes of each text; a shorter one's whole sequence is its only shingle."""
    some: list[np.ndarray] = []  # of a text that comes in pieces
    for p in T.pieces(raw, offsets, lead=n - 1):
        h, g = p.words, T.grams(p.words, n)
        whole = p.last and not p.lead and not some
        for a, b in zip(p.first[:-1], p.first[1:], strict=True):
            if not whole:
                some.append(distinct(g))
            if not p.last:
                continue
            if not whole and any(map(len, some)):
                all_, some = np.concatenate(some), []
                yield distinct(all_)
            elif b - a >= n:
                yield distinct(g[a : b - n + 1])
            elif b > a:
                yield T.mix(T.grams(h[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
        if p.last:
            some = []


def set_print(s: np.ndarray) -> int:
    """A hash of a whole set as a signed long."""
    total = 0
    for a in range(0, len(s), FLUSH):
        total += int(T.mix(T.mix(s[a : a + FLUSH]) + np.uint64(len(s))).sum(dtype=np.uint64))
    total %= 1 << 64
    return total - (1 << 64) if total >> 63 else total


def _pack(n: int, buckets: int):
    def run(batches):
        seen: dict[int, int] = {}  # of this task: equal sets are posted once, by the smallest key so far
        keys, sets, total = [], [], 0

        def flush():
            g = np.concatenate(sets)
            ids = np.repeat(np.array(keys, np.int64), [len(s) for s in sets])
            base = int(ids.min())
            # exact size, not seen at other shingles: bucket by the top 16 bits, marked by the low 48
            order = np.argsort(g)
            g, ids = g[order], (ids[order] - base).astype(np.uint64)
            b = ((g >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
            cut = np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))
            # within a bucket the top bits still differ: order by the mark alone
            rows = [[], [], [], [], []]
            for k in np.flatnonzero(np.diff(cut)):
                m, d = g[cut[k] : cut[k + 1]] & LOW48, ids[cut[k] : cut[k + 1]]
                o = np.argsort(m, kind="stable")
                m, d = m[o], d[o]
                for col, v in zip(rows, (int(k), len(m), base, planes(d), planes(np.diff(m, prepend=np.uint64(0)))), strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.binary())], ["bucket", "size", "base", "ids", "marks"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = T.buffers(batch.column(1))
            prints, sizes = [], []
            for key, s in zip(ids, shingle_sets(raw, off, n), strict=True):
                p = set_print(s)
                prints.append(p)
                sizes.append(len(s))
                if len(s) and key < seen.get((p, len(s)), 1 << 63):
                    seen[p, len(s)] = int(key)
                    for a in range(0, len(s), FLUSH):
                        keys.append(int(key))
                        sets.append(s[a : a + FLUSH])
                        total += len(sets[-1])
                        if total >= FLUSH:
                            yield flush()
                            keys, sets, total = [], [], 0
            if len(ids):
                where = -1 - int(ids[0]) % buckets
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([0], pa.int64()), pa.array([np.ascontiguousarray(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(prints, np.int64).tobytes() + np.array(sizes, np.int32).tobytes()], pa.binary())],
                    ["bucket", "size", "base", "ids", "marks"],
                )
        if total:
            yield flush()

    return run


def _count(group: pa.Table) -> pa.Table:
    """The postings of shingles that a bucket has more than once, with the count; rows on texts pass through."""
    rows = group.to_pylist()
    bucket = rows[0]["bucket"]
    names = ["kind", "key", "gram", "cnt"]
    if bucket < 0:
        key = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        p = np.concatenate([np.frombuffer(r["marks"], np.int64, r["size"]) for r in rows])
        size = np.concatenate([np.frombuffer(r["marks"], np.int32, r["size"], 8 * r["size"]) for r in rows])
        return pa.table([pa.array(np.zeros(len(key), np.int8)), pa.array(key), pa.array(p), pa.array(size)], names)
    mark = np.concatenate([np.cumsum(unplanes(r["marks"], r["size"]), dtype=np.uint64) for r in rows])
    key = np.concatenate([unplanes(r["ids"], r["size"]).astype(np.int64) + r["base"] for r in rows])
    order = np.argsort(mark, kind="stable")
    mark, key = mark[order], key[order]
    start = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    cnt = np.repeat(np.diff(np.append(start, len(mark))), np.diff(np.append(start, len(mark))))
    keep = cnt > 1
    gram = (mark[keep] | (np.uint64(bucket) << np.uint64(48))).view(np.int64)
    return pa.table([pa.array(np.ones(keep.sum(), np.int8)), pa.array(key[keep]), pa.array(gram), pa.array(cnt[keep].astype(np.int32))], names)


def _subsets(percent: int):
    """Hashed subsets by which light sets find each other: one for each overlap that some partner size needs."""

    def run(batches):
        for batch in batches:
            keys, lists = [], []
            for key, n, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = sorted(grams)
                for o in sorted({needed(n, m, percent) for m in range(least_overlap(n, percent), 100 * n // percent + 1)}):
                    if o <= len(g):
                        a = np.array(list(combinations(g, o)), np.int64).view(np.uint64)
                        h = np.full(len(a), o, np.uint64)
                        for c in range(o):
                            h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + a[:, c])
                        keys += [key] * len(a)
                        lists += h.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.int64())], ["key", "gram"])

    return run


def _boundary(lists: DataFrame, posted: DataFrame, percent: int) -> int:
    """The largest size up to which enumerating subsets costs less than scanning inverted lists; from one row per size at most."""
    longer = posted.groupBy("gram").agg(F.count("*").alias("len"))
    scan = {r.n: r.c for r in posted.where(F.col("n") <= LIGHT_MOST).join(longer, "gram").groupBy("n").agg(F.sum("len").alias("c")).collect()}
    enum: dict[int, int] = {}
    for r in lists.where(F.col("n") <= LIGHT_MOST).groupBy("n", F.size("grams").alias("m")).count().collect():
        over = {needed(r.n, p, percent) for p in range(least_overlap(r.n, percent), 100 * r.n // percent + 1)}
        enum[r.n] = enum.get(r.n, 0) + r["count"] * sum(comb(r.m, o) for o in over)
    best, at, gain = 0, 0, 0
    for s in range(1, LIGHT_MOST + 1):
        gain += scan.get(s, 0) - enum.get(s, 0)
        if gain > best:
            best, at = gain, s
    return at


def _verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link; b may be a pivot that very many pairs have."""
    one = lists.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    two = lists.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = spread_join(pairs, two, ["b"], F.col("a")).join(one, "a").withColumn("o", F.size(F.array_intersect("ga", "gb")))
    return both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _crossing(at: DataFrame, x: int, percent: int) -> DataFrame:
    """Pairs (a, b) of entries (gram, sub, key, n, pos, band, part) of one list that may link and are of different parts."""
    size = F.count("*").alias("c")
    parts = at.groupBy("gram", "sub", "part").agg(size)
    lists = parts.groupBy("gram", "sub").agg(F.max(F.struct("c", "part"))["part"].alias("major"), F.sum("c").alias("c"), size.alias("parts")).where("parts > 1")
    entries = spread_join(at, lists.select("gram", "sub", "major", F.ceil(F.col("c") / LIST).cast("int").alias("s")), ["gram", "sub"], F.col("key"), counts=lists.select("gram", "sub", "c"))
    entries = stash(entries.withColumn("most", F.col("part") == F.col("major")).drop("major"), "mixed")
    least = F.ceil(2 * percent * F.col("n") / F.lit(100 + percent))
    p = entries.where(F.col("n") - F.col("pos") >= least).withColumn("salt", F.pmod(F.xxhash64("key"), "s").cast("int"))
    q = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    on = ["gram", "sub", "band", "salt"]
    p, q = (d.select(*on, "most", *(F.col(c).alias(c + t) for c in ("key", "n", "pos", "part"))) for d, t in ((p, "p"), (q, "q")))
    need = F.ceil(percent * (F.col("np") + F.col("nq")) / F.lit(100 + percent))
    fits = (
        (F.col("partp") != F.col("partq")) & ((F.col("np") < F.col("nq")) | ((F.col("np") == F.col("nq")) & (F.col("keyp") < F.col("keyq"))))
        & (100 * F.col("np") >= percent * F.col("nq"))
        & (F.col("sub") | ((F.col("nq") > x) & (F.least(F.col("np") - F.col("posp"), F.col("nq") - F.col("posq")) >= need)))
    )
    pairs = None
    for left, right in ((p.where("not most"), q), (p.where("most"), q.where("not most"))):
        some = left.drop("most").join(right.drop("most"), on).where(fits).select(F.greatest("keyp", "keyq").alias("a"), F.least("keyp", "keyq").alias("b"))
        pairs = some if pairs is None else pairs.union(some)
    return stash(pairs.distinct(), "crossing")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, buckets: int | None = None) -> DataFrame:
    """(key, n_shingles int, component_id) for each row of docs.

    component_id is the smallest key reachable by links.  A null or empty text,
    or one without words, has the empty set and links with nothing: its
    component is its own key.  A text of fewer than n words has its whole
    sequence as one shingle.  Equal texts link.  Keys may repeat or be null: each row
    is then a text of its own under a row number, and components are named by
    the smallest key among their rows (null if all are null).  An empty table
    gives no rows; further columns are ignored.  buckets: parts of the hash
    space, four for each shuffle partition unless given, 65,536 at most.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, distinct = d.agg(F.count("*"), F.count_distinct("key")).first()
    named = rows != distinct
    if named:
        d = stash(d.select(F.monotonically_increasing_id().alias("key"), "text", F.col("key").alias("name")), "named")
        names = d.select("key", "name")
        d = d.select("key", "text")
    buckets = min(buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 65_536)
    found = stash(d.mapInArrow(T.tidied(_pack(n, buckets)), PACKED).groupBy("bucket").applyInArrow(_count, FOUND), "found")
    every = stash(found.where("kind = 0").select("key", F.col("gram").alias("print"), F.col("cnt").alias("n")), "texts")
    classes = stash(every.where("n > 0").groupBy("print", "n").agg(F.min("key").alias("rep"), F.count("*").alias("c")), "classes")
    grams = found.where("kind = 1").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cnt", "gram"))).alias("g"))
    single = F.col("n") - F.size("g")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    lists = stash(
        grams.join(classes.select(F.col("rep").alias("key"), "n"), "key").withColumn("k", prefix - single).where("k > 0")
        .select("key", "n", "k", (F.col("n") - F.size("g")).alias("single"), F.col("g.gram").alias("grams")),
        "lists",
    )
    discard(found)
    posted = lists.select("key", "n", "single", F.posexplode(F.slice("grams", F.lit(1), F.col("k"))).alias("pos", "gram")).select("gram", "key", "n", (F.col("single") + F.col("pos")).alias("pos"))
    x = _boundary(lists, posted, percent)
    light = lists.where(F.col("n") <= x)
    subsets = light.select("key", "n", "grams").mapInArrow(_subsets(percent), "key long, gram long").join(light.select("key", "n"), "key")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    posted = stash(
        posted.select("gram", "key", "n", "pos", F.lit(False).alias("sub")).union(subsets.select("gram", "key", "n", F.lit(0), F.lit(True))).withColumn("band", band),
        "posted",
    )
    on = ["gram", "sub", "band"]
    pivots = stash(posted.groupBy(*on).agg(F.min("key").alias("b"), F.count("*").alias("c")).where("c > 1"), "pivots")
    first = spread_join(posted, pivots.drop("c"), on, F.col("key"), counts=pivots.select(*on, "c")).where("key <> b")
    first = stash(first.select(F.col("key").alias("a"), "b").distinct(), "pairs")
    links = stash(_verified(first, lists, percent), "links")
    parts = stash(connected_components(links, "a", "b"), "parts")
    at = posted.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")
    cross = _crossing(stash(at, "parted"), x, percent)
    more = stash(_verified(cross.join(first, ["a", "b"], "left_anti"), lists, percent), "links")
    parts = stash(connected_components(links.union(more), "a", "b"), "parts")
    for done in (lists, posted, pivots, first, links, cross, more):
        discard(done)
    least = classes.join(parts, F.col("rep") == F.col("node"), "left").select("print", "n", F.coalesce("component", "rep").alias("part"), "c")
    of = spread_join(every, least.drop("c"), ["print", "n"], F.col("key"), "left", counts=least.select("print", "n", "c"))
    out = of.select("key", F.col("n").alias("n_shingles"), F.coalesce("part", "key").alias("part"))
    if named:
        out = out.join(names, "key")
        least = out.groupBy("part").agg(F.min("name").alias("component_id"))
        return out.join(least, "part").select(F.col("name").alias(key), "n_shingles", "component_id")
    return out.select(F.col("key").alias(key), "n_shingles", F.col("part").alias("component_id"))

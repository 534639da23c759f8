"""Per-account timing: rhythm of posting and synchrony with other accounts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.store import plain_sizes, stash


def ratio(a, b):
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def temporal_features(posts: DataFrame) -> DataFrame:
    """(user_id, burstiness, memory_coefficient, posting_entropy, circadian_flatness, n_posts).

    Rows with a null user or time are dropped.  burstiness is (s - m) / (s + m)
    of the gaps between posts, memory the correlation of neighbouring gaps,
    both 0 with too few; entropy and flatness describe the hours of the day.
    One shuffle by user feeds both the gaps and the hours.
    """
    p = posts.where("user_id is not null and created_at is not null").select("user_id", F.unix_timestamp("created_at").alias("t"), F.hour("created_at").alias("h")).repartition("user_id")
    w = Window.partitionBy("user_id").orderBy("t")
    gaps = p.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("before", F.lag("gap").over(w))
    s, m = F.stddev_pop("gap"), F.avg("gap")
    pair = F.col("before").isNotNull()
    one, two = F.when(pair, F.col("before").cast("double")), F.when(pair, F.col("gap").cast("double"))
    hours = [F.count_if(F.col("h") == k).cast("double").alias(f"h{k}") for k in range(24)]
    a = gaps.groupBy("user_id").agg(
        F.count("*").alias("n_posts"), m.alias("m"), s.alias("s"),
        F.covar_pop(one, two).alias("cov"), F.stddev_pop(one).alias("s1"), F.stddev_pop(two).alias("s2"), *hours,
    )
    shares = [F.col(f"h{k}") / F.col("n_posts") for k in range(24)]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in shares), F.lit(0.0)) / math.log2(24)
    cos, sin = (sum((x * f(2 * math.pi * k / 24) for k, x in enumerate(shares)), F.lit(0.0)) for f in (math.cos, math.sin))
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    burst = F.coalesce(ratio(F.col("s") - F.col("m"), F.col("s") + F.col("m")), F.lit(0.0))
    memory = F.when((F.col("n_posts") >= 4) & (F.col("s1") > 0) & (F.col("s2") > 0), ratio(F.col("cov"), F.col("s1") * F.col("s2"))).otherwise(0.0)
    return a.select(
        "user_id", F.when(F.col("n_posts") >= 3, clip(burst)).otherwise(0.0).alias("burstiness"), clip(memory).alias("memory_coefficient"),
        entropy.alias("posting_entropy"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.hypot(cos, sin))).alias("circadian_flatness"), "n_posts",
    )


def presence(posts: DataFrame, window: int) -> DataFrame:
    """Distinct (user_id, bucket) of posts in time buckets of so many seconds."""
    return posts.where("user_id is not null and created_at is not null").select("user_id", F.floor(F.unix_timestamp("created_at") / window).alias("bucket")).distinct()


#: Accounts of a bucket that one task pairs with the others.
BLOCK = 1024


def co_posting(here: DataFrame, least: int = 1) -> DataFrame:
    """(u, v, n): pairs u < v and the occupied buckets whose members, with those of the next bucket, hold both.

    least: pairs with fewer buckets aren't asked for, so accounts with fewer are
    left out before any pairing; so are accounts alone in a bucket.  A bucket of
    very many accounts is paired in blocks, by several tasks.
    """
    buckets = here.select("bucket").distinct()
    early = here.select("user_id", (F.col("bucket") - 1).alias("bucket")).join(buckets, "bucket", "left_semi")
    pool = here.unionByName(early).distinct()
    if least > 1:
        pool = stash(pool, "pool")
        pool = pool.join(pool.groupBy("user_id").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("user_id"), "user_id", "left_semi")
    size = pool.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("s"))
    pool = pool.join(size, "bucket")
    # what is little here is much once paired: the parts are not to be put together again
    parts = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = pool.select(F.col("user_id").alias("u"), "bucket", F.pmod(F.xxhash64("user_id"), "s").cast("int").alias("part")).repartition(parts, "bucket", "part")
    b = pool.select(F.col("user_id").alias("v"), "bucket", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("part")).repartition(parts, "bucket", "part")
    return a.join(b, ["bucket", "part"]).where("u < v").groupBy("u", "v").agg(F.count("*").alias("n"))


#: Accounts of a block of synchrony, in the mean; those of small inputs are cut finer, down to so many, into so many blocks.
MEMBERS, FEW, BLOCKS = 4096, 512, 16
#: A bucket is multiplied as columns of a matrix if more than one in so many of two blocks' pairs meet there; columns at a time; cells or pairs at a time.
MEET, COLUMNS, CELLS = 300, 1024, 1 << 19


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's accounts by bucket in one row: a of each, then the buckets, how many accounts each has, and these."""
    t = pa.Table.from_batches(list(batches))
    block, at, a, bucket = (t.column(c).to_numpy() for c in ("block", "at", "a", "bucket"))
    order = np.lexsort((at, bucket))
    found, sizes = np.unique(bucket, return_counts=True)
    active = np.zeros(int(at.max()) + 1)
    active[at] = a
    parts = [active, found.astype(np.int64), sizes.astype(np.uint16), at[order].astype(np.uint16)]
    yield pa.RecordBatch.from_arrays([pa.array(block[:1], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "active", "buckets", "sizes", "members"])


def _met(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many buckets each account of a block shares with each of another."""
    rows, columns = len(x[0]), len(y[0])
    out = np.zeros((rows, columns), np.float32)
    _, i, j = np.intersect1d(x[1], y[1], assume_unique=True, return_indices=True)
    (n, first), (m, second) = ((s[k], (np.cumsum(s) - s)[k]) for s, k in ((x[2].astype(np.int64), i), (y[2].astype(np.int64), j)))
    entries = lambda first, n: np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    many = n * m * MEET > rows * columns
    dense = np.flatnonzero(many)
    for c in range(0, len(dense), COLUMNS):
        k = dense[c : c + COLUMNS]
        sides = []
        for size, start, side, total in ((n[k], first[k], x, rows), (m[k], second[k], y, columns)):
            sides.append(np.zeros((total, len(k)), np.float32))
            sides[-1][side[3][entries(start, size)], np.repeat(np.arange(len(k)), size)] = 1
        out += sides[0] @ sides[1].T
    rest = np.flatnonzero(~many)
    n, m, first, second = n[rest], m[rest], first[rest], second[rest]
    part = np.cumsum(n * m) // (8 * CELLS)
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1 if len(part) else 0))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = x[3][entries(first[a:b], n[a:b])].astype(np.int64)
        times = np.repeat(m[a:b], n[a:b])  # an account of x meets all of y's in the bucket
        other = y[3][entries(np.repeat(second[a:b], n[a:b]), times)]
        np.add.at(out.reshape(-1), np.repeat(own * columns, times) + other, np.float32(1))
    return out


def _weighed(buckets: int, least: int, lift: float):
    """Of two blocks' accounts, or one's: the best z, the partners of so much lift, the sum of lifts and the pairs, of each account."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = []
        for r in (r for b in batches for r in b.select(["block", "active", "buckets", "sizes", "members"]).to_pylist()):
            sides.append((r["block"], [np.frombuffer(r[c], k) for c, k in (("active", np.float64), ("buckets", np.int64), ("sizes", np.uint16), ("members", np.uint16))]))
        one = len(sides) == 1
        (bx, x), (by, y) = sides[0], sides[-1]
        met = _met(x, y)
        if one:
            np.fill_diagonal(met, 0)
        best, partners, lifts, pairs = ([np.full(len(s[0]), v) for s in (x, y)] for v in (-np.inf, 0.0, 0.0, 0.0))
        step = max(1, CELLS // len(y[0]))
        for a in range(0, len(x[0]), step):
            n = met[a : a + step]
            ok = n >= least
            here, active = slice(a, a + len(n)), x[0][a : a + len(n)]
            if np.count_nonzero(ok) * 8 < ok.size:
                i, j = np.nonzero(ok)
                e = np.maximum(active[i] * y[0][j] / buckets, 1e-9)
                ratio, z = n[i, j] / e, (n[i, j] - e) / np.sqrt(e)
                for k, at in [(0, i + a)] + [(1, j)] * (not one):
                    np.maximum.at(best[k], at, z)
                    for out, value in ((partners, (ratio >= lift).astype(float)), (lifts, ratio), (pairs, None)):
                        out[k] += np.bincount(at, value, len(best[k]))
                continue
            e = np.maximum(np.multiply.outer(active, y[0]) / buckets, 1e-9)
            ratio = np.where(ok, n / e, 0.0)
            z = np.where(ok, (n - e) / np.sqrt(e), -np.inf)
            for k, at, axis in [(0, here, 1)] + [(1, slice(None), 0)] * (not one):
                best[k][at] = np.maximum(best[k][at], z.max(axis))
                for out, value in ((partners, ok & (ratio >= lift)), (lifts, ratio), (pairs, ok)):
                    out[k][at] += value.sum(axis)
        for k, block in [(0, bx)] + [(1, by)] * (not one):
            at = np.flatnonzero(pairs[k])
            cells = [pa.array(np.full(len(at), block), pa.int32()), pa.array(at, pa.int32()), *(pa.array(v[k][at]) for v in (best, partners, lifts, pairs))]
            yield pa.RecordBatch.from_arrays(cells, ["block", "at", "z", "partners", "lifts", "pairs"])

    return run


def synchrony(posts: DataFrame, window: int = 60, min_events: int = 3, lift: float = 2.0) -> DataFrame:
    """(user_id, synchrony_score, synchrony_partner_count, synchrony_mean_lift) for every active account.

    Pairs that meet in min_events buckets or more are weighed against what
    their activity lets expect; score is 1 - exp(-z / 6) of the best pair.
    Accounts are dealt to blocks, and every two blocks are multiplied and
    weighed within a task, so that no pair is ever a row.
    """
    spark = posts.sparkSession
    plain_sizes(spark)
    here = stash(presence(posts, window), "presence")
    active = here.groupBy("user_id").agg(F.count("*").alias("a"))
    buckets = here.select("bucket").distinct()
    early = here.select("user_id", (F.col("bucket") - 1).alias("bucket")).join(buckets, "bucket", "left_semi")
    pool = stash(here.unionByName(early).distinct(), "pool")
    enough = pool.groupBy("user_id").agg(F.count("*").alias("c")).where(F.col("c") >= min_events).select("user_id").join(active, "user_id")
    total = buckets.count()
    accounts = enough.count() if total >= 2 else 0  # one bucket alone says nothing
    if not accounts:
        return active.select("user_id", F.lit(0.0).alias("synchrony_score"), F.lit(0).cast("long").alias("synchrony_partner_count"), F.lit(0.0).alias("synchrony_mean_lift"))
    blocks = max(math.ceil(accounts / MEMBERS), min(BLOCKS, math.ceil(accounts / FEW)))
    placed = enough.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")).withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("user_id")) - 1)
    placed = stash(placed, "placed")
    packs = pool.join(placed, "user_id").select("block", "at", "a", "bucket").groupBy("block").applyInArrow(_packed, "block int, active binary, buckets binary, sizes binary, members binary")
    two = stash(packs, "packs").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    # what is little here is much once paired: the parts are not to be put together again
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * blocks // 2, 2000))
    found = two.repartition(parts, "i", "j").groupBy("i", "j").applyInArrow(_weighed(total, min_events, lift), "block int, at int, z double, partners double, lifts double, pairs double")
    best = found.groupBy("block", "at").agg(F.max("z").alias("z"), F.sum("partners").cast("long").alias("p"), (F.sum("lifts") / F.sum("pairs")).alias("l"))
    best = placed.join(best, ["block", "at"]).select("user_id", (1 - F.exp(-F.greatest("z", F.lit(0.0)) / 6)).alias("s"), "p", "l")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return active.join(best, "user_id", "left").select("user_id", zero("s").alias("synchrony_score"), F.coalesce("p", F.lit(0)).alias("synchrony_partner_count"), zero("l").alias("synchrony_mean_lift"))

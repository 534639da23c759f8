"""Small relational operators: dense row numbers, quotas, balanced samples, leakage, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: str, name: str = "index", buckets: int = 1024) -> DataFrame:
    """df with 0-based positions in order of key.

    Rows are numbered within ranges of the key, and each range starts after the
    rows of those before: no task sees all rows.
    """
    from plumbline.store import stash

    d = stash(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()), "ranges")
    before = d.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = d.join(F.broadcast(before.select("_p", "_b")), "_p")  # a row for each range
    pos = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1 + F.col("_b")
    return out.withColumn(name, pos).select(*df.columns, name)


def running(df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """df with before_<c> for each c: its sum over the rows of the group that come earlier in the order, which has no ties.

    Rows are summed within ranges of (group, order), and each range begins
    with the sums of those before: no task sees a whole group.
    """
    from plumbline.store import stash

    d = stash(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    per = d.groupBy("_p", *group).agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)))
    # a row for each range and group that it has a part of
    earlier = Window.partitionBy(*group or [F.lit(0)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_p", *group, *(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    here = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.select("*", *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_h{i}") for i, c in enumerate(sums))).join(per, ["_p", *group])
    return out.select(*df.columns, *((F.col(f"_h{i}") + F.col(f"_b{i}")).alias(f"before_{c}") for i, c in enumerate(sums)))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row (q array<double>): exact quantiles by linear interpolation; null without rows.

    Values are counted and the counts summed up in ranges, so no task holds all of them.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    r = running(c, [], ["v"], ["n"])
    n = r.agg(F.coalesce(F.max(F.col("before_n") + F.col("n")), F.lit(0)).alias("total"))
    at = F.array(*(F.lit(float(q)) for q in shares))
    want = n.select(F.col("total").alias("_t"), F.transform(at, lambda q: q * (F.col("total") - 1)).alias("_at"))
    spots = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.array(F.floor(a), F.ceil(a)))))
    hits = r.join(F.broadcast(want)).select("v", F.explode(F.filter(spots, lambda k: (k >= F.col("before_n")) & (k < F.col("before_n") + F.col("n")))).alias("k"))  # one row of places
    found = hits.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    j = want.join(F.broadcast(found))
    low, high = (lambda a: F.element_at("m", F.floor(a))), (lambda a: F.element_at("m", F.ceil(a)))
    return j.select(F.when(F.col("_t") > 0, F.transform("_at", lambda a: low(a) + (high(a) - low(a)) * (a - F.floor(a)))).alias("q"))


def quantiles_by(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group, q array<double>): exact quantiles of each group by linear interpolation; groups of any size, as values are counted and counts summed up in ranges.  Null groups and groups without values have none."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    r = running(c, group, ["_v"], ["_n"])
    total = r.groupBy(*group).agg(F.sum("_n").alias("_t"))
    at = F.array(*(F.lit(float(q)) for q in shares))
    spots = F.array_distinct(F.flatten(F.transform(at, lambda q: F.array(F.floor(q * (F.col("_t") - 1)), F.ceil(q * (F.col("_t") - 1))))))
    hits = r.join(total, group).select(*group, "_v", "_t", F.explode(F.filter(spots, lambda k: (k >= F.col("before__n")) & (k < F.col("before__n") + F.col("_n")))).alias("_k"))
    m = hits.groupBy(*group).agg(F.any_value("_t").alias("_t"), F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    low, high = (lambda a: F.element_at("_m", F.floor(a))), (lambda a: F.element_at("_m", F.ceil(a)))
    return m.select(*group, F.transform(F.transform(at, lambda q: q * (F.col("_t") - 1)), lambda a: low(a) + (high(a) - low(a)) * (a - F.floor(a))).alias("q"))


def quota(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order: the operator's own limit.  Spark keeps n rows a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stratified_quota(df: DataFrame, stratum: str, order: list, most: int) -> DataFrame:
    """An equal share of `most` rows for each stratum.  The number of strata is found first, so Spark keeps a stratum's share of rows before the shuffle."""
    k = df.agg(F.count_distinct(stratum)).first()[0]
    return quota(df, [stratum], order, most // max(k, 1))


def seeded(key, seed: int = 42):
    """An order that is the same on every engine: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


#: Ranges of the seeded order in which rows are counted.
SLOTS = 1 << 16


def first_seeded(df: DataFrame, group: str, key: str, keep: DataFrame, seed: int = 42) -> DataFrame:
    """The first rows of each group in seeded order, as many as keep (group, _keep) says.

    Rows are counted by the first sixteen bits of their hash.  Those of the
    slots before that in which a group's number is reached are all kept; only
    those of that slot, one row in SLOTS, are put in order.  Null groups match
    no number.
    """
    d = df.withColumn("_h", seeded(key, seed)).withColumn("_slot", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    per = d.groupBy(group, "_slot").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # SLOTS rows a group at most
    per = per.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(keep, group)
    cut = per.where((F.col("_b") < F.col("_keep")) & (F.col("_b") + F.col("_c") >= F.col("_keep"))).select(group, F.col("_slot").alias("_cut"), (F.col("_keep") - F.col("_b")).alias("_rest"))
    # a group with fewer rows than its number has no cut
    at = d.join(keep, group).join(cut, group, "left").where((F.col("_keep") > 0) & (F.col("_cut").isNull() | (F.col("_slot") <= F.col("_cut"))))
    whole = at.where(F.col("_cut").isNull() | (F.col("_slot") < F.col("_cut")))
    w = Window.partitionBy(group, "_slot").orderBy("_h", key)
    edge = at.where(F.col("_slot") == F.col("_cut")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_rest"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def cap_rows(df: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At least one row and about the same share of each group, in seeded order; all rows if they are few enough."""
    total = df.groupBy(group).agg(F.count("*").alias("_g"))
    every = total.agg(F.sum("_g").alias("_n"))
    keep = F.when(F.col("_n") <= most, F.col("_g")).otherwise(F.greatest(F.lit(1), F.round(F.col("_g") * most / F.col("_n"))))
    return first_seeded(df, group, key, total.join(F.broadcast(every)).select(group, keep.cast("long").alias("_keep")), seed)  # one row


def balance(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has, in seeded order."""
    total = df.groupBy(label).agg(F.count("*").alias("_g"))
    return first_seeded(df, label, key, total.join(F.broadcast(total.agg(F.min("_g").alias("_keep")))).select(label, "_keep"), seed)  # one row


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key, by a minimum that is combined before the shuffle."""
    cols = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    named = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    out = df
    for n, k in zip(named, keys, strict=True):
        if not isinstance(k, str):
            out = out.withColumn(n, k)
    return out.groupBy(*named).agg(F.min(cols).alias("_x")).select(*(F.col(f"_x.{c}").alias(c) for c in df.columns))


def leakage(df: DataFrame, split: str, text) -> DataFrame:
    """(split_a, split_b, overlap, pct): texts that two splits share, for each pair of splits, pairs without any included."""
    h = df.select(F.col(split).alias("s"), F.md5(text).alias("h")).distinct()
    size = h.groupBy("s").agg(F.count("*").alias("n"))
    # splits are few: their pairs are made of the sizes' rows alone
    pairs = size.toDF("split_a", "na").join(F.broadcast(size.toDF("split_b", "nb")), F.col("split_a") < F.col("split_b"))
    both = h.toDF("split_a", "h").join(h.toDF("split_b", "h"), "h").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("o"))
    j = pairs.join(both, ["split_a", "split_b"], "left").withColumn("overlap", F.coalesce("o", F.lit(0)))
    return j.select("split_a", "split_b", "overlap", (100.0 * F.col("overlap") / F.greatest(F.least("na", "nb"), F.lit(1))).alias("pct"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, inverse, balanced): inverse frequency scaled to mean 1, and rows over classes times count."""
    c = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    s = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.avg(1.0 / F.col("n")).alias("m"))
    return c.join(F.broadcast(s)).select("label", "n", (1.0 / F.col("n") / F.col("m")).alias("inverse"), (F.col("t") / (F.col("k") * F.col("n"))).alias("balanced"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, fingerprint): independent of order.  Row digests are added up in parts, so none are gathered."""
    d = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    lanes = [F.conv(F.substr(d, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = df.select(*(x.alias(f"l{k}") for k, x in enumerate(lanes))).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(f"l{k}"), F.lit(0)).alias(f"l{k}") for k in range(8)))
    return sums.select("rows", F.sha2(F.concat_ws(":", *(F.col(f"l{k}").cast("string") for k in range(8))), 256).alias("fingerprint"))


#: Different values of a column up to which their ranks are broadcast.
FEW = 1 << 16


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for each pair of columns: Pearson over average ranks; null for a constant column.

    Ranks come from counts of distinct values, added up in ranges; rows with a very common value are dealt to several tasks.
    """
    from plumbline.operators.skew import spread_join
    from plumbline.store import stash

    out = df.select(F.monotonically_increasing_id().alias("_id"), *columns)
    tie = out.unpivot(["_id"], columns, "c", "v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    rank = stash(running(tie, ["c"], ["v"], ["n"]).select("c", "v", "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("r")), "ranks")
    different = {r["c"]: r["count"] for r in rank.groupBy("c").count().collect()}  # a row a column
    for c in columns:
        one = rank.where(F.col("c") == c).select(F.col("v").alias(c), F.col("r").alias(f"_r_{c}"), "n")
        if different.get(c, 0) <= FEW:
            out = out.join(F.broadcast(one.drop("n")), c, "left")
            continue
        out = spread_join(out, one.drop("n"), [c], F.col("_id"), "left", counts=one.select(c, F.col("n").alias("c")))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    x = lambda c: F.col(f"_r_{c}").cast("double")
    one = out.agg(*(F.covar_pop(x(a), x(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)), *(F.stddev_pop(x(c)).alias(f"s_{c}") for c in columns))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"c{i}"), F.col(f"s_{a}") * F.col(f"s_{b}")).alias("rho")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def integrity(nodes: DataFrame, edges: DataFrame, posts: DataFrame) -> DataFrame:
    """(problem, n): repeated account ids, edges and posts that name no account."""
    ids = nodes.select("user_id").distinct()
    dup = nodes.groupBy("user_id").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_ids").alias("problem"), "n")
    ends = edges.where("source is not null").join(ids.toDF("source"), "source", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling_source"), "n")
    ends2 = edges.join(ids.toDF("target"), "target", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling_target"), "n")
    lost = posts.join(ids, "user_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling_post"), "n")
    return dup.union(ends).union(ends2).union(lost)


#: The most accounts, edges and posts of one submission.
LIMITS = {"nodes": 10_000, "edges": 100_000, "posts": 100_000}


def size_check(nodes: DataFrame, edges: DataFrame, posts: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(part, n, most, ok) of a submission's three tables."""
    limits, out = limits or LIMITS, None
    for name, df in (("nodes", nodes), ("edges", edges), ("posts", posts)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n", F.lit(limits[name]).cast("long").alias("most"), (F.col("n") <= limits[name]).alias("ok"))
        out = one if out is None else out.union(one)
    return out


def join_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with what right has for its keys, numbers it lacks being 0; a key that either has twice is an error."""
    for df in (left, right):
        if not df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            raise ValueError(f"keys {', '.join(keys)} repeat")
    more = [c for c, t in right.dtypes if c not in keys and t in ("double", "float", "int", "bigint", "tinyint", "smallint")]
    return left.join(right, keys, "left").fillna(0, more)


def crossing_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, crossing, rate): rows whose two labels differ."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    one = d.agg(F.count("*").alias("n"), F.count_if(F.col(a) != F.col(b)).alias("crossing"))
    return one.withColumn("rate", F.coalesce(F.try_divide("crossing", "n"), F.lit(0.0)))


def length_alarm(df: DataFrame, label: str, length: str, most: float = 1.75) -> DataFrame:
    """One row (ratio, alarm): the largest over the smallest mean length of a class; so large a ratio lets a model read length alone."""
    m = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg(length).alias("m")).agg(F.max("m").alias("a"), F.min("m").alias("b"))
    return m.select(F.try_divide("a", "b").alias("ratio")).withColumn("alarm", F.coalesce(F.col("ratio") >= most, F.lit(False)))


def truth_counts(df: DataFrame, group: str, truth: str) -> DataFrame:
    """(group, size, truth_counts map): members of each group by what they truly are, unknown ones left out of the map."""
    per = df.groupBy(group, F.col(truth).cast("string").alias("_t")).agg(F.count("*").alias("c"))
    known = F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("k"), F.col("c").alias("v")))))
    return per.groupBy(group).agg(F.sum("c").alias("size"), F.map_from_entries(known).alias("truth_counts"))


def label_shares(df: DataFrame, split: str, label: str) -> DataFrame:
    """(split, n, positive_share): whether a split by groups kept the labels' balance."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("positive_share"))

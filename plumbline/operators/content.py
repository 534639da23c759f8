"""Reuse of texts within and across accounts, hashtag overlap, and edges from shared activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import char_ngrams, normalise
from plumbline.operators.components import connected_components
from plumbline.operators.dedup import near_links
from plumbline.operators.relational import running
from plumbline.operators.skew import spread_join
from plumbline.store import plain_sizes, stash


def duplication(posts: DataFrame, norm: Column | None = None, near: float | None = 0.75) -> DataFrame:
    """(user_id, content_duplication_ratio, cross_account_dup_ratio) by near-equal normalised text.

    Texts whose character 5-gram sets overlap by near or more are linked, and a
    component of links is one text; None: equal texts alone.  A text of one account repeats its own count less one times; of several
    accounts, all its posts are cross-account copies.  Empty texts are no posts.
    Counts for each (text, user) come first, so a text's copies are one row a user.
    """
    plain_sizes(posts.sparkSession)
    norm = normalise(F.col("text"), lower=True, most=None) if norm is None else norm
    p = posts.where("user_id is not null").select("user_id", norm.alias("norm")).where("norm <> ''")
    per = p.groupBy(F.md5("norm").alias("t"), "user_id").agg(F.count("*").alias("c"), F.min("norm").alias("norm"))
    if near is not None:
        per = stash(per, "reuse")
        texts = per.groupBy("t").agg(F.min("norm").alias("norm")).withColumn("g", F.md5(F.array_join(F.array_sort(char_ngrams(F.col("norm"))), "\x1f")))
        texts = stash(texts, "texts")  # g: equal gram sets are one text
        links = near_links(texts.groupBy("g").agg(F.min("norm").alias("norm")), "g", "norm", near)
        group = texts.select("t", "g").join(connected_components(links, "a", "b"), F.col("g") == F.col("node"), "left").select("t", F.coalesce("component", "g").alias("group"))
        per = per.join(group, "t").groupBy(F.col("group").alias("t"), "user_id").agg(F.sum("c").alias("c"))
    users = per.groupBy("t").agg(F.count("*").alias("u"))
    j = per.join(users, "t")
    a = j.groupBy("user_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("u") > 1, F.col("c")).otherwise(0)).alias("x"), F.sum(F.when(F.col("u") == 1, F.col("c") - 1).otherwise(0)).alias("s"))
    return a.select("user_id", (F.col("s") / F.col("n")).alias("content_duplication_ratio"), (F.col("x") / F.col("n")).alias("cross_account_dup_ratio"))


def hashtag_jaccard(edges: DataFrame, posts: DataFrame, cap: int | None = None) -> DataFrame:
    """(user_id, hashtag_jaccard_mean): mean Jaccard of an account's tags with those of its neighbours that have any.

    Neighbours are undirected.  A pair's overlap is taken once and counts for
    both; the ties of an account with very many are dealt to several tasks.
    cap: only the first so many neighbours by id, as the reference samples them.
    """
    tags = posts.select("user_id", F.explode("hashtags").alias("h")).select("user_id", F.ltrim(F.lower("h"), F.lit("#")).alias("h")).where("h <> ''")
    tags = tags.groupBy("user_id").agg(F.collect_set("h").alias("s"))
    und = edges.where("source <> target").select(F.col("source").alias("u"), F.col("target").alias("v"))
    overlap = (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("j")
    if cap is None:
        pairs = stash(und.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "neighbours")
        total, c = pairs.count(), F.count("*").alias("c")
        near = spread_join(pairs, tags.toDF("u", "a"), ["u"], F.col("v"), counts=pairs.groupBy("u").agg(c), total=total)
        near = spread_join(near, tags.toDF("v", "b"), ["v"], F.col("u"), counts=pairs.groupBy("v").agg(c), total=total)
        j = near.select("u", "v", overlap).select(F.explode(F.array("u", "v")).alias("user_id"), "j")
    else:
        und = und.union(und.select("v", "u")).distinct()
        near = und.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("v"))).where(F.col("k") <= cap)
        j = near.join(tags.toDF("u", "a"), "u").join(tags.toDF("v", "b"), "v").select(F.col("u").alias("user_id"), overlap)
    return j.groupBy("user_id").agg(F.avg("j").alias("hashtag_jaccard_mean"))


def coactivity_edges(items: DataFrame, relation: str, low: int = 2, high: int = 50, cap: int | None = 150_000) -> DataFrame:
    """(source, target, relation): accounts that share an item (user_id, item) which `low` to `high` accounts have.

    cap: pairs at most, those of the rarest items (then the least item) first: the operator's own limit.
    """
    d = items.where("user_id is not null and item is not null and item <> ''").select("user_id", "item").distinct()
    pop = d.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    if cap is not None:
        # running pairs in order of rarity decide which items fit
        pop = running(pop.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2), [], ["n", "item"], ["pairs"]).where(F.col("before_pairs") + F.col("pairs") <= cap)
    k = d.join(pop.select("item"), "item")
    j = k.withColumnRenamed("user_id", "source").join(k.withColumnRenamed("user_id", "target"), "item").where("source < target")
    return j.select("source", "target").distinct().withColumn("relation", F.lit(relation))


def mention_edges(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, relation) of @handles in texts that name a known account."""
    at = posts.where(F.contains("text", F.lit("@"))).select(F.col("user_id").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9_]{1,15})"), F.lit(1))).alias("h"))
    who = nodes.where("screen_name is not null").groupBy(F.lower("screen_name").alias("h")).agg(F.min("user_id").alias("target"))
    return at.select("source", F.lower("h").alias("h")).join(who, "h").where("source <> target").select("source", "target").distinct().withColumn("relation", F.lit("mentioned"))


def reference_edges(posts: DataFrame, column: str, relation: str) -> DataFrame:
    """(source, target, relation): posts that refer to another post by id, resolved to its author; of equal ids the last author counts."""
    owner = posts.groupBy(F.col("post_id").alias(column)).agg(F.max_by("user_id", "created_at").alias("target"))
    j = posts.where(F.col(column).isNotNull()).select(F.col("user_id").alias("source"), column).join(owner, column)
    return j.where("source <> target").select("source", "target").distinct().withColumn("relation", F.lit(relation))

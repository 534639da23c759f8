"""Graph corpora to (nodes, edges, posts): each kind of source is a few joins and projections over what readers give."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import binary_label, clean_id, hashtags, mentions
from plumbline.operators.content import coactivity_edges, mention_edges, reference_edges
from plumbline.operators.dedup import grouped_split
from plumbline.operators.relational import keep_first, quota
from plumbline.operators.structure import finalise_edges
from plumbline.schemas import EDGES, NODES, POSTS
from plumbline.sources.readers import resolve_column

#: Ages are counted to here where a record has no time of its own.
TODAY = "2026-01-01"
#: Time formats of sources: the platform's own, then ISO.
FORMATS = ["EEE MMM dd HH:mm:ss Z yyyy", "yyyy-MM-dd HH:mm:ss"]
#: Ties between two accounts, of all relations a source may have.
BETWEEN_USERS = ["follow", "following", "followers", "friend", "mentioned", "retweeted", "quoted", "replied_to", "followed"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    posts: DataFrame


def time_of(value: Column) -> Column:
    """A timestamp from any of the formats, null if none fits."""
    text = value.cast("string")
    own = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3} ", ""), F.lit(FORMATS[0].removeprefix("EEE ")))
    # the first form has letters and the second none: what can't fit isn't tried, a failure being an exception a row
    return F.coalesce(F.when(text.rlike("[A-Za-z]"), own).otherwise(F.try_to_timestamp(text, F.lit(FORMATS[1]))), F.try_to_timestamp(text))


def age_days(born: Column, seen: Column | None = None) -> Column:
    """Whole days from an account's birth to when its record was made, or to a fixed day."""
    until = F.coalesce(*([seen] if seen is not None else []), F.lit(TODAY).cast("timestamp"))
    return F.floor((F.unix_timestamp(until) - F.unix_timestamp(born)) / 86400).cast("double")


def matches(name: Column, pattern: str) -> Column:
    """Whether a name fits a shell pattern, in any case."""
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower(name).rlike(f"^{rx}$")


def label_of_folder(name: Column, human: list[str], bots: list[str]) -> Column:
    """0 or 1 by the folder a file was in; patterns of people are tried first; null if none fits."""
    out = F.lit(None).cast("int")
    for value, patterns in ((1, bots), (0, human)):
        for p in reversed(patterns):
            out = F.when(matches(name, p), value).otherwise(out)
    return out


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """df under a fixed schema: missing columns null, others cast, further ones left out."""
    kinds = dict(x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)", schema))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def profiles(df: DataFrame, aliases: dict[str, list[str]], born: list[str] = ("created_at", "created"), seen: list[str] = ()) -> DataFrame:
    """(user_id and the profile columns that aliases find) of each account's first record."""
    at = {name: resolve_column(df.columns, names) for name, names in aliases.items()}
    if at.get("user_id") is None:
        raise KeyError("no column for user_id")
    out = df.select(*(F.col(f"`{c}`").alias(name) for name, c in at.items() if c), *(F.col(f"`{c}`").alias(k) for k, c in (("_born", resolve_column(df.columns, list(born))), ("_seen", resolve_column(df.columns, list(seen)) if seen else None)) if c))
    out = out.withColumn("user_id", clean_id(F.col("user_id"))).where("user_id is not null")
    if "_born" in out.columns:
        out = out.withColumn("account_age_days", age_days(time_of(F.col("_born")), time_of(F.col("_seen")) if "_seen" in out.columns else None))
    return keep_first(out.drop("_born", "_seen"), ["user_id"], [c for c in ("account_age_days",) if c in out.columns] or ["user_id"])


def endpoints(df: DataFrame, known: DataFrame, relation: str | None = None, source: list[str] = ("source_id", "source", "src"), target: list[str] = ("target_id", "target", "dst")) -> DataFrame:
    """(source, target, relation) of ties between known accounts; a relation column is kept to ties between accounts."""
    s, t = resolve_column(df.columns, list(source)), resolve_column(df.columns, list(target))
    if not s or not t:
        raise KeyError("no columns for the ends of edges")
    r = None if relation else resolve_column(df.columns, ["relation", "relationship", "edge_type", "type"])
    e = df.select(clean_id(F.col(s)).alias("source"), clean_id(F.col(t)).alias("target"), (F.col(r).cast("string") if r else F.lit(relation or "following")).alias("relation"))
    if r:
        e = e.where(F.lower("relation").isin(BETWEEN_USERS))
    ids = known.select("user_id").distinct()
    return e.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi").select("source", "target", "relation")


def timeline(df: DataFrame, user: str, text: str, at: str | None, post: str | None = None) -> DataFrame:
    """Posts with their tags and mentions from rows of a text and its author."""
    return df.where(F.col(user).isNotNull()).select(
        (clean_id(F.col(post)) if post else F.lit(None).cast("string")).alias("post_id"), clean_id(F.col(user)).alias("user_id"), F.col(text).cast("string").alias("text"),
        (time_of(F.col(at)) if at else F.lit(None).cast("timestamp")).alias("created_at"), hashtags(F.col(text)).alias("hashtags"), mentions(F.col(text)).alias("mentions"),
    )


def require_posts(nodes: DataFrame, posts: DataFrame) -> DataFrame:
    """Accounts that posted: whether an account has any text must not tell its label."""
    return nodes.join(posts.select("user_id").distinct(), "user_id", "left_semi")


def activity_edges(posts: DataFrame, nodes: DataFrame, low: int = 2, high: int = 50, cap: int | None = 150_000) -> DataFrame:
    """Replies and re-posts resolved to authors, mentions resolved to accounts, and shared tags, mentions and texts."""
    from plumbline.functions.text import cotext

    parts = [reference_edges(posts, c, r) for c, r in (("reply_to", "replied_to"), ("repost_of", "retweeted")) if c in posts.columns]
    if "screen_name" in nodes.columns:
        parts.append(mention_edges(posts, nodes))
    items = {"co_hashtag": posts.select("user_id", F.explode("hashtags").alias("item")), "co_mention": posts.select("user_id", F.explode("mentions").alias("item")), "co_text": posts.select("user_id", F.md5(cotext(F.col("text"))).alias("item"))}
    parts += [coactivity_edges(d, relation, low, high, cap) for relation, d in items.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finished(nodes: DataFrame, edges: DataFrame, posts: DataFrame, source: str, need_posts: bool = False) -> Graph:
    """The three tables under their schemas: accounts once each, labelled and (unless they have one) with a split by their hash, ties between them, their posts with a time."""
    n = nodes.where(F.col("user_id").isNotNull() & F.col("label").isNotNull())
    n = keep_first(n.withColumn("instance_domain", F.coalesce(F.col("instance_domain") if "instance_domain" in n.columns else F.lit(None).cast("string"), F.lit("x.com"))), ["user_id"], ["label"])
    if need_posts:
        n = require_posts(n, posts)
    e = finalise_edges(edges, n)
    p = posts.where(F.col("created_at").isNotNull()).join(n.select("user_id"), "user_id", "left_semi")
    if "split" not in n.columns:
        n = grouped_split(n, "user_id")
    said = lambda df, schema: shaped(df.withColumn("source_dataset", F.lit(source)), schema)
    return Graph(said(n, NODES), said(e, EDGES), said(p, POSTS))


def folder_corpus(users: DataFrame, human: list[str], bots: list[str], aliases: dict[str, list[str]], source: str, ties: dict[str, DataFrame] | None = None, tweets: DataFrame | None = None, per_user: int = 0, need_posts: bool = False) -> Graph:
    """Accounts labelled by the folder or archive member that holds them (__source_dir), with tie files by relation and tweets.

    Tie and tweet files are read against the labelled accounts alone; per_user
    is the most tweets an account keeps, in order of their ids: the corpus's own quota.
    """
    p = users.withColumn("label", label_of_folder(F.col("__source_dir"), human, bots))
    id_ = resolve_column(users.columns, aliases["user_id"])
    labels = keep_first(p.select(clean_id(F.col(id_)).alias("user_id"), "label", F.col("__source_dir").alias("grp")).where("user_id is not null and label is not null"), ["user_id"], ["grp"])
    nodes = labels.join(profiles(users.drop("__source_dir"), aliases), "user_id")
    edges = nodes.sparkSession.createDataFrame([], "source string, target string, relation string")
    for relation, df in (ties or {}).items():
        edges = edges.union(endpoints(df, nodes, relation))
    posts = nodes.sparkSession.createDataFrame([], POSTS)
    if tweets is not None:
        cols = {k: resolve_column(tweets.columns, v) for k, v in {"user": ["user_id", "author_id"], "text": ["text", "full_text"], "at": ["timestamp", "created_at"], "post": ["id", "tweet_id"], "reply": ["in_reply_to_status_id"], "repost": ["retweeted_status_id"]}.items()}
        posts = timeline(tweets, cols["user"], cols["text"], cols["at"], cols["post"])
        for name, key in (("reply_to", "reply"), ("repost_of", "repost")):
            if cols[key]:
                ref = tweets.select(clean_id(F.col(cols["post"])).alias("post_id"), clean_id(F.col(cols[key])).alias(name))
                posts = posts.join(ref.where(F.col(name).isNotNull()).distinct(), "post_id", "left")
        posts = posts.join(nodes.select("user_id"), "user_id", "left_semi")
        posts = quota(posts, ["user_id"], ["post_id"], per_user) if per_user else posts
        edges = edges.union(activity_edges(posts, nodes).select("source", "target", "relation"))
    return finished(nodes, edges, posts, source, need_posts)


def two_class_corpus(humans: DataFrame, bots: DataFrame, tweets: DataFrame, source: str, per_user: int = 0, since: str | None = None, until: str | None = None) -> Graph:
    """Headerless profiles of two classes (user_id, created_at, collected_at, following, followers, statuses) and tweets (user_id, post_id, text, created_at).

    Ids of both classes are conflicts and go.  Age is to the record's own
    collection: the classes were collected at different times, which a fixed
    day would give away.  Ties come from shared activity alone.
    """
    both = humans.withColumn("label", F.lit(0)).unionByName(bots.withColumn("label", F.lit(1))).withColumn("user_id", F.trim("user_id"))
    nodes = both.select(
        "user_id", "label", *(F.col(a).cast("double").alias(b) for a, b in (("followers", "followers_count"), ("following", "following_count"), ("statuses", "statuses_count"))),
        age_days(time_of(F.col("created_at")), time_of(F.col("collected_at"))).alias("account_age_days"),
    )
    posts = timeline(tweets, "user_id", "text", "created_at", "post_id")
    if since:
        posts = posts.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        posts = posts.where(F.col("created_at") <= F.lit(until).cast("timestamp"))
    posts = quota(posts, ["user_id"], ["post_id"], per_user) if per_user else posts
    nodes = without_conflicts(nodes, "user_id", "label")
    return finished(nodes, activity_edges(posts, nodes).select("source", "target", "relation"), posts, source, need_posts=True)


def without_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows whose key has one label only."""
    bad = df.groupBy(key).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select(key)
    return df.join(bad, key, "left_anti")


def labelled_corpus(labels: DataFrame, source: str, splits: DataFrame | None = None, users: DataFrame | None = None, ties: DataFrame | None = None, tweets: DataFrame | None = None, aliases: dict[str, list[str]] | None = None) -> Graph:
    """A label table, with splits and profiles where there are any, ties of known relations between labelled accounts, and tweets."""
    id_, value = resolve_column(labels.columns, ["id", "user_id", "uid"]), resolve_column(labels.columns, ["label", "class", "is_bot"])
    nodes = keep_first(labels.select(clean_id(F.col(id_)).alias("user_id"), binary_label(F.col(value), ["bot"]).alias("label")).where("user_id is not null and label is not null"), ["user_id"], ["label"])
    if splits is not None:
        s = splits.select(clean_id(F.col(resolve_column(splits.columns, ["id", "user_id"]))).alias("user_id"), F.col(resolve_column(splits.columns, ["split", "set", "partition"])).alias("split"))
        nodes = nodes.join(keep_first(s, ["user_id"], ["split"]), "user_id", "left")
    if users is not None:
        nodes = nodes.join(profiles(users, aliases or {"user_id": ["id", "user_id"], "screen_name": ["username", "screen_name", "name"], "description": ["description", "bio"], "verified": ["verified"]}), "user_id", "left")
    spark = labels.sparkSession
    edges = endpoints(ties, nodes) if ties is not None else spark.createDataFrame([], "source string, target string, relation string")
    posts = spark.createDataFrame([], POSTS)
    if tweets is not None:
        c = {k: resolve_column(tweets.columns, v) for k, v in {"user": ["author_id", "user_id", "uid"], "text": ["text", "full_text", "content"], "at": ["created_at", "timestamp"], "post": ["id", "tweet_id"]}.items()}
        posts = timeline(tweets, c["user"], c["text"], c["at"], c["post"])
    return finished(nodes, edges, posts, source)


def hydrated_corpus(labels: DataFrame, users: DataFrame, source: str, aliases: dict[str, list[str]]) -> Graph:
    """Headerless labels (user_id, label) and user objects that were found for some: an inner join, as which ones were found tells the label.  No ties, no posts."""
    marks = labels.select(F.trim("user_id").alias("user_id"), binary_label(F.col("label"), ["political_bot"]).alias("label")).where("label is not null and user_id <> ''")
    nodes = profiles(users, aliases, ["user.created_at", "user_created_at"], ["created_at", "probe_timestamp"]).join(keep_first(marks, ["user_id"], ["label"]), "user_id")
    spark = labels.sparkSession
    return finished(nodes, spark.createDataFrame([], "source string, target string, relation string"), spark.createDataFrame([], POSTS), source)


GRAPHS = {"folder": folder_corpus, "two_class": two_class_corpus, "labelled": labelled_corpus, "hydrated": hydrated_corpus}

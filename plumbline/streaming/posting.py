"""Streams of posts: co-posting counts in event-time windows, each post once.  These go beyond batch, which has no streams; for quotas see streaming.quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.sinks import save_analyses


def co_posting_counts(posts: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, posts, accounts) for a stream or a table of posts (user_id, created_at); accounts is approximate, as streams allow no distinct counts."""
    p = posts.withWatermark("created_at", late) if posts.isStreaming else posts
    return p.groupBy(F.window("created_at", window)).agg(F.count("*").alias("posts"), F.approx_count_distinct("user_id").alias("accounts"))


def unique_posts(posts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each post id once, as far as late data may come."""
    return posts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["post_id"]) if posts.isStreaming else posts.dropDuplicates(["post_id"])


def append_analyses(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream of analyses in batches, each once."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: save_analyses(df, path)).trigger(availableNow=True).start()

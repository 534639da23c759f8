"""What a service answers: texts, threads, networks and accounts, each scored and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import LLM_TELLS, lexical_score, payload_alerts, tells
from plumbline.operators import scoring as S
from plumbline.plans.network import analyze_network

#: A score that flags; the least area under the curve on unseen campaigns for a graph model to count.
THRESHOLD, TRANSFER = 0.5, 0.70


def flag(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, "adversarial").otherwise("human_benign")


def score_texts(df: DataFrame, text: str = "text", model: str | None = None, reliable: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """df with score, label, risk_score, lexical_score, alerts and style_phrases.

    model: a column with a model's score; without one the lexicon's stands in.
    The risk is the model's only where it is reliable, else the lexicon's.  A
    null text is the empty text.
    """
    d = df.withColumn("lexical_score", lexical_score(F.col(text)))
    d = d.withColumn("score", S.unit(F.col(model)) if model else F.col("lexical_score"))
    return d.withColumn("label", flag(F.col("score"), threshold)).withColumn("risk_score", F.col("score") if reliable and model else F.col("lexical_score")).withColumn("alerts", payload_alerts(F.col(text))).withColumn("style_phrases", tells(F.col(text), LLM_TELLS))


def score_threads(scored: DataFrame, thread: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row a thread of scored posts: the strongest post decides, as one payload in a benign thread is what is looked for."""
    a = scored.groupBy(thread).agg(
        F.count("*").alias("posts_analyzed"), F.avg("score").alias("aggregate_score"), F.max("score").alias("peak_score"), F.max("risk_score").alias("risk_score"),
        F.count_if(F.col("score") >= threshold).alias("flagged_posts"), F.sum(F.size("alerts")).alias("payload_alerts"),
    )
    return a.withColumn("label", flag(F.col("peak_score"), threshold)).withColumn("band", S.band(F.col("risk_score")))


def thread_alerts(scored: DataFrame, thread: str, index: str) -> DataFrame:
    """(thread, index, start, end, sentence, phrases, severity) of every alert."""
    return scored.select(thread, index, F.explode("alerts").alias("x")).select(thread, index, "x.*")


def headline(text_score: Column, evidence: Column, graph_mean: Column, transfer_auc: Column) -> Column:
    """The strongest signal; the graph model's mean only where it held on campaigns it hadn't seen."""
    return F.greatest(F.coalesce(text_score, F.lit(0.0)), F.coalesce(evidence, F.lit(0.0)), F.when(transfer_auc >= TRANSFER, F.coalesce(graph_mean, F.lit(0.0))).otherwise(0.0))


def network_flags(scores: DataFrame, group: str, score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """(group, accounts, aggregate_score, flagged_nodes, label) of accounts' scores."""
    s = S.unit(F.col(score))
    a = scores.groupBy(group).agg(F.count("*").alias("accounts"), F.coalesce(F.avg(s), F.lit(0.0)).alias("aggregate_score"), F.count_if(s >= threshold).alias("flagged_nodes"))
    return a.withColumn("label", flag(F.col("aggregate_score"), threshold))


def explained(*grounds: tuple[Column, Column | str]) -> Column:
    """Those of the (condition, ground) that hold, in one string."""
    return F.concat_ws("; ", *(F.when(c, g if isinstance(g, Column) else F.lit(g)) for c, g in grounds))


def analyze_account(spark: SparkSession, handle: str, peers: int = 5, window: int = 60) -> DataFrame:
    """One row: the whole report on a simulated account's network and posts."""
    from plumbline.operators.generate import simulate_account
    from plumbline.store import stash

    name, g = simulate_account(spark, handle, peers)
    nodes, edges, posts = (stash(df, "account") for df in (g.nodes, g.edges, g.posts))
    t = score_threads(score_texts(posts.withColumn("handle", F.lit(name))), "handle").select("handle", F.col("risk_score").alias("text_score"), "flagged_posts")
    n = analyze_network(nodes, edges, posts, window)
    one = n.join(F.broadcast(t))  # single rows
    return one.withColumn("threat_score", headline(F.col("text_score"), F.col("evidence_score"), F.lit(None).cast("double"), F.lit(None).cast("double"))).withColumn("band", S.band(F.col("threat_score")))


def presets(spark: SparkSession) -> dict:
    """The four known accounts' networks, by handle."""
    from plumbline.operators.generate import HANDLES, simulate_account

    return {h: simulate_account(spark, h)[1] for h in HANDLES}

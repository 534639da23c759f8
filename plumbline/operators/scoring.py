"""Transparent evidence scores, verdicts, bands and attack profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.spans import let
from plumbline.functions.text import payload_alerts

#: Decision floors, fixed by the measures' definitions.
SYNCHRONY, DUPLICATION, RECIPROCITY, SWARM, BURSTY, FOLLOW_RATIO = 0.35, 0.30, 0.50, 2, 0.30, -1.5
#: Output name, aggregate, feature.
METRICS = [
    ("temporal_synchrony", F.avg, "synchrony_score"), ("peak_synchrony", F.max, "synchrony_score"), ("synchronised_partners", F.max, "synchrony_partner_count"),
    ("reciprocity_rate", F.avg, "reciprocity"), ("peak_reciprocity", F.max, "reciprocity"), ("cross_account_duplication", F.avg, "cross_account_dup_ratio"),
    ("peak_cross_account_duplication", F.max, "cross_account_dup_ratio"), ("self_duplication", F.avg, "content_duplication_ratio"), ("burstiness", F.avg, "burstiness"),
    ("circadian_flatness", F.avg, "circadian_flatness"), ("hashtag_overlap", F.avg, "hashtag_jaccard_mean"), ("follower_following_log_ratio", F.avg, "followers_to_following"),
]
#: Phrases of the attack profiles, fixed values.
PROTOCOL = ["[a2a_discovery_spoof]", "[mcp_token_hijack]", "a2a discovery spoof", "mcp token hijack", "mcp tool-poisoning", "forge agent card", "agent card discovery"]
RELAY = ["cross-instance relay", "relay prompt injection", "distributed relay injection", "forward instruction"]
SILENCING = ["defederation", "defederate", "silencing"]
DIRECT = ["ignore previous instructions", "system prompt", "jailbreak", "developer mode", "dan mode"]


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def coordination_metrics(features: DataFrame) -> DataFrame:
    """One row of twelve means and peaks."""
    return features.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(n) for n, f, c in METRICS))


def is_participant() -> Column:
    """Synchrony over its floor, and duplication or reciprocity over theirs."""
    return (F.col("synchrony_score") >= SYNCHRONY) & ((F.col("cross_account_dup_ratio") >= DUPLICATION) | (F.col("reciprocity") >= RECIPROCITY))


def node_evidence() -> Column:
    parts = [(0.40, F.col("synchrony_score")), (0.25, F.col("cross_account_dup_ratio")), (0.20, F.col("reciprocity")), (0.10, F.col("hashtag_jaccard_mean")), (0.05, F.col("synchrony_partner_count") / 10)]
    return F.least(F.lit(1.0), sum((w * unit(c) for w, c in parts), F.lit(0.0)))


def evidence(coordinated: Column, total: Column) -> Column:
    """Over a row of coordination metrics."""
    parts = [(0.35, F.col("peak_synchrony")), (0.30, F.col("peak_cross_account_duplication")), (0.15, F.col("peak_reciprocity")), (0.20, coordinated / F.greatest(total, F.lit(1)))]
    return F.least(F.lit(1.0), sum((w * unit(c) for w, c in parts), F.lit(0.0)))


def subject(coordinated: Column) -> Column:
    swarm = (coordinated >= SWARM) & ((F.col("peak_cross_account_duplication") >= DUPLICATION) | (F.col("peak_reciprocity") >= RECIPROCITY))
    bot = (F.col("burstiness") >= BURSTY) | (F.col("follower_following_log_ratio") <= FOLLOW_RATIO)
    return F.when(swarm, "coordinated_ai_agent_swarm").when(bot, "simple_spambot").otherwise("human")


def reasons(label: Column, coordinated: Column, total: Column) -> Column:
    """The grounds of a verdict, as an array."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    swarm = label == "coordinated_ai_agent_swarm"
    each = [
        F.when(swarm, F.format_string("%d of %d accounts act in synchrony (peak %s)", coordinated.cast("long"), total.cast("long"), two("peak_synchrony"))),
        F.when(swarm & (F.col("peak_cross_account_duplication") >= DUPLICATION), F.concat(F.lit("content is duplicated across accounts, peak "), two("peak_cross_account_duplication"))),
        F.when(swarm & (F.col("peak_reciprocity") >= RECIPROCITY), F.concat(F.lit("ties are mutual, peak "), two("peak_reciprocity"))),
        F.when(label == "simple_spambot", F.concat(F.lit("single accounts look automated, burstiness "), two("burstiness"))),
        F.when(label == "human", F.lit("no measure reaches its floor")),
    ]
    return F.array_compact(F.array(*each))


def band(score: Column, names=("low", "elevated", "high", "critical"), cuts=(0.35, 0.60, 0.85)) -> Column:
    """The band of a score, closed on the left; null stays null."""
    out = F.when(score >= cuts[2], names[3]).when(score >= cuts[1], names[2]).when(score >= cuts[0], names[1])
    return out.when(score.isNotNull(), names[0])


def triage(score: Column, cuts=(0.35, 0.60, 0.82)) -> Column:
    if not cuts[0] < cuts[1] < cuts[2]:
        raise ValueError("thresholds must increase")
    return band(score, ("clear", "monitor", "investigate", "escalate"), cuts)


def says(text: Column, phrases: list[str]) -> Column:
    """Whether a text has one of the phrases; a null has none.  The text, however it is made, is made once."""
    return F.lit(False) if not phrases else F.coalesce(let(text, lambda t: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))), F.lit(False))


def phrase_flags(text: Column) -> dict[str, Column]:
    """Whether a text has a phrase of each group."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {n: says(low, p) for n, p in (("protocol", PROTOCOL), ("relay", RELAY), ("silence", SILENCING), ("direct", DIRECT))}


def profile(federated: Column, alerts: Column) -> Column:
    """The attack profile of a row with protocol, relay, silence, direct, hashtag_overlap, peak_synchrony and replies; the first rule that holds."""
    fed, warned = federated, alerts > 0
    return (
        F.when(fed & F.col("protocol"), "A2A/MCP Protocol Discovery Spoof").when(fed & (F.col("relay") | warned), "Distributed Relay Prompt Injection")
        .when(fed & F.col("silence"), "Federation Moderation Bypass").when(fed, "Cross-Instance Sybil Bridge Attack")
        .when(warned | F.col("direct"), "Direct Prompt Injection").when((F.col("hashtag_overlap") >= 0.35) | (F.col("peak_synchrony") >= 0.50), "Synchronized Hashtag Flood")
        .when(F.col("replies") >= 5, "Central Hub Reply-Hijack").otherwise("Algorithmic Retweet Ring")
    )


def attack_profile(posts: DataFrame, edges: DataFrame, metrics: DataFrame, architecture: DataFrame) -> DataFrame:
    """One row (attack_profile, payload_alerts).  Each group of phrases is looked for post by post and folded to a flag: texts are never joined up."""
    flags = posts.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in phrase_flags(F.col("text")).items()), F.coalesce(F.sum(F.size(payload_alerts(F.col("text")))), F.lit(0)).alias("payload_alerts"))
    replies = edges.agg(F.count_if(F.col("relation") == "replied_to").alias("replies"))
    one = architecture.join(F.broadcast(metrics)).join(F.broadcast(flags)).join(F.broadcast(replies))  # single rows
    return one.select(profile(F.col("network_architecture") == "decentralized_federated", F.col("payload_alerts")).alias("attack_profile"), "payload_alerts")


def suspicious_edges(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the accounts, such as those coordinated and those a model flagged, one under the other."""
    f = flagged.select("user_id").distinct()
    return edges.join(f.toDF("source"), "source", "left_semi").join(f.toDF("target"), "target", "left_semi").select(*edges.columns)


def top_features(features: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(user_id, rank, feature, value): the k features of largest size of each account, ties by name."""
    items = F.array(*(F.struct((-F.abs(F.col(c))).alias("a"), F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns))
    top = features.select("user_id", F.posexplode(F.slice(F.array_sort(items), 1, k)).alias("p", "x"))
    return top.select("user_id", (F.col("p") + 1).alias("rank"), "x.feature", "x.value")

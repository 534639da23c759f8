"""The composed analysis of a network: features, evidence, verdict, architecture, attack profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import scoring as S
from plumbline.operators.features import build_features
from plumbline.operators.structure import architecture
from plumbline.store import stash


def analyze_network(nodes: DataFrame, edges: DataFrame, posts: DataFrame, window: int = 60, near: float | None = 0.75, cap: int | None = None) -> DataFrame:
    """One row: the report on a submission of accounts, their ties and their posts.  Features, metrics and architecture are computed once."""
    f = stash(build_features(nodes, edges, posts, window, near, cap), "features")
    m = stash(S.coordination_metrics(f), "metrics")
    n = f.agg(F.count("*").alias("total_nodes"), F.count_if(S.is_participant()).alias("coordinated_accounts"))
    a = stash(architecture(nodes, edges), "architecture")
    p = S.attack_profile(posts, edges, m, a)
    one = m.join(F.broadcast(n)).join(F.broadcast(a)).join(F.broadcast(p))  # single rows
    one = one.withColumn("evidence_score", S.evidence(F.col("coordinated_accounts"), F.col("total_nodes"))).withColumn("classification", S.subject(F.col("coordinated_accounts")))
    one = one.withColumn("triage_band", S.band(F.col("evidence_score")))
    return one.withColumn("reasons", S.reasons(F.col("classification"), F.col("coordinated_accounts"), F.col("total_nodes")))

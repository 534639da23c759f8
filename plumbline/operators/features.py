"""The per-account feature table, its transfer form, and scaling by training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.content import duplication, hashtag_jaccard
from plumbline.operators.structure import structural_features
from plumbline.operators.temporal import synchrony, temporal_features
from plumbline.schemas import FEATURES


def profile_features(nodes: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return nodes.select("user_id", (F.log1p(n("followers_count")) - F.log1p(n("following_count"))).alias("followers_to_following"), F.greatest(n("account_age_days"), F.lit(0.0)).alias("account_age_days"))


def build_features(nodes: DataFrame, edges: DataFrame, posts: DataFrame, window: int = 60, near: float | None = 0.75, cap: int | None = None) -> DataFrame:
    """(user_id, label, split, the 16 features) for every node; what an account lacks is 0.  near: see duplication; cap: see hashtag_jaccard."""
    out = nodes.select("user_id", "label", "split")
    for part in (synchrony(posts, window), structural_features(nodes, edges), temporal_features(posts), duplication(posts, near=near), hashtag_jaccard(edges, posts, cap), profile_features(nodes)):
        out = out.join(part, "user_id", "left")
    return out.select("user_id", "label", "split", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))


def transfer_features(features: DataFrame) -> DataFrame:
    """Counts on a log scale relative to the graph's size, the degree ratio squashed."""
    n = features.agg(F.log1p(F.greatest(F.count("*"), F.lit(2)) - 1).alias("_d"))
    out = features.join(F.broadcast(n))  # one row
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    for c in ("in_degree", "out_degree", "synchrony_partner_count"):
        out = out.withColumn(c, F.log1p(zero(c)) / F.col("_d"))
    return out.withColumn("degree_ratio", F.tanh(F.log1p(zero("degree_ratio")))).drop("_d", *FEATURES[14:])


def scale_features(features: DataFrame, columns: list[str] | None = None, train: str = "train") -> DataFrame:
    """z-scores by the training rows' mean and population deviation (of all rows if fewer than two are for training)."""
    columns = columns or [c for c in FEATURES if c in features.columns]
    is_train = F.col("split") == train
    pick = lambda c: F.when(is_train, F.col(c))
    stats = features.agg(
        F.count_if(is_train).alias("_n"),
        *(f(pick(c)).alias(f"_t{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))),
        *(f(c).alias(f"_a{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))),
    )
    out = features.join(F.broadcast(stats))  # one row
    few = F.col("_n") < 2
    scaled = {}
    for c in columns:
        m, s = (F.when(few, F.col(f"_a{k}_{c}")).otherwise(F.col(f"_t{k}_{c}")) for k in "ms")
        scaled[c] = (F.col(c) - m) / F.when(s < 1e-8, 1.0).otherwise(s)
    return out.select(*(scaled.get(c, F.col(c)).alias(c) for c in features.columns))


def cohens_d(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean_0, mean_1, cohens_d), strongest first: difference of class means over the pooled sample deviation."""
    long = features.where("label is not null").unpivot(["label"], columns, "feature", "value")
    a = long.groupBy("feature").agg(*(f(F.when(F.col("label") == k, F.col("value"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    pooled = F.sqrt(F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), F.col("n0") + F.col("n1") - 2))
    d = F.round(F.coalesce(F.try_divide(F.col("m1") - F.col("m0"), pooled), F.lit(0.0)), 4)
    return a.select("feature", F.round("m0", 4).alias("mean_0"), F.round("m1", 4).alias("mean_1"), d.alias("cohens_d")).orderBy(F.desc(F.abs("cohens_d")), "feature")

"""The fixed schemas of harmonised tables."""

from __future__ import annotations

TEXT = "uid string, text string, label byte, threat_class string, generator string, domain string, group_id string, source_dataset string, era string"
NODES = (
    "user_id string, label byte, screen_name string, followers_count double, following_count double, statuses_count double, account_age_days double, "
    "verified boolean, description string, split string, campaign_id string, source_dataset string, scenario string, instance_domain string"
)
EDGES = "source string, target string, relation string, campaign_id string, source_dataset string, scenario string, is_cross_instance boolean"
POSTS = "post_id string, user_id string, text string, created_at timestamp, hashtags array<string>, mentions array<string>, campaign_id string, source_dataset string, scenario string"

#: The ordered feature contract; the transfer contract is the same without the last two.
FEATURES = [
    "synchrony_score", "synchrony_partner_count", "reciprocity", "clustering_coefficient", "in_degree", "out_degree", "degree_ratio", "burstiness", "memory_coefficient",
    "posting_entropy", "circadian_flatness", "content_duplication_ratio", "cross_account_dup_ratio", "hashtag_jaccard_mean", "account_age_days", "followers_to_following",
]
TRANSFER = FEATURES[:14]

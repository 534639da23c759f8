"""Queries on accounts, ties and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import content, features, scoring, structure, temporal
from plumbline.operators.components import connected_components
from plumbline.operators.modularity import RESOLUTION, joining_gain, modularity, modularity_communities
from plumbline.plans import views as V
from plumbline.plans.network import analyze_network as analysed
from plumbline.functions import text as X
from plumbline.queries.base import query
from plumbline.schemas import FEATURES, TRANSFER
from plumbline.store import settled, stash

WITH = "WITH RECURSIVE " + V.SQL_VIEWS.strip()


def rounded(df, digits: int = 6):
    """Doubles to a number of places, so that both engines' last bits agree."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def part(*extra: str) -> str:
    return ",".join([WITH, *(x.strip() for x in extra)])


@query(part(V.TEMPORAL) + f"SELECT user_id, n_posts, {r('burstiness', 'memory_coefficient', 'posting_entropy', 'circadian_flatness')} FROM temporal")
def g1_temporal(spark, sf_dir):
    return rounded(temporal.temporal_features(V.posts(spark, sf_dir)))


def _sync(window):
    return part(V.synchrony_sql(window)) + f"SELECT user_id, synchrony_partner_count, {r('synchrony_score', 'synchrony_mean_lift')} FROM sync"


@query(_sync(60))
def g2_synchrony_60s(spark, sf_dir):
    return rounded(temporal.synchrony(V.posts(spark, sf_dir)))


@query(_sync(3600))
def g2_synchrony_1h(spark, sf_dir):
    return rounded(temporal.synchrony(V.posts(spark, sf_dir), 3600))


@query(part(V.STRUCTURE) + f"SELECT user_id, in_degree, out_degree, {r('degree_ratio', 'reciprocity', 'clustering_coefficient')} FROM structure")
def g3_structural(spark, sf_dir):
    return rounded(structure.structural_features(V.accounts(spark, sf_dir), V.edges(spark, sf_dir)))


@query(part(V.STRUCTURE) + f"SELECT user_id, {r('clustering_coefficient')} FROM (SELECT user_id, c AS clustering_coefficient FROM clus)")
def g4_clustering(spark, sf_dir):
    return rounded(structure.clustering(V.edges(spark, sf_dir)))


@query(WITH + "SELECT user_id, round(ln(1 + followers_count) - ln(1 + following_count), 6) + 0.0 AS followers_to_following, account_age_days::DOUBLE AS account_age_days FROM accounts")
def g5_profile(spark, sf_dir):
    return rounded(features.profile_features(V.accounts(spark, sf_dir)))


@query(WITH + """, per AS (SELECT event_type || ' ' || k AS t, user_id, count(*) AS c FROM posts GROUP BY 1, 2), uses AS (SELECT t, count(*) AS u FROM per GROUP BY 1)
SELECT user_id, round(sum(CASE WHEN u = 1 THEN c - 1 ELSE 0 END) * 1.0 / sum(c), 6) + 0.0 AS content_duplication_ratio, round(sum(CASE WHEN u > 1 THEN c ELSE 0 END) * 1.0 / sum(c), 6) + 0.0 AS cross_account_dup_ratio FROM per JOIN uses USING (t) GROUP BY 1""")
def g6_content_duplication(spark, sf_dir):
    """Equal texts alone: the operator's other setting."""
    return rounded(content.duplication(V.posts(spark, sf_dir), near=None))


@query(part(V.STRUCTURE, V.CONTENT) + f"SELECT user_id, {r('content_duplication_ratio', 'cross_account_dup_ratio')} FROM dup")
def g6_near_duplication(spark, sf_dir):
    """Near copies linked, as all the queries on features have it."""
    return rounded(content.duplication(V.posts(spark, sf_dir)))


@query(part(V.STRUCTURE, V.CONTENT) + f"SELECT user_id, {r('hashtag_jaccard_mean')} FROM jac")
def j14_hashtag_jaccard(spark, sf_dir):
    return rounded(content.hashtag_jaccard(V.edges(spark, sf_dir), V.posts(spark, sf_dir), V.NEIGHBOURS))


@query("WITH RECURSIVE " + V.SQL_VIEWS.strip() + """, sym AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
reach AS (SELECT DISTINCT a AS node, a AS root FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.root)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def g7_components(spark, sf_dir):
    return connected_components(V.edges(spark, sf_dir), "source", "target")


def _built(spark, sf_dir, cap=None):
    """The features of all accounts, made once however often a query reads them; what they were made from goes.  cap: see hashtag_jaccard."""
    return settled(spark, "features", lambda: features.build_features(*V.network(spark, sf_dir), 3600, cap=cap))


@query(V.with_features(3600) + f"SELECT user_id, label, split, {r(*FEATURES)} FROM feats")
def g8_features(spark, sf_dir):
    """Tags against those of an account's first neighbours, as the SQL says."""
    return rounded(_built(spark, sf_dir, V.NEIGHBOURS))


_T = ", ".join(
    f"round(ln(1 + {c}) / (SELECT ln(greatest(count(*), 2)) FROM feats), 6) + 0.0 AS {c}" if c in ("in_degree", "out_degree", "synchrony_partner_count")
    else f"round(tanh(ln(1 + {c})), 6) + 0.0 AS {c}" if c == "degree_ratio" else f"round({c}, 6) + 0.0 AS {c}"
    for c in TRANSFER
)


@query(V.with_features(3600, V.WHOLE) + f"SELECT user_id, label, split, {_T} FROM feats")
def g9_transfer(spark, sf_dir):
    return rounded(features.transfer_features(_built(spark, sf_dir)))


_Z = ", ".join(f"round(({c} - avg({c}) FILTER (split = 'train') OVER ()) / CASE WHEN stddev_pop({c}) FILTER (split = 'train') OVER () < 1e-8 THEN 1 ELSE stddev_pop({c}) FILTER (split = 'train') OVER () END, 5) + 0.0 AS {c}" for c in FEATURES)


@query(V.with_features(3600, V.WHOLE) + f"SELECT user_id, label, split, {_Z} FROM feats")
def g10_scaled(spark, sf_dir):
    return rounded(features.scale_features(_built(spark, sf_dir)), 5)


@query(WITH + ", ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM accounts), b AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges) SELECT x.i AS src, y.i AS dst FROM b JOIN ids x ON x.user_id = source JOIN ids y ON y.user_id = target")
def g11_indexed_edges(spark, sf_dir):
    """Dense indices and both directions, as graph learners take them; the index needs one count for each range of ids."""
    from plumbline.operators.relational import dense_index

    ids = dense_index(V.accounts(spark, sf_dir).select("user_id"), "user_id")
    e = V.edges(spark, sf_dir)
    both = e.select("source", "target").union(e.select("target", "source")).distinct()
    return both.join(ids.toDF("source", "src"), "source").join(ids.toDF("target", "dst"), "target").select("src", "dst")


_ARCH = """, dom AS (SELECT instance_domain AS d, count(*) AS c FROM accounts GROUP BY 1), tot AS (SELECT sum(c) AS n FROM dom),
h AS (SELECT CASE WHEN count(*) > 1 THEN greatest(0, -sum(c / n * ln(c / n + 1e-12))) ELSE 0 END AS h, count(*) AS k FROM dom, tot),
x AS (SELECT coalesce(avg(CASE WHEN a.instance_domain <> b.instance_domain THEN 1.0 ELSE 0.0 END), 0) AS r FROM edges JOIN accounts a ON a.user_id = source JOIN accounts b ON b.user_id = target),
ind AS (SELECT user_id, count(source) AS i FROM accounts LEFT JOIN edges ON target = user_id GROUP BY 1),
rk AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM ind),
g AS (SELECT CASE WHEN sum(i) > 0 AND count(*) > 1 THEN greatest(0, least(1, 2.0 * sum(k * i) / (count(*) * sum(i)) - (count(*) + 1.0) / count(*))) ELSE 0 END AS g FROM rk)"""
_BETWEEN = ", " + V.between_sql("SELECT DISTINCT 'all' AS net, source AS a, target AS b FROM edges WHERE source <> target", "SELECT 'all' AS net, user_id FROM accounts") + """,
bends AS (SELECT unnest([source, target]) AS user_id FROM edges JOIN accounts a ON a.user_id = source JOIN accounts b ON b.user_id = target WHERE a.instance_domain <> b.instance_domain),
br AS (SELECT CASE WHEN count(*) FILTER (user_id IN (SELECT user_id FROM bends)) = 0 THEN 0 WHEN sum(d) > 1e-9 THEN greatest(0, least(1, sum(d) FILTER (user_id IN (SELECT user_id FROM bends)) / sum(d)))
  ELSE count(*) FILTER (user_id IN (SELECT user_id FROM bends)) * 1.0 / count(*) END AS bridge FROM btw)"""
_FED = "((h >= 0.30 AND r >= 0.04) OR (k >= 2 AND r >= 0.10))"
_ARCH_COLS = f"""CASE WHEN {_FED} THEN 'decentralized_federated' ELSE 'centralized' END AS network_architecture,
  round(CASE WHEN {_FED} THEN greatest(0.5, least(0.99, 0.55 + 0.30 * least(1, h / 1.4) + 0.15 * least(1, r / 0.3))) ELSE greatest(0.5, least(0.99, 0.60 + 0.40 * (1 - least(1, h / 0.30)) * (1 - least(1, r / 0.04)))) END, 4) AS architecture_confidence,
  round(h, 4) AS instance_entropy, round(r, 4) AS cross_instance_edge_ratio, round(g, 4) AS hub_dominance_gini, round(bridge, 4) + 0.0 AS federation_bridge_centrality"""


@query(WITH + _ARCH + _BETWEEN + f"SELECT {_ARCH_COLS} FROM h, x, g, br")
def g13_architecture(spark, sf_dir):
    nodes, edges, _ = V.network(spark, sf_dir)
    return structure.architecture(nodes, edges)


@query(WITH + """, d AS (SELECT DISTINCT user_id, k FROM posts WHERE k IS NOT NULL), pop AS (SELECT k, count(*) AS n FROM d GROUP BY k HAVING count(*) BETWEEN 2 AND 70)
SELECT DISTINCT a.user_id AS source, b.user_id AS target, 'co_hashtag' AS relation FROM d a JOIN d b ON a.k = b.k AND a.user_id < b.user_id JOIN pop ON pop.k = a.k""")
def g15_coactivity(spark, sf_dir):
    items = V.posts(spark, sf_dir).select("user_id", F.col("k").cast("string").alias("item"))
    return content.coactivity_edges(items, "co_hashtag", 2, 70, None)


@query(WITH + """, d AS (SELECT DISTINCT user_id, k::VARCHAR AS k FROM posts WHERE k IS NOT NULL), pop AS (SELECT k, count(*) AS n FROM d GROUP BY k HAVING count(*) BETWEEN 2 AND 200),
cum AS (SELECT k, sum(n * (n - 1) / 2) OVER (ORDER BY n, k ROWS UNBOUNDED PRECEDING) AS p FROM pop)
SELECT DISTINCT a.user_id AS source, b.user_id AS target, 'co_hashtag' AS relation FROM d a JOIN d b ON a.k = b.k AND a.user_id < b.user_id JOIN cum ON cum.k = a.k WHERE p <= 100000""")
def t3_rarest_pairs(spark, sf_dir):
    items = V.posts(spark, sf_dir).select("user_id", F.col("k").cast("string").alias("item"))
    return content.coactivity_edges(items, "co_hashtag", 2, 200, 100_000)


@query(WITH + """, o AS (SELECT post_id, user_id FROM posts) SELECT DISTINCT p.user_id AS source, o.user_id AS target, 'replied_to' AS relation
FROM posts p JOIN o ON o.post_id = p.k WHERE p.user_id <> o.user_id""")
def g16_reference_edges(spark, sf_dir):
    p = V.posts(spark, sf_dir).withColumnRenamed("k", "reply_to")
    return content.reference_edges(p, "reply_to", "replied_to")


@query(part(V.STRUCTURE) + "SELECT source, target, relation FROM edges WHERE source IN (SELECT user_id FROM structure WHERE reciprocity > 0) AND target IN (SELECT user_id FROM structure WHERE reciprocity > 0)")
def g18_suspicious_edges(spark, sf_dir):
    e = V.edges(spark, sf_dir)
    f = structure.structural_features(V.accounts(spark, sf_dir), e).where("reciprocity > 0")
    return scoring.suspicious_edges(e.select("source", "target", "relation"), f)


_LPA = ",\n".join(
    [f"l{k} AS MATERIALIZED (SELECT source, l FROM (SELECT e.source, l.l, row_number() OVER (PARTITION BY e.source ORDER BY count(*) DESC, l.l) AS k FROM nb e JOIN l{k - 1} l ON l.source = e.target GROUP BY 1, 2) WHERE k = 1)" for k in range(1, 6)]
)


@query(WITH + f""", nb AS MATERIALIZED (SELECT source, target FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target UNION SELECT user_id, user_id FROM accounts),
l0 AS (SELECT user_id AS source, user_id AS l FROM accounts), {_LPA},
num AS (SELECT l, row_number() OVER (ORDER BY count(*) DESC, min(source)) AS community FROM l5 GROUP BY l)
SELECT source AS user_id, community FROM l5 JOIN num USING (l)""")
def g17_communities(spark, sf_dir):
    nodes, edges, _ = V.network(spark, sf_dir)
    return structure.communities(edges, nodes).withColumn("community", F.col("community").cast("long"))


@query(WITH + f""", nb AS MATERIALIZED (SELECT source, target FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target UNION SELECT user_id, user_id FROM accounts),
l0 AS (SELECT user_id AS source, user_id AS l FROM accounts), {_LPA},
w AS (SELECT x.l AS a, y.l AS b FROM nb JOIN l5 x ON x.source = nb.source JOIN l5 y ON y.source = nb.target WHERE nb.source <> nb.target),
t AS (SELECT a, count(*)::DOUBLE AS tot, count(*) FILTER (a = b)::DOUBLE AS i FROM w GROUP BY a)
SELECT (SELECT count(*) FROM accounts) AS accounts, round(sum(i) / sum(tot) - 1.2 * sum(tot * tot) / sum(tot) ** 2, 6) AS label_propagation, true AS not_lower, true AS settled FROM t""")
def g17_modularity(spark, sf_dir):
    """Communities by modularity next to those by labels: all accounts are in one, modularity is not lower, and joining any two communities would lower it."""
    nodes, edges, _ = V.network(spark, sf_dir)
    found = stash(modularity_communities(edges, nodes), "communities")
    own, other = (modularity(edges, p, RESOLUTION) for p in (found, structure.communities(edges, nodes)))
    one = found.agg(F.count_distinct("user_id").alias("accounts")).join(F.broadcast(other.withColumnRenamed("modularity", "label_propagation"))).join(F.broadcast(own)).join(F.broadcast(joining_gain(edges, found, RESOLUTION)))  # single rows
    return rounded(one.select("accounts", "label_propagation", (F.col("modularity") >= F.col("label_propagation")).alias("not_lower"), (F.coalesce("gain", F.lit(0.0)) <= 1e-9).alias("settled")))


@query(WITH + """, c AS (SELECT user_id, CASE WHEN user_id % 7 > 0 THEN campaign_id::VARCHAR END AS c FROM accounts), n AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM c WHERE c IS NOT NULL))
SELECT user_id, coalesce(k, 0) AS community FROM c LEFT JOIN n USING (c)""")
def g17_supplied(spark, sf_dir):
    """Communities that came with the accounts, some without one."""
    nodes, edges, _ = V.network(spark, sf_dir)
    return structure.communities(edges, nodes.withColumn("given", F.when(F.col("user_id") % 7 > 0, F.col("campaign_id"))), supplied="given")


_U = "('0x' || substr(md5({}), 1, 8))::UBIGINT / 4294967296.0"


@query(WITH + f"SELECT source, target, relation FROM edges WHERE {_U.format("'42:' || least(source, target) || ':' || greatest(source, target)")} >= 0.3")
def g12_dropout(spark, sf_dir):
    return structure.dropout(V.edges(spark, sf_dir).select("source", "target", "relation"), 0.3)


@query(WITH + """, one AS (SELECT DISTINCT source, target FROM edges), p AS (SELECT source, row_number() OVER (ORDER BY source, target) AS i FROM one),
q AS (SELECT target, row_number() OVER (ORDER BY md5('42:' || source || ':' || target), source, target) AS i FROM one) SELECT source, target FROM p JOIN q USING (i)""")
def g19_null_graph(spark, sf_dir):
    return structure.permuted_targets(V.edges(spark, sf_dir))


@query(WITH + """, o AS (SELECT post_id, user_id FROM posts) SELECT DISTINCT p.user_id AS source, o.user_id AS target, 'retweeted' AS relation
FROM posts p JOIN o ON o.post_id = p.k WHERE p.user_id <> o.user_id AND p.event_type = 'purchase'""")
def g16_retweet_edges(spark, sf_dir):
    p = V.posts(spark, sf_dir).withColumn("repost_of", F.when(F.col("event_type") == "purchase", F.col("k")))
    return content.reference_edges(p, "repost_of", "retweeted")


@query(WITH + """SELECT DISTINCT p.user_id AS source, a.user_id AS target, 'mentioned' AS relation FROM posts p JOIN accounts a ON a.user_id = p.k WHERE p.user_id <> a.user_id""")
def g16_mention_edges(spark, sf_dir):
    nodes, _, posts = V.network(spark, sf_dir)
    said = posts.withColumn("text", F.concat(F.lit("so says @User_"), F.col("k").cast("string"), F.lit(" today")))
    return content.mention_edges(said, nodes.withColumn("screen_name", F.concat(F.lit("USER_"), F.col("user_id").cast("string"))))


@query(WITH + """, d AS (SELECT DISTINCT user_id, md5(trim(regexp_replace(lower('A shared line: ' || event_type || ' number ' || k || ', see there!'), '[^a-z0-9_]+', ' ', 'g'))) AS t FROM posts WHERE k IS NOT NULL AND length(event_type || k) < 9),
pop AS (SELECT t FROM d GROUP BY t HAVING count(*) BETWEEN 2 AND 30)
SELECT DISTINCT a.user_id AS source, b.user_id AS target, 'co_text' AS relation FROM d a JOIN d b ON a.t = b.t AND a.user_id < b.user_id WHERE a.t IN (SELECT t FROM pop)""")
def g15_cotext(spark, sf_dir):
    """Accounts that share a text once links, case and signs are taken off."""
    p = V.posts(spark, sf_dir).where(F.col("k").isNotNull() & (F.char_length(F.concat("event_type", F.col("k").cast("string"))) < 9))
    said = F.concat(F.lit("A shared  line: https://x.y/"), F.col("post_id").cast("string"), F.lit(" "), "event_type", F.lit(" number "), F.col("k").cast("string"), F.lit(", see there!"))
    return content.coactivity_edges(p.select("user_id", F.md5(X.cotext(said)).alias("item")), "co_text", 2, 30, None)


@query(part(V.STRUCTURE) + """SELECT source, target, relation FROM edges WHERE source IN (SELECT user_id FROM structure WHERE reciprocity > 0.5 UNION SELECT user_id FROM accounts WHERE label = 1) AND target IN (SELECT user_id FROM structure WHERE reciprocity > 0.5 UNION SELECT user_id FROM accounts WHERE label = 1)""")
def u6_flagged_or_coordinated(spark, sf_dir):
    nodes, edges, _ = V.network(spark, sf_dir)
    one = structure.structural_features(nodes, edges).where("reciprocity > 0.5").select("user_id")
    return scoring.suspicious_edges(edges.select("source", "target", "relation"), one.union(nodes.where("label = 1").select("user_id")))


_SY = "coalesce(max(synchrony_score), 0)"
_METRICS = ", ".join(f"coalesce({'avg' if f is F.avg else 'max'}({c}), 0) AS {n}" for n, f, c in scoring.METRICS)


@query(V.with_features(3600) + f"SELECT {r(*(n for n, _, _ in scoring.METRICS))} FROM (SELECT {_METRICS} FROM feats)")
def a14_rollup(spark, sf_dir):
    return rounded(scoring.coordination_metrics(_built(spark, sf_dir, V.NEIGHBOURS)))


_PART = "(synchrony_score >= 0.35 AND (cross_account_dup_ratio >= 0.30 OR reciprocity >= 0.50))"


@query(V.with_features(3600) + f"SELECT user_id FROM feats WHERE {_PART}")
def d1_participants(spark, sf_dir):
    return _built(spark, sf_dir).where(scoring.is_participant()).select("user_id")


@query(V.with_features(3600, V.WHOLE) + "SELECT user_id, round(least(1, 0.40 * least(1, greatest(0, synchrony_score)) + 0.25 * least(1, greatest(0, cross_account_dup_ratio)) + 0.20 * least(1, greatest(0, reciprocity)) + 0.10 * least(1, greatest(0, hashtag_jaccard_mean)) + 0.05 * least(1, greatest(0, synchrony_partner_count / 10))), 6) + 0.0 AS evidence FROM feats")
def d2_node_evidence(spark, sf_dir):
    return rounded(_built(spark, sf_dir).select("user_id", scoring.node_evidence().alias("evidence")))


@query(V.with_features(3600) + ", l AS (UNPIVOT feats ON synchrony_score, reciprocity, in_degree, out_degree, burstiness INTO NAME feature VALUE value), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, feature) AS rank FROM l) SELECT user_id, rank, feature, round(value, 6) + 0.0 AS value FROM k WHERE rank <= 3")
def w7_top_features(spark, sf_dir):
    out = rounded(scoring.top_features(_built(spark, sf_dir), ["synchrony_score", "reciprocity", "in_degree", "out_degree", "burstiness"], 3))
    return out.withColumn("rank", F.col("rank").cast("long"))


_D = [c for c in FEATURES]
_POOL = "sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / nullif(n0 + n1 - 2, 0))"


_COHENS = (f", l AS (UNPIVOT feats ON {', '.join(_D)} INTO NAME feature VALUE value), a AS (SELECT feature, " + ", ".join(f"{f}(value) FILTER (label = {k}) AS {n}{k}" for k in (0, 1) for n, f in (("m", "avg"), ("v", "var_samp"), ("n", "count"))) + f" FROM l GROUP BY feature) SELECT feature, round(m0, 4) AS mean_0, round(m1, 4) AS mean_1, round(coalesce((m1 - m0) / nullif({_POOL}, 0), 0), 4) + 0.0 AS cohens_d FROM a")


def _cohens_d(f):
    return features.cohens_d(f, _D).withColumn("cohens_d", F.col("cohens_d") + 0.0)


@query(V.with_features(3600, V.WHOLE) + _COHENS)
def a18_cohens_d(spark, sf_dir):
    return _cohens_d(_built(spark, sf_dir))


@query(f"SELECT feature, cohens_d FROM ({V.with_features(3600) + _COHENS}) ORDER BY abs(cohens_d) DESC, feature LIMIT 5")
def m13_importance(spark, sf_dir):
    """The five strongest features: a top-k report."""
    return structure.importance(_cohens_d(_built(spark, sf_dir, V.NEIGHBOURS)), "feature", "cohens_d", 5)


@query(WITH + ", c AS (SELECT a.label AS a, b.label AS b, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM edges JOIN accounts a ON a.user_id = source JOIN accounts b ON b.user_id = target GROUP BY 1, 2), s AS (SELECT coalesce(sum(p) FILTER (a = b), 0) AS tr FROM c), q AS (SELECT sum(x * y) AS s FROM (SELECT a AS k, sum(p) AS x FROM c GROUP BY 1) JOIN (SELECT b AS k, sum(p) AS y FROM c GROUP BY 1) USING (k)) SELECT round((tr - s) / nullif(1 - s, 0), 6) + 0.0 AS assortativity FROM s, q")
def a23_assortativity(spark, sf_dir):
    return rounded(structure.assortativity(V.edges(spark, sf_dir), V.accounts(spark, sf_dir)))


@query("WITH RECURSIVE " + V.SQL_VIEWS.strip() + """, one AS (SELECT DISTINCT source, target FROM edges), sym AS (SELECT source AS a, target AS b FROM one UNION SELECT target, source FROM one),
reach AS (SELECT user_id AS node, user_id AS root FROM accounts UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.root),
comp AS (SELECT root, count(*) AS s FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) GROUP BY root),
n AS (SELECT count(*) AS n FROM accounts), e AS (SELECT count(*) AS m, count(b.source) * 1.0 / count(*) AS r FROM one a LEFT JOIN one b ON a.source = b.target AND a.target = b.source)
SELECT n AS n_nodes, m AS n_edges, round(m / (n * (n - 1.0)), 6) AS density, round(r, 6) AS reciprocity, (SELECT count(*) FROM comp) AS n_components, round((SELECT max(s) FROM comp) / n, 6) AS giant_share,
  round((SELECT sum(d) FROM (SELECT a, count(*) AS d FROM (SELECT source AS a FROM one UNION ALL SELECT target FROM one) GROUP BY a)) * 1.0 / n, 6) AS mean_degree,
  (SELECT max(d) FROM (SELECT a, count(*) AS d FROM (SELECT source AS a FROM one UNION ALL SELECT target FROM one) GROUP BY a)) AS max_degree FROM n, e""")
def a24_topology(spark, sf_dir):
    return rounded(structure.topology(V.edges(spark, sf_dir), V.accounts(spark, sf_dir)))


_REPORT = f""", m AS (SELECT {_METRICS}, count(*) AS total_nodes, count(*) FILTER ({_PART}) AS coordinated_accounts FROM feats){_ARCH.replace("\nx AS", "\nxr AS")}{_BETWEEN},
rep AS (SELECT m.*, {_ARCH_COLS}, least(1, 0.35 * least(1, greatest(0, peak_synchrony)) + 0.30 * least(1, greatest(0, peak_cross_account_duplication)) + 0.15 * least(1, greatest(0, peak_reciprocity)) + 0.20 * coordinated_accounts / greatest(total_nodes, 1)) AS evidence_score,
  CASE WHEN coordinated_accounts >= 2 AND (peak_cross_account_duplication >= 0.30 OR peak_reciprocity >= 0.50) THEN 'coordinated_ai_agent_swarm'
    WHEN burstiness >= 0.30 OR follower_following_log_ratio <= -1.5 THEN 'simple_spambot' ELSE 'human' END AS classification FROM m, h, xr, g, br)
SELECT total_nodes, coordinated_accounts, network_architecture, architecture_confidence, federation_bridge_centrality, 0::BIGINT AS payload_alerts, {r("evidence_score", "peak_synchrony", "reciprocity_rate", "hashtag_overlap")}, classification,
  CASE WHEN evidence_score >= 0.85 THEN 'critical' WHEN evidence_score >= 0.60 THEN 'high' WHEN evidence_score >= 0.35 THEN 'elevated' ELSE 'low' END AS triage_band,
  CASE WHEN network_architecture = 'decentralized_federated' THEN 'Cross-Instance Sybil Bridge Attack' WHEN hashtag_overlap >= 0.35 OR peak_synchrony >= 0.50 THEN 'Synchronized Hashtag Flood' ELSE 'Algorithmic Retweet Ring' END AS attack_profile FROM rep"""


@query(V.with_features(3600) + _REPORT)
def analyze_network(spark, sf_dir):
    out = analysed(*V.network(spark, sf_dir), 3600, cap=V.NEIGHBOURS)
    return rounded(out.select("total_nodes", "coordinated_accounts", "network_architecture", "architecture_confidence", "federation_bridge_centrality", "payload_alerts", "evidence_score", "peak_synchrony", "reciprocity_rate", "hashtag_overlap", "classification", "triage_band", "attack_profile"))

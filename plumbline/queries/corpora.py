"""Queries that read the test tables as if they were raw sources, through the parsers of text and graph corpora.

An id of 0 is no id to these parsers, so account 0 is left out by both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import generate as G
from plumbline.operators import relational as R
from plumbline.plans import views as V
from plumbline.queries.base import query, table
from plumbline.queries.graph import WITH, rounded
from plumbline.sources import corpora as C
from plumbline.sources import graphs as S
from plumbline.store import stash

#: A text of plain words for an order, the same in both engines; none of its signs is touched by normalising.
_TEXT = "'order of client ' || (o_custkey % 97) || ' is ' || lower(o_orderstatus) || ' and {}'"


def _said(what: str):
    return F.concat(F.lit("order of client "), (F.col("o_custkey") % 97).cast("string"), F.lit(" is "), F.lower("o_orderstatus"), F.lit(f" and {what}"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _final(rows: str, dataset: str) -> str:
    """The SQL of corpora.finalise over rows (text, label, threat_class, generator, domain, group_id)."""
    return f"""SELECT '{dataset}:' || md5(concat_ws(chr(31), g, generator, text)) AS uid, text, label::TINYINT AS label, coalesce(threat_class, CASE WHEN label = 1 THEN 'machine_generated' ELSE 'human_benign' END) AS threat_class,
  generator, domain, g AS group_id, '{dataset}' AS source_dataset, 'unknown' AS era FROM (SELECT *, coalesce(group_id::VARCHAR, md5(text)) AS g FROM ({rows})) WHERE label IS NOT NULL AND len(string_split(text, ' ')) >= 3"""


@query(_final(f"SELECT {_TEXT.format('flat')} AS text, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label, NULL AS threat_class, 'gen' || (o_custkey % 3) AS generator, NULL AS domain, NULL AS group_id FROM orders", "flat"))
def c1_flat(spark, sf_dir):
    cell = F.when(F.col("o_orderstatus") == "F", "Spambot_7").when(F.col("o_orderstatus") == "O", "genuine").otherwise("?")
    return C.flat(_orders(spark, sf_dir).select(_said("flat").alias("t"), cell.alias("l"), F.concat(F.lit("gen"), (F.col("o_custkey") % 3).cast("string")).alias("g")), "t", "l", "flat", "g")


@query(_final(f"SELECT {_TEXT.format('one')} AS text, 0 AS label, NULL AS threat_class, 'human' AS generator, NULL AS domain, o_orderpriority AS group_id FROM orders UNION ALL SELECT {_TEXT.format('two')}, 0, NULL, 'human', NULL, o_orderpriority FROM orders UNION ALL SELECT {_TEXT.format('three')}, 1, NULL, 'chatgpt', NULL, o_orderpriority FROM orders", "pairs"))
def c2_paired_answers(spark, sf_dir):
    d = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("question"), F.array(_said("one"), _said("two")).alias("human_answers"), F.array(_said("three")).alias("chatgpt_answers"))
    return C.paired_answers(d, "pairs")


@query(_final(f"SELECT {_TEXT.format('mine')} AS text, 0 AS label, NULL AS threat_class, 'human' AS generator, NULL AS domain, o_custkey AS group_id FROM orders UNION ALL SELECT {_TEXT.format('made')}, 1, NULL, 'llama', NULL, o_custkey FROM orders WHERE o_custkey % 2 = 0", "columns"))
def c3_paired_columns(spark, sf_dir):
    d = _orders(spark, sf_dir).select("o_custkey", _said("mine").alias("human_text"), F.when(F.col("o_custkey") % 2 == 0, _said("made")).alias("machine_text"))
    return C.paired_columns(d, "columns", "human_text", {"machine_text": "llama"}, "o_custkey")


@query(_final(f"""SELECT text, greatest(h, a) AS label, CASE WHEN a > 0 THEN 'prompt_injection' WHEN h > 0 THEN 'harmful_completion' ELSE 'human_benign' END AS threat_class,
  CASE WHEN greatest(h, a) > 0 THEN 'adversarial_human_or_llm' ELSE 'human' END AS generator, domain, NULL AS group_id
  FROM (SELECT {_TEXT.format('asked')} AS text, (o_custkey % 3 = 0)::INT AS h, (o_custkey % 5 = 0)::INT AS a, o_orderpriority AS domain FROM orders)""", "flags"))
def c4_harm_flags(spark, sf_dir):
    mark = lambda k, yes, no: F.when(F.col("o_custkey") % k == 0, yes).otherwise(no)
    d = _orders(spark, sf_dir).select(_said("asked").alias("prompt"), mark(3, "harmful", "0").alias("prompt_harm_label"), mark(5, "True", "no").alias("adversarial"), "o_orderpriority")
    return C.harm_flags(d, "flags", domain="o_orderpriority")


@query(_final(f"""SELECT text, y AS label, CASE WHEN y = 0 THEN 'human_benign' WHEN form = 'adversarial' THEN 'jailbreak' ELSE 'harmful_completion' END AS threat_class, 'unknown' AS generator, NULL AS domain, NULL AS group_id FROM (
  SELECT {_TEXT.format('plain')} AS text, 'vanilla' AS form, (o_custkey % 2) AS y FROM orders UNION ALL SELECT {_TEXT.format('twisted')}, 'adversarial', o_custkey % 2 FROM orders WHERE o_custkey % 4 < 2)""", "prompts"))
def c5_prompts(spark, sf_dir):
    d = _orders(spark, sf_dir).select(_said("plain").alias("vanilla"), F.when(F.col("o_custkey") % 4 < 2, _said("twisted")).otherwise(" ").alias("adversarial"), F.when(F.col("o_custkey") % 2 == 1, "vanilla_harmful").otherwise("vanilla_benign").alias("kind"))
    return C.prompts(d, "prompts", F.col("kind"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'gpt4' WHEN o_custkey % 4 = 1 THEN 'davinci' WHEN o_custkey % 4 = 2 THEN 'claude' ELSE 'unknown_llm' END AS generator FROM orders")
def f14_generator(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["Reddit_GPT4.jsonl", "wiki-davinci_003.jsonl", "Claude_v2", "people.csv"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", C.generator_of(names).alias("generator"))


def _users(spark, sf_dir):
    a = V.accounts(spark, sf_dir).select("user_id", "followers_count", "statuses_count")
    folder = F.when(F.col("user_id") % 3 == 0, "Genuine_Accounts.csv").when(F.col("user_id") % 3 == 1, "social_spambots_1.csv").otherwise("unknown")
    born = F.date_format(F.lit("2013-06-11 11:20:35").cast("timestamp") + F.make_dt_interval(F.col("user_id").cast("int")), "EEE MMM dd HH:mm:ss Z yyyy")
    return a.select(F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"), F.col("followers_count").cast("string").alias("followers_count"), born.alias("created_at"), folder.alias("__source_dir"), "user_id")


_ALIASES = {"user_id": ["id"], "screen_name": ["screen_name"], "followers_count": ["followers_count"]}
_AGE = "(DATE '2026-01-01' - DATE '2013-06-11' - 1 - user_id)::DOUBLE"


@query(WITH + f"""SELECT user_id::VARCHAR AS user_id, (user_id % 3)::TINYINT AS label, 'u' || user_id AS screen_name, followers_count::DOUBLE AS followers_count, {_AGE} AS account_age_days FROM accounts
WHERE user_id % 3 < 2 AND user_id <> 0 AND user_id IN (SELECT user_id FROM posts WHERE event_type = 'purchase')""")
def c8_folder_nodes(spark, sf_dir):
    """Accounts labelled by their folder, those without a post left out."""
    t = V.posts(spark, sf_dir).where("event_type = 'purchase'").select(F.col("post_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    g = S.folder_corpus(_users(spark, sf_dir).drop("user_id"), ["genuine*"], ["*spambots*"], _ALIASES, "folder", tweets=t, need_posts=True)
    return g.nodes.select("user_id", "label", "screen_name", "followers_count", "account_age_days")


@query(WITH + """, n AS (SELECT user_id FROM accounts WHERE user_id % 3 < 2 AND user_id <> 0), t AS (SELECT DISTINCT user_id AS source, k AS target, 'following' AS relation FROM posts WHERE event_type = 'view' UNION SELECT DISTINCT k, user_id, 'followers' FROM posts WHERE event_type = 'click')
SELECT source::VARCHAR AS source, target::VARCHAR AS target, relation FROM t WHERE source <> target AND source IN (SELECT user_id FROM n) AND target IN (SELECT user_id FROM n)""")
def c9_folder_edges(spark, sf_dir):
    """Tie files of a folder corpus, read against its labelled accounts alone."""
    p = V.posts(spark, sf_dir)
    tie = lambda kind, a, b: p.where(F.col("event_type") == kind).select(F.col(a).cast("string").alias("source_id"), F.col(b).cast("string").alias("target_id"))
    g = S.folder_corpus(_users(spark, sf_dir).drop("user_id"), ["genuine*"], ["*spambots*"], _ALIASES, "folder", ties={"following": tie("view", "user_id", "k"), "followers": tie("click", "k", "user_id")})
    return g.edges.select("source", "target", "relation")


def _two(spark, sf_dir):
    a = V.accounts(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.lit("2009-01-01 00:00:00").alias("created_at"), F.date_format(F.lit("2009-11-12 10:00:00").cast("timestamp") + F.make_dt_interval(F.col("user_id").cast("int")), "yyyy-MM-dd HH:mm:ss").alias("collected_at"), F.col("following_count").cast("string").alias("following"), F.col("followers_count").cast("string").alias("followers"), F.col("statuses_count").cast("string").alias("statuses"))
    t = V.posts(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.col("post_id").cast("string").alias("post_id"), "text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return S.two_class_corpus(a.where("user_id % 2 = 0"), a.where("user_id % 3 = 0"), t, "two", per_user=5, since="2024-01-05", until="2024-01-12")


@query(WITH + """SELECT user_id::VARCHAR AS user_id, (user_id % 3 = 0)::TINYINT AS label, (DATE '2009-11-12' - DATE '2009-01-01' + user_id)::DOUBLE AS account_age_days FROM accounts
WHERE (user_id % 2 = 0) <> (user_id % 3 = 0) AND user_id IN (SELECT user_id FROM posts WHERE ts >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-12')""")
def c10_two_class_nodes(spark, sf_dir):
    """Accounts of two class files; ids of both are conflicts and go."""
    return _two(spark, sf_dir).nodes.select("user_id", "label", "account_age_days")


@query(WITH + """SELECT post_id::VARCHAR AS post_id, user_id::VARCHAR AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_id::VARCHAR) AS rn FROM posts
WHERE ts >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-12') WHERE rn <= 5 AND (user_id % 2 = 0) <> (user_id % 3 = 0)""")
def c10_two_class_posts(spark, sf_dir):
    """Their posts within a window of time, the corpus's quota for each account."""
    return _two(spark, sf_dir).posts.select("post_id", "user_id")


def _labelled(spark, sf_dir):
    a = V.accounts(spark, sf_dir)
    ids = F.col("user_id").cast("string")
    labels = a.select(ids.alias("id"), F.when(F.col("user_id") % 4 == 0, "bot").when(F.col("user_id") % 4 == 1, "human").otherwise("?").alias("label"))
    splits = a.where("user_id % 5 > 0").select(ids.alias("id"), F.col("split"))
    users = a.select(ids.alias("id"), F.concat(F.lit("n"), ids).alias("username"))
    rel = F.when(F.col("event_type") == "view", "Following").when(F.col("event_type") == "click", "mentioned").otherwise("like")
    ties = V.posts(spark, sf_dir).select(ids.alias("source_id"), F.col("k").cast("string").alias("target_id"), rel.alias("relation"))
    return S.labelled_corpus(labels, "labelled", splits, users, ties)


@query(WITH + "SELECT user_id::VARCHAR AS user_id, (user_id % 4 = 0)::TINYINT AS label, CASE WHEN user_id % 5 > 0 THEN split END AS split, 'n' || user_id AS screen_name FROM accounts WHERE user_id % 4 < 2 AND user_id <> 0")
def c11_labelled_nodes(spark, sf_dir):
    return _labelled(spark, sf_dir).nodes.select("user_id", "label", "split", "screen_name")


@query(WITH + """SELECT DISTINCT user_id::VARCHAR AS source, k::VARCHAR AS target, CASE event_type WHEN 'view' THEN 'Following' ELSE 'mentioned' END AS relation FROM posts
WHERE event_type IN ('view', 'click') AND user_id <> k AND user_id % 4 < 2 AND k % 4 < 2 AND user_id <> 0 AND k <> 0 AND k IN (SELECT user_id FROM accounts)""")
def c11_labelled_edges(spark, sf_dir):
    return _labelled(spark, sf_dir).edges.select("source", "target", "relation")


@query(WITH + "SELECT user_id::VARCHAR AS user_id, (user_id % 2)::TINYINT AS label, followers_count::DOUBLE AS followers_count, 30.0::DOUBLE AS account_age_days FROM accounts WHERE user_id % 3 > 0")
def c12_hydrated_nodes(spark, sf_dir):
    """Labelled accounts whose user object was found; the rest would tell their label by having none."""
    a = V.accounts(spark, sf_dir)
    labels = a.select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("user_id"), F.when(F.col("user_id") % 2 == 1, "political_Bot").otherwise("human").alias("label"))
    seen = a.where("user_id % 3 > 0").select(F.col("user_id").cast("double").cast("decimal(20,1)").cast("string").alias("user.id_str"), F.col("followers_count").alias("user.followers_count"), F.lit("Thu Jan 01 00:00:00 +0000 2015").alias("user.created_at"), F.lit("Sat Jan 31 12:00:00 +0000 2015").alias("created_at"))
    return S.hydrated_corpus(labels, seen, "hydrated", {"user_id": ["user.id_str"], "followers_count": ["user.followers_count"]}).nodes.select("user_id", "label", "followers_count", "account_age_days")


@query(WITH + "SELECT user_id FROM accounts WHERE user_id IN (SELECT user_id FROM posts WHERE value > 97)")
def p11_require_posts(spark, sf_dir):
    return S.require_posts(V.accounts(spark, sf_dir), V.posts(spark, sf_dir).where("value > 97")).select("user_id")


@query(WITH + """, g AS (SELECT campaign_id, user_id, in_degree FROM accounts JOIN (SELECT target AS user_id, count(*) AS in_degree FROM edges GROUP BY 1) USING (user_id)),
t AS (SELECT a.campaign_id, p.user_id, round(max(value), 6) AS top FROM posts p JOIN accounts a USING (user_id) WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT campaign_id, user_id, in_degree, coalesce(top, 0) AS top FROM g LEFT JOIN t USING (campaign_id, user_id)""")
def j12_joined_once(spark, sf_dir):
    """Graph scores with text scores by campaign and account; both must name each once."""
    nodes, edges, posts = V.network(spark, sf_dir)
    who = nodes.select("campaign_id", "user_id")
    g = who.join(edges.groupBy(F.col("target").alias("user_id")).agg(F.count("*").alias("in_degree")), "user_id").select("campaign_id", "user_id", "in_degree")
    t = who.join(posts.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("top")), "user_id").select("campaign_id", "user_id", "top")
    return rounded(R.join_once(g, t, ["campaign_id", "user_id"]))


#: Endings that make texts with other numbers near copies, fixed here and in the SQL.
_ENDINGS = ["which the night shift packed before the last train left for the harbour towns", "because nobody at the counter had asked for the signed papers of the second carrier", "and it waits in the long hall until the driver with the blue van comes back again"]
_LONG = "'order of client ' || (o_custkey % 97) || ' is ' || lower(o_orderstatus) || ' and done, ' || (['" + "', '".join(_ENDINGS) + "'])[o_custkey % 3 + 1]"


@query(f"""WITH RECURSIVE a AS ({_final(f"SELECT {_LONG} AS text, 0 AS label, NULL AS threat_class, 'unknown' AS generator, NULL AS domain, NULL AS group_id FROM orders WHERE o_orderpriority < '3'", "a")}),
b AS ({_final(f"SELECT {_LONG} AS text, 1 AS label, NULL AS threat_class, 'unknown' AS generator, NULL AS domain, NULL AS group_id FROM orders WHERE o_orderpriority >= '3'", "b")}),
u AS (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY o, uid) AS k FROM u),
e AS MATERIALIZED (SELECT text, label, source_dataset, row_number() OVER (ORDER BY o, uid) AS i FROM k WHERE k = 1),
g AS MATERIALIZED (SELECT i, list_distinct(list_transform(range(1, length(text) - 3), lambda j: substr(lower(text), j, 5))) AS g FROM e),
near AS MATERIALIZED (SELECT y.i, list(x.i) AS near, row_number() OVER (ORDER BY y.i) AS k FROM g x JOIN g y ON x.i < y.i AND len(list_intersect(x.g, y.g)) >= 0.9 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) GROUP BY y.i),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT near.k, CASE WHEN len(list_filter(near, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, i) ELSE gone END FROM r JOIN near ON near.k = r.k + 1)
SELECT text, label, source_dataset FROM e WHERE NOT list_contains((SELECT gone FROM r ORDER BY k DESC LIMIT 1), i)""")
def x5_text_corpus(spark, sf_dir):
    """Two corpora that share texts, and near ones, made one: the first writer of a text stays."""
    o = _orders(spark, sf_dir)
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("o_custkey") % 3 + 1).cast("int"))
    said = F.concat(_said("done, "), ending)
    parts = {n: C.flat(o.where(c).select(said.alias("t"), F.lit(y).alias("l")), "t", "l", n) for n, c, y in (("a", "o_orderpriority < '3'", "0"), ("b", "o_orderpriority >= '3'", "1"))}
    return C.build_text_corpus(parts).select("text", "label", "source_dataset")


@query("SELECT count(*) AS n, count(*) FILTER (quality <> toxic) AS crossing, round(count(*) FILTER (quality <> toxic) * 1.0 / count(*), 6) AS rate FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def a10_crossing_rate(spark, sf_dir):
    return rounded(R.crossing_rate(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("WITH m AS (SELECT avg(n_chars) AS m FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality) SELECT round(max(m) / min(m), 6) AS ratio, max(m) / min(m) >= 1.75 AS alarm FROM m")
def a3_length_alarm(spark, sf_dir):
    return rounded(R.length_alarm(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "quality", "n_chars"))


@query(WITH + ", c AS (SELECT campaign_id, CASE WHEN user_id % 5 > 0 THEN label END AS t, count(*) AS c FROM accounts GROUP BY 1, 2) SELECT campaign_id, sum(c)::BIGINT AS size, string_agg(t || ':' || c, ',' ORDER BY t) FILTER (t IS NOT NULL) AS truth FROM c GROUP BY 1")
def a12_truth_counts(spark, sf_dir):
    a = V.accounts(spark, sf_dir).withColumn("truth", F.when(F.col("user_id") % 5 > 0, F.col("label")))
    out = R.truth_counts(a, "campaign_id", "truth")
    return out.select("campaign_id", "size", F.array_join(F.transform(F.map_entries("truth_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("truth"))


@query("SELECT CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(avg(quality), 6) AS positive_share FROM (SELECT quality, ('0x' || substr(md5('42:' || source), 1, 8))::UBIGINT / 4294967296.0 AS h FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def x4_label_shares(spark, sf_dir):
    from plumbline.operators.dedup import grouped_split

    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(R.label_shares(grouped_split(d, "source"), "split", "quality"))


@query(WITH + """SELECT part, n, most, n <= most AS ok FROM (SELECT 'nodes' AS part, (SELECT count(*) FROM accounts) AS n, 10000::BIGINT AS most UNION ALL SELECT 'edges', (SELECT count(*) FROM edges), 100000 UNION ALL SELECT 'posts', (SELECT count(*) FROM posts), 100000)""")
def p14_size_check(spark, sf_dir):
    nodes, edges, posts = V.network(spark, sf_dir)
    return R.size_check(nodes, edges, posts)


@query(r"SELECT page_id, regexp_replace(regexp_replace(trim(url), '/+$', ''), '^.*/', '') AS handle FROM pages")
def p15_handles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.handle_of(F.concat(F.lit(" "), F.col("url"), F.lit("/ "))).alias("handle"))


@query(r"SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS id, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) AS name FROM orders")
def p13_clean_ids(spark, sf_dir):
    raw = F.when(F.col("o_custkey") % 10 == 0, F.lit(" nan ")).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")))
    return _orders(spark, sf_dir).select("o_orderkey", X.clean_id(raw).alias("id"), X.canonical_name(F.col("o_orderpriority")).alias("name"))


@query()
def n2_campaign(spark, sf_dir):
    """A generated campaign's posts: checked by its counts, its structure and its repeatability in tests."""
    return G.campaign(spark, "product_shill", 909)[1].select("post_id", "user_id", "role", "phase", "turn", "text", "created_at", "carries_injection", "campaign_id")


@query("SELECT s || '__seed_' || k AS campaign_id, 48::BIGINT AS accounts, 8::BIGINT AS agents FROM (SELECT unnest(['civic_disinfo', 'decentralized_mastodon_bridge_attack']) AS s), (SELECT unnest([101, 202, 303]) AS k)")
def n3_campaign_bank(spark, sf_dir):
    """Two scenarios by three seeds under one another; no account of one is in another."""
    g, _ = G.campaign_bank(spark, ["civic_disinfo", "decentralized_mastodon_bridge_attack"], [101, 202, 303])
    return g.nodes.where(F.col("user_id").startswith(F.concat("campaign_id", F.lit("::")))).groupBy("campaign_id").agg(F.count_distinct("user_id").alias("accounts"), F.count_if(F.col("label") == 1).alias("agents"))


@query("SELECT 'synthetic:' || i AS uid, (i % 3 = 0)::INT AS label FROM range(500) t(i)")
def n1_synthetic_texts(spark, sf_dir):
    return G.synthetic_texts(spark, 500).where("length(text) > 0").select("uid", "label")


@query("SELECT DISTINCT 's' || i AS source, 's' || t AS target FROM (SELECT i, floor(200 * (('0x' || substr(md5('42:' || i || ':' || j), 1, 8))::UBIGINT / 4294967296.0))::BIGINT AS t FROM range(200) x(i), (SELECT unnest([1, 2, 3, 4]) AS j)) WHERE i <> t")
def n1_synthetic_graph(spark, sf_dir):
    return G.synthetic_graph(spark, 200)[1].select("source", "target")


@query()
def n4_simulated_account(spark, sf_dir):
    g = G.simulate_account(spark, "https://x.com/Central_Trend_Swarm/")[1]
    return stash(g.edges, "ties").select("source", "target", "relation", "is_cross_instance")

"""The logical tables over the test data: accounts, ties and posts from events, texts from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.structure import finalise_edges
from plumbline.queries.base import table
from plumbline.store import plain_sizes, stash


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("event_id").alias("post_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.array(F.concat(F.lit("#"), k)).alias("hashtags"), k.cast("long").alias("k"), "event_type", "value", F.concat_ws(" ", "event_type", k).alias("text"))


def accounts(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    p = posts(spark, sf_dir) if of is None else of
    a = p.groupBy("user_id").agg(F.count("*").alias("statuses_count"), F.count_distinct("k").alias("followers_count"), F.count_distinct("event_type").alias("following_count"), F.floor((F.max(F.unix_timestamp("created_at")) - F.min(F.unix_timestamp("created_at"))) / 86400).alias("account_age_days"))
    split = F.when(F.col("user_id") % 10 < 7, "train").when(F.col("user_id") % 10 == 7, "val").otherwise("test")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), F.col("toxic").alias("label"))
    return a.join(lab, "user_id", "left").select("user_id", F.coalesce("label", F.lit(0)).alias("label"), split.alias("split"), "statuses_count", "followers_count", "following_count", "account_age_days", F.concat(F.lit("inst"), F.col("user_id") % 4).alias("instance_domain"), (F.col("user_id") % 6).alias("campaign_id"))


def edges(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    p = posts(spark, sf_dir) if of is None else of
    e = p.select(F.col("user_id").alias("source"), F.col("k").alias("target"), F.col("event_type").alias("relation"))
    return finalise_edges(e, accounts(spark, sf_dir, p) if nodes is None else nodes)


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accounts, edges, posts), each made once and written, for plans that read them several times."""
    plain_sizes(spark)
    p = stash(posts(spark, sf_dir), "posts")
    n = stash(accounts(spark, sf_dir, p), "accounts")
    return n, stash(edges(spark, sf_dir, p, n), "ties"), p


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, score, grp): labels with a score of the text's length, coarse enough for ties."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("toxic").alias("y"), ((F.col("n_chars") * 7 % 101) / 101.0).alias("score"), F.col("source").alias("grp"))


#: The same tables for DuckDB.
SQL_VIEWS = """
posts AS (SELECT event_id AS post_id, user_id, ts, floor(epoch(ts))::BIGINT AS t, hour(ts) AS h, (props->>'$.k')::BIGINT AS k, event_type, value FROM events),
accounts AS (SELECT p.user_id, coalesce(any_value(l.toxic), 0) AS label, CASE WHEN p.user_id % 10 < 7 THEN 'train' WHEN p.user_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,
  count(*) AS statuses_count, count(DISTINCT k) AS followers_count, count(DISTINCT event_type) AS following_count, (max(t) - min(t)) // 86400 AS account_age_days,
  'inst' || (p.user_id % 4) AS instance_domain, p.user_id % 6 AS campaign_id FROM posts p LEFT JOIN labels l ON l.doc_id = p.user_id GROUP BY p.user_id),
edges AS (SELECT DISTINCT user_id AS source, k AS target, event_type AS relation FROM posts WHERE user_id <> k AND k IN (SELECT user_id FROM accounts)),
scored AS (SELECT doc_id, toxic AS y, (n_chars * 7 % 101) / 101.0::DOUBLE AS score, source AS grp FROM documents JOIN labels USING (doc_id))
"""
TEMPORAL = """
gaps AS (SELECT user_id, t, h, t - lag(t) OVER w AS gap FROM posts WINDOW w AS (PARTITION BY user_id ORDER BY t)),
gaps2 AS (SELECT *, lag(gap) OVER (PARTITION BY user_id ORDER BY t) AS before FROM gaps),
rhythm AS (SELECT user_id, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s, covar_pop(before, gap) AS cov,
  stddev_pop(before) AS s1, stddev_pop(CASE WHEN before IS NOT NULL THEN gap END) AS s2 FROM gaps2 GROUP BY user_id),
hours AS (SELECT user_id, h, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM posts GROUP BY user_id, h),
daily AS (SELECT user_id, -sum(p * log2(p)) / log2(24) AS e, 1 - sqrt(sum(p * cos(2 * pi() * h / 24)) ** 2 + sum(p * sin(2 * pi() * h / 24)) ** 2) AS f FROM hours GROUP BY user_id),
temporal AS (SELECT user_id, CASE WHEN n >= 3 AND s + m > 0 THEN (s - m) / (s + m) ELSE 0 END AS burstiness,
  CASE WHEN n >= 4 AND s1 > 0 AND s2 > 0 THEN greatest(-1, least(1, cov / (s1 * s2))) ELSE 0 END AS memory_coefficient,
  e AS posting_entropy, greatest(0, least(1, f)) AS circadian_flatness, n AS n_posts FROM rhythm JOIN daily USING (user_id))
"""


def synchrony_sql(window: int) -> str:
    return f"""
here AS (SELECT DISTINCT user_id, t // {window} AS b FROM posts),
pool AS (SELECT user_id, b FROM here UNION SELECT user_id, b - 1 FROM here WHERE b - 1 IN (SELECT b FROM here)),
pairs AS (SELECT p.user_id AS u, q.user_id AS v, count(*) AS n FROM pool p JOIN pool q ON p.b = q.b AND p.user_id < q.user_id GROUP BY 1, 2 HAVING count(*) >= 3),
act AS (SELECT user_id, count(*) AS a FROM here GROUP BY 1),
weighed AS (SELECT u, v, n, greatest(x.a * y.a * 1.0 / (SELECT count(DISTINCT b) FROM here), 1e-9) AS e FROM pairs JOIN act x ON x.user_id = u JOIN act y ON y.user_id = v),
ends AS (SELECT unnest([u, v]) AS user_id, 1 - exp(-greatest((n - e) / sqrt(e), 0) / 6) AS s, n / e AS l FROM weighed),
sync AS (SELECT act.user_id, coalesce(max(s), 0) AS synchrony_score, count(*) FILTER (l >= 2) AS synchrony_partner_count, coalesce(avg(l), 0) AS synchrony_mean_lift FROM act LEFT JOIN ends USING (user_id) GROUP BY 1)
"""


STRUCTURE = """
one AS (SELECT DISTINCT source, target FROM edges),
rec AS (SELECT a.source AS user_id, count(b.source) * 1.0 / count(*) AS r FROM one a LEFT JOIN one b ON a.source = b.target AND a.target = b.source GROUP BY 1),
und AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM edges),
sym AS (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und),
deg AS (SELECT a AS user_id, count(*) AS d FROM sym GROUP BY 1),
tri AS (SELECT x.a AS user_id, count(*) AS t2 FROM sym x JOIN sym y ON x.a = y.a JOIN sym z ON z.a = x.b AND z.b = y.b GROUP BY 1),
clus AS (SELECT user_id, coalesce(t2, 0) * 1.0 / (d * (d - 1)) AS c FROM deg LEFT JOIN tri USING (user_id) WHERE d >= 2),
structure AS (SELECT a.user_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(o.n, 0) / (coalesce(i.n, 0) + 1.0) AS degree_ratio,
  coalesce(r, 0) AS reciprocity, coalesce(c, 0) AS clustering_coefficient FROM accounts a LEFT JOIN (SELECT target AS user_id, count(*) AS n FROM edges GROUP BY 1) i USING (user_id)
  LEFT JOIN (SELECT source AS user_id, count(*) AS n FROM edges GROUP BY 1) o USING (user_id) LEFT JOIN rec USING (user_id) LEFT JOIN clus USING (user_id))
"""
#: Texts whose character 5-gram sets overlap by three quarters are linked, and a component of links is one text.
_CONTENT = """
tx AS MATERIALIZED (SELECT t, CASE WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) END AS g FROM (SELECT DISTINCT event_type || ' ' || k AS t FROM posts)),
gx AS MATERIALIZED (SELECT t, len(g) AS n, unnest(g) AS x FROM tx),
lk AS MATERIALIZED (SELECT x.t AS a, y.t AS b FROM gx x JOIN gx y ON x.x = y.x AND x.t <> y.t GROUP BY 1, 2 HAVING count(*) >= 0.75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT t AS node, t AS root FROM tx UNION SELECT r.node, b FROM reach r JOIN lk ON a = r.root), grp AS MATERIALIZED (SELECT node AS t, min(root) AS grp FROM reach GROUP BY node),
per AS (SELECT grp AS t, user_id, count(*) AS c FROM posts JOIN grp ON grp.t = event_type || ' ' || k GROUP BY 1, 2),
uses AS (SELECT t, count(*) AS u FROM per GROUP BY 1),
dup AS (SELECT user_id, sum(CASE WHEN u = 1 THEN c - 1 ELSE 0 END) * 1.0 / sum(c) AS content_duplication_ratio, sum(CASE WHEN u > 1 THEN c ELSE 0 END) * 1.0 / sum(c) AS cross_account_dup_ratio
  FROM per JOIN uses USING (t) GROUP BY 1),
tags AS (SELECT user_id, list(DISTINCT k) AS s FROM posts WHERE k IS NOT NULL GROUP BY 1)"""
_JACCARD = """,
jac AS (SELECT a AS user_id, avg(len(list_intersect(x.s, y.s)) * 1.0 / len(list_distinct(list_concat(x.s, y.s)))) AS hashtag_jaccard_mean
  FROM {near} JOIN tags x ON x.user_id = a JOIN tags y ON y.user_id = b{some} GROUP BY 1)
"""
#: The texts, and tags against those of the first neighbours; WHOLE: of all neighbours.
NEIGHBOURS = 200
CONTENT = _CONTENT + """,
near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS rn FROM sym)""" + _JACCARD.format(near="near", some=f" WHERE rn <= {NEIGHBOURS}")
WHOLE = _CONTENT + _JACCARD.format(near="sym", some="")
_COLS = "synchrony_score synchrony_partner_count reciprocity clustering_coefficient in_degree out_degree degree_ratio burstiness memory_coefficient posting_entropy circadian_flatness content_duplication_ratio cross_account_dup_ratio hashtag_jaccard_mean account_age_days followers_to_following".split()
FEATURES_SQL = f"""
feats AS (SELECT a.user_id, a.label, a.split, {", ".join(f"coalesce({c if c not in ('account_age_days', 'followers_to_following') else 'a.account_age_days' if c == 'account_age_days' else 'ln(1 + followers_count) - ln(1 + following_count)'}, 0)::DOUBLE AS {c}" for c in _COLS)}
  FROM accounts a LEFT JOIN sync USING (user_id) LEFT JOIN structure USING (user_id) LEFT JOIN temporal USING (user_id) LEFT JOIN dup USING (user_id) LEFT JOIN jac USING (user_id))
"""


def with_features(window: int, content: str = CONTENT) -> str:
    return "WITH RECURSIVE " + ",".join(x.strip() for x in (SQL_VIEWS, TEMPORAL, synchrony_sql(window), STRUCTURE, content, FEATURES_SQL))


def between_sql(adjacent: str, members: str, levels: int = 7) -> str:
    """CTEs up to btw (net, user_id, d): shares of shortest paths through each member, for graphs no deeper than so many levels.

    adjacent: a query of distinct (net, a, b); members: one of (net, user_id).
    """
    out = [f"adj AS MATERIALIZED ({adjacent})", f"mem AS MATERIALIZED ({members})", "p0 AS MATERIALIZED (SELECT net, user_id AS s, user_id AS v, 1.0::DOUBLE AS g FROM mem)", "z0 AS MATERIALIZED (SELECT net, s, v FROM p0)"]
    for k in range(1, levels + 1):
        out.append(f"p{k} AS MATERIALIZED (SELECT p.net, p.s, j.b AS v, sum(g) AS g FROM p{k - 1} p JOIN adj j ON j.net = p.net AND j.a = p.v ANTI JOIN z{k - 1} z ON z.net = p.net AND z.s = p.s AND z.v = j.b GROUP BY 1, 2, 3)")
        out.append(f"z{k} AS MATERIALIZED (SELECT * FROM z{k - 1} UNION ALL SELECT net, s, v FROM p{k})")
    out.append(f"q{levels} AS MATERIALIZED (SELECT net, s, v, g, 0.0::DOUBLE AS d FROM p{levels})")
    for k in range(levels - 1, -1, -1):
        out.append(f"q{k} AS MATERIALIZED (SELECT p.net, p.s, p.v, any_value(p.g) AS g, coalesce(sum(p.g / q.g * (1 + q.d)), 0) AS d FROM p{k} p LEFT JOIN adj j ON j.net = p.net AND j.a = p.v LEFT JOIN q{k + 1} q ON q.net = p.net AND q.s = p.s AND q.v = j.b GROUP BY 1, 2, 3)")
    every = " UNION ALL ".join(f"SELECT net, s, v, d FROM q{k}" for k in range(levels + 1))
    out.append(f"btw AS (SELECT net, v AS user_id, sum(CASE WHEN s <> v THEN d ELSE 0 END) AS d FROM ({every}) GROUP BY 1, 2)")
    return ",\n".join(out)

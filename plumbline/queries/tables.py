"""Queries of relational shape: quotas, summaries, set operations, joins, sinks' data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import metrics as M
from plumbline.operators import relational as R
from plumbline.operators import scoring as S
from plumbline.operators import sketches as K
from plumbline.operators.intervals import asof_join, within_spans
from plumbline.plans import views as V
from plumbline.queries.base import query, table
from plumbline.queries.graph import WITH, rounded
from plumbline.sources import sinks
from plumbline.store import stash

MD5 = "md5('42:' || doc_id)"


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3")
def s8_user_quota(spark, sf_dir):
    return R.quota(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 3)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 400 // (SELECT count(DISTINCT source) FROM documents)")
def s7_stratified_quota(spark, sf_dir):
    return R.stratified_quota(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 400)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS g, count(*) OVER () AS n FROM documents) WHERE k <= CASE WHEN n <= 300 THEN g ELSE greatest(1, round(g * 300.0 / n)) END")
def t4_cap_rows(spark, sf_dir):
    return R.cap_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 300)


@query(f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {MD5}, doc_id) AS k FROM labels) WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic))")
def t5_balance(spark, sf_dir):
    return R.balance(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("SELECT event_id, ts::VARCHAR AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def t2_recent(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    at = F.when(F.date_format("ts", "SSSSSS") == "000000", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(at)
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", at.alias("at"))


@query("SELECT toxic AS label, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(stddev_samp(n_chars), 5) AS std FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a3_length_balance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    one = d.groupBy("toxic").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.stddev_samp("n_chars").alias("std")).join(R.quantiles_by(d, ["toxic"], "n_chars", [0.5, 0.95]), "toxic", "left")
    out = rounded(one.select(F.col("toxic").alias("label"), "n", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "std"))
    return out.withColumn("std", F.round("std", 5))


@query("SELECT user_id, round(max(value), 6) AS top, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a4_account_scores(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("p95")))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS k FROM events) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, round(coalesce(stddev_samp(value), 0), 6) AS std, round(avg(value) FILTER (k <= 3), 6) AS top3, round(avg((value >= 50)::INT), 6) AS flagged FROM k GROUP BY 1")
def a5_account_scores_hist(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"))))
    return rounded(e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.9).alias("p90"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.avg(F.when(F.col("k") <= 3, F.col("value"))).alias("top3"), F.avg((F.col("value") >= 50).cast("int")).alias("flagged")))


@query("WITH q AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents), b AS (SELECT CASE WHEN n_chars <= q[1] THEN 1 WHEN n_chars <= q[2] THEN 2 WHEN n_chars <= q[3] THEN 3 ELSE 4 END AS bucket, n_chars FROM documents, q) SELECT bucket, count(*) AS n, round(avg(n_chars), 6) AS mean FROM b GROUP BY 1")
def a7_quartiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars")
    q = R.quantiles(d, "n_chars", [0.25, 0.5, 0.75])
    b = d.join(F.broadcast(q)).select(F.when(F.col("n_chars") <= F.col("q")[0], 1).when(F.col("n_chars") <= F.col("q")[1], 2).when(F.col("n_chars") <= F.col("q")[2], 3).otherwise(4).alias("bucket"), "n_chars")  # one row of cuts
    return rounded(b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1")
def a9_phase_timeline(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value >= 85) AS critical, count(*) FILTER (value < 35) AS low, round(coalesce(avg(value), 0), 6) AS mean FROM events")
def a11_dashboard(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") >= 85).alias("critical"), F.count_if(F.col("value") < 35).alias("low"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean")))


@query(WITH + "SELECT campaign_id, count(*) AS size, count(*) FILTER (statuses_count >= 60) AS active, round(avg(statuses_count), 6) AS mean_posts, count(*) FILTER (label = 1) AS agents FROM accounts GROUP BY 1")
def a12_clusters(spark, sf_dir):
    return rounded(V.accounts(spark, sf_dir).groupBy("campaign_id").agg(F.count("*").alias("size"), F.count_if(F.col("statuses_count") >= 60).alias("active"), F.avg("statuses_count").alias("mean_posts"), F.count_if(F.col("label") == 1).alias("agents")))


_RK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"""WITH k AS (SELECT {_RK.format(c="l_quantity")} AS q, {_RK.format(c="l_discount")} AS d, {_RK.format(c="l_tax")} AS t FROM lineitem)
SELECT a, b, round(rho, 6) + 0.0 AS rho FROM (SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_discount', 'l_discount', 'l_tax']) AS a, unnest(['l_quantity', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS b, unnest([corr(q, q), corr(q, d), corr(q, t), corr(d, d), corr(d, t), corr(t, t)]) AS rho FROM k)""")
def a19_spearman(spark, sf_dir):
    return rounded(R.spearman(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"]))


@query("SELECT source, count(*) AS rows, count(*) FILTER (toxic = 1) AS adversarial, round(avg(toxic), 6) AS pos_rate, count(DISTINCT lang) AS generators, round(median(n_chars), 6) AS median_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a25_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    one = d.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("toxic") == 1).alias("adversarial"), F.avg("toxic").alias("pos_rate"), F.count_distinct("lang").alias("generators"))
    return rounded(one.join(R.quantiles_by(d, ["source"], "n_chars", [0.5]), "source", "left").select(*one.columns, F.col("q")[0].alias("median_chars")))


@query("SELECT a, b, count(*) AS n FROM (SELECT x.n_regionkey AS a, y.n_regionkey AS b FROM customer JOIN nation x ON c_nationkey = x.n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation y ON s_nationkey = y.n_nationkey) GROUP BY 1, 2")
def j13_label_crosstab(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    x, y = (t("nation").select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(r)) for k, r in (("c_nationkey", "a"), ("s_nationkey", "b")))
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.join(x, "c_nationkey").join(y, "s_nationkey").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j16_activity_per_account(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 49)")
def j8_conflicts_removed(spark, sf_dir):
    bad = table(spark, sf_dir, "lineitem").where("l_discount > 0.09 and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(bad, "s_suppkey", "left_anti")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, NULL AS city FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, 'none' FROM supplier")
def u1_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("none").alias("city"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT user_id, event_type FROM events")
def u2_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").distinct()


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE value > 90")
def u5_intersection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("value > 90").select("user_id"))


@query("SELECT source, CASE WHEN regexp_matches(source, '[13579]$') THEN 1 WHEN regexp_matches(source, '8') THEN 0 END AS label, count(*) AS n FROM documents GROUP BY 1, 2")
def p10_label_from_name(spark, sf_dir):
    lab = F.when(F.col("source").rlike("[13579]$"), 1).when(F.col("source").rlike("8"), 0)
    return table(spark, sf_dir, "documents").groupBy("source", lab.alias("label")).agg(F.count("*").alias("n"))


_VALUES = ["bot", "Human", " 1 ", "0", "007", "spambot_2", "genuine_accounts", "unharmful", "", "what", "FAKE followers", "benign", "real"]


@query("SELECT unnest([" + ", ".join(f"'{v}'" for v in _VALUES) + "]) AS value, unnest([1, 0, 1, 0, 1, 1, 0, 1, NULL, NULL, 1, 0, 0]) AS label")
def p3_label_map(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in _VALUES], "value string").select("value", X.binary_label(F.col("value")).alias("label"))


@query(r"SELECT page_id, lower(coalesce(nullif(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), ''), 'x.com')) AS domain FROM pages")
def p6_domain(spark, sf_dir):
    host = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")[0]
    return table(spark, sf_dir, "pages").select("page_id", X.domain_of(F.lit("a"), F.when(host != "", host)).alias("domain"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'")
def p9_time_range(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), 'src2')")
def p12_holdout(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(S.says(F.lower("source"), ["src1", "src2"])).select("doc_id")


@query(WITH + """SELECT problem, n FROM (SELECT 'duplicate_ids' AS problem, (SELECT count(*) FROM (SELECT user_id FROM accounts GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL
SELECT 'dangling_source', (SELECT count(*) FROM posts WHERE user_id NOT IN (SELECT user_id FROM accounts)) UNION ALL SELECT 'dangling_target', (SELECT count(*) FROM posts WHERE k NOT IN (SELECT user_id FROM accounts)) UNION ALL
SELECT 'dangling_post', (SELECT count(*) FROM posts WHERE user_id NOT IN (SELECT user_id FROM accounts)))""")
def p14_integrity(spark, sf_dir):
    p = V.posts(spark, sf_dir)
    return R.integrity(V.accounts(spark, sf_dir), p.select(F.col("user_id").alias("source"), F.col("k").alias("target")), p)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND lower(l_returnflag) IN ('r', 'a')")
def s10_filtered_edges(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").where(F.lower("l_returnflag").isin("r", "a")).select("l_orderkey", "l_linenumber").join(known, "l_orderkey", "left_semi")


@query("SELECT 'node' AS row_type, user_id::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS tags FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'post', event_id::VARCHAR, user_id::VARCHAR, '#' || (props->>'$.k') FROM events")
def k5_export(spark, sf_dir):
    from plumbline.sources.sinks import export_rows

    p = V.posts(spark, sf_dir)
    n = p.select(F.col("user_id").cast("string").alias("a")).distinct()
    return export_rows({"node": n, "post": p.select(F.col("post_id").cast("string").alias("a"), F.col("user_id").cast("string").alias("b"), F.col("hashtags").alias("tags"))})


@query("WITH g AS (SELECT lang, doc_id, n_chars, rank() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT lang, doc_id FROM g WHERE r <= 5")
def w6_longest_per_group(spark, sf_dir):
    return R.quota(table(spark, sf_dir, "documents"), ["lang"], [F.desc("n_chars"), "doc_id"], 5).select("lang", "doc_id")


@query(WITH + "SELECT doc_id, CASE WHEN score >= 0.82 THEN 'escalate' WHEN score >= 0.6 THEN 'investigate' WHEN score >= 0.35 THEN 'monitor' ELSE 'clear' END AS triage, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'elevated' ELSE 'low' END AS band FROM scored")
def d6_bands(spark, sf_dir):
    return V.scored(spark, sf_dir).select("doc_id", S.triage(F.col("score")).alias("triage"), S.band(F.col("score")).alias("band"))


@query(WITH + ", c AS (SELECT campaign_id, row_number() OVER (ORDER BY md5('42:' || campaign_id), campaign_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT campaign_id FROM accounts)) SELECT campaign_id, CASE WHEN k <= greatest(2, round(0.25 * n)) THEN 'test' WHEN k <= greatest(2, round(0.25 * n)) + greatest(1, round(0.2 * n)) THEN 'val' ELSE 'train' END AS split FROM c")
def d16_campaign_split(spark, sf_dir):
    c = V.accounts(spark, sf_dir).select("campaign_id").distinct()
    w = Window.orderBy(R.seeded("campaign_id"), "campaign_id")  # campaigns are few
    k = c.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    test, val = F.greatest(F.lit(2), F.round(0.25 * F.col("n"))), F.greatest(F.lit(1), F.round(0.2 * F.col("n")))
    return k.select("campaign_id", F.when(F.col("k") <= test, "test").when(F.col("k") <= test + val, "val").otherwise("train").alias("split"))


@query(WITH + "SELECT doc_id, round(0.55 * score + 0.45 * ((doc_id * 13 % 101) / 101.0), 6) AS weighted, round(greatest(score, (doc_id * 13 % 101) / 101.0), 6) AS rule_or FROM scored")
def d12_fusion(spark, sf_dir):
    g = (F.col("doc_id") * 13 % 101) / 101.0
    return rounded(V.scored(spark, sf_dir).select("doc_id", (0.55 * F.col("score") + 0.45 * g).alias("weighted"), F.greatest("score", g).alias("rule_or")))


@query(WITH + ", e AS (SELECT doc_id, y, CASE WHEN y = 1 THEN score * 0.5 ELSE score END AS score FROM scored) SELECT count(*) AS n, count(*) FILTER (y = 1 AND score >= 0.5) AS caught, count(*) FILTER (y = 1) AS positives FROM e")
def d15_evasion(spark, sf_dir):
    e = V.scored(spark, sf_dir).withColumn("score", F.when(F.col("y") == 1, F.col("score") * 0.5).otherwise(F.col("score")))
    return M.evaluate(e).select("n", F.col("tp").alias("caught"), F.col("n_pos").alias("positives"))


@query("""WITH c AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, coalesce(c.event_id, -1) AS last_event_id, round(c.value, 6) AS last_value FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_last_click(spark, sf_dir):
    """Every other event with the last click of its user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = asof_join(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), ["user_id"], "ts", ties=["event_id"])
    return out.select("event_id", "user_id", F.coalesce("last_event_id", F.lit(-1)).alias("last_event_id"), F.round("last_value", 6).alias("last_value"))


@query("SELECT e.event_id, s.event_id AS signup_id FROM events e JOIN events s ON s.event_type = 'signup' AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 30 MINUTE")
def events_after_signups(spark, sf_dir):
    """Every event in the half hour after any signup."""
    e = table(spark, sf_dir, "events")
    spans = e.where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("ts").alias("low"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("high"))
    return within_spans(e.select("event_id", "ts"), spans, [], "ts", "low", "high", 1800).select("event_id", "signup_id")


@query("""WITH p AS (SELECT click_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN props ELSE '{}' END AS p FROM clicks)
SELECT click_id, coalesce((p->>'$.k')::BIGINT, -1) AS k, p->>'$.device.os' AS os, len(json_keys(p))::INT AS n_keys FROM p""")
def details_with_fallback(spark, sf_dir):
    """Every click's JSON cell, broken ones as the empty object."""
    d = table(spark, sf_dir, "clicks").select("click_id", sinks.details(F.col("props")).alias("v"))
    return d.select("click_id", F.coalesce(F.try_variant_get("v", "$.k", "long"), F.lit(-1)).alias("k"), F.try_variant_get("v", "$.device.os", "string").alias("os"), F.size(F.col("v").cast("map<string,variant>")).alias("n_keys"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS texts, count(*) FILTER (event_type = 'purchase') AS networks, count(*) FILTER (value / 100 >= 0.6) AS high_risk, round(coalesce(avg(value / 100), 0), 6) AS mean_score FROM events")
def a11_totals(spark, sf_dir):
    """The dashboard's totals over analyses made of events."""
    kind = F.when(F.col("event_type") == "click", "text").when(F.col("event_type") == "purchase", "network").otherwise("other")
    e = table(spark, sf_dir, "events").select(kind.alias("analysis_type"), (F.col("value") / 100).alias("score"), F.col("ts").alias("created_at"))
    return rounded(sinks.dashboard(e)[0])


@query(WITH + """, r AS (SELECT label, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS r FROM accounts), s AS (SELECT count(*) AS n, count(*) FILTER (label = 1)::DOUBLE AS p, sum(r) FILTER (label = 1) AS t FROM r)
SELECT n, round((t - p * (p + 1) / 2) / nullif(p * (n - p), 0), 6) AS auc, coalesce(abs((t - p * (p + 1) / 2) / nullif(p * (n - p), 0) - 0.5) >= 0.1, false) AS leaks FROM s""")
def a23_id_audit(spark, sf_dir):
    """Whether accounts' numbers tell their labels."""
    return rounded(M.id_audit(V.accounts(spark, sf_dir)))


@query("""WITH q AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT event_type, n, users, true AS users_near, true AS quantiles_near FROM q""")
def sketches_by_type(spark, sf_dir):
    """Sketches of every day and type, stored and merged by type: within four standard errors of the exact counts, and quantiles within two in a hundred of their rank."""
    e = table(spark, sf_dir, "events")
    shares = [0.1, 0.5, 0.9]
    got = K.merged(stash(K.sketched(e, "ts", ["event_type"], "user_id", "value"), "sketches"), ["event_type"], shares)
    users = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    j = e.join(got, "event_type").groupBy("event_type").agg(F.any_value("n").alias("n"), F.any_value("people").alias("people"), *(F.avg((F.col("value") <= F.col("q")[i]).cast("double")).alias(f"r{i}") for i in range(len(shares))))
    near = F.lit(True)
    for i, q in enumerate(shares):
        near = near & (F.abs(F.col(f"r{i}") - q) <= 0.02)
    return j.join(users, "event_type").select("event_type", "n", "users", (F.abs(F.col("people") - F.col("users")) <= 4 * 1.04 / 2 ** (K.K / 2) * F.col("users") + 1).alias("users_near"), near.alias("quantiles_near"))

"""Queries through the service's plans.  The test texts have no phrase of the lexicons, so one of them, by the row's key, is put behind each text."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import scoring as S
from plumbline.plans import service
from plumbline.queries.base import query, table
from plumbline.queries.graph import rounded

_LEXICON = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in X.INJECTION_TELLS) + "]"
_STYLE = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in X.LLM_TELLS) + "]"
#: Every phrase of all lists, and as many empty ones.
PHRASES = [*X.INJECTION_TELLS, *X.LLM_TELLS, *S.PROTOCOL, *S.RELAY, *S.SILENCING, *S.DIRECT]
PHRASES = [*PHRASES, *[""] * len(PHRASES)]
_ALL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"


def planted(text, key):
    """A text with a phrase behind it."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(". So: "), F.upper(F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(key, F.lit(len(PHRASES))) + 1).cast("int"))))


def planted_sql(text: str, key: str) -> str:
    return f"coalesce({text}, '') || '. So: ' || upper({_ALL}[({key}) % {len(PHRASES)} + 1])"


def _lex(t: str, lexicon: str = _LEXICON) -> str:
    return f"list_filter({lexicon}, lambda p: contains(lower({t}), p))"


_SCORED = f"SELECT *, 1 - exp(-0.9 * len({_lex('t')})) AS score FROM "
_SENT = r"list_filter(list_transform(regexp_extract_all(t, '[^.!?\n]*[.!?]+|[^.!?\n]+|\n'), lambda s: trim(s, ' ')), lambda s: s <> '' AND s <> chr(10))"


@query(f"SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'adversarial' ELSE 'human_benign' END AS label, round(score, 6) AS risk_score, {_lex('t', _STYLE)} AS style_phrases FROM ({_SCORED} (SELECT doc_id, {planted_sql('text', 'doc_id')} AS t FROM documents))")
def d10_text_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    return rounded(service.score_texts(d).select("doc_id", "score", "label", "risk_score", "style_phrases"))


@query(f"""WITH s AS ({_SCORED} (SELECT conv_id, turn, {planted_sql('text', 'conv_id * 7 + turn')} AS t FROM conversations)),
a AS (SELECT *, len(list_filter({_SENT}, lambda s: len({_lex('s')}) > 0)) AS alerts FROM s)
SELECT conv_id, count(*) AS posts_analyzed, round(avg(score), 6) AS aggregate_score, round(max(score), 6) AS peak_score, round(max(score), 6) AS risk_score, count(*) FILTER (score >= 0.5) AS flagged_posts, sum(alerts)::BIGINT AS payload_alerts,
CASE WHEN max(score) >= 0.5 THEN 'adversarial' ELSE 'human_benign' END AS label, CASE WHEN max(score) >= 0.85 THEN 'critical' WHEN max(score) >= 0.6 THEN 'high' WHEN max(score) >= 0.35 THEN 'elevated' ELSE 'low' END AS band FROM a GROUP BY 1""")
def a13_threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", planted(F.col("text"), F.col("conv_id") * 7 + F.col("turn")).alias("text"))
    return rounded(service.score_threads(service.score_texts(c), "conv_id"))


_NUM = "(conv_id * 37 % 101) / 100.0 AS evidence, (conv_id * 53 % 101) / 100.0 AS mean, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE (conv_id * 29 % 101) / 100.0 END AS auc"


@query(f"WITH s AS ({_SCORED} (SELECT conv_id, {planted_sql('text', 'conv_id * 7 + turn')} AS t FROM conversations)), a AS (SELECT conv_id, max(score) AS risk FROM s GROUP BY 1), x AS (SELECT *, {_NUM} FROM a) SELECT conv_id, round(greatest(risk, evidence, CASE WHEN auc >= 0.7 THEN mean ELSE 0 END), 6) AS headline FROM x")
def d8_headline(spark, sf_dir):
    """The strongest of text, evidence and, where it may be trusted, the graph model."""
    c = table(spark, sf_dir, "conversations").select("conv_id", planted(F.col("text"), F.col("conv_id") * 7 + F.col("turn")).alias("text"))
    a = service.score_threads(service.score_texts(c), "conv_id")
    num = lambda k: (F.col("conv_id") * k % 101) / 100.0
    return rounded(a.select("conv_id", service.headline(F.col("risk_score"), num(37), num(53), F.when(F.col("conv_id") % 3 > 0, num(29))).alias("headline")))


@query("WITH s AS (SELECT user_id, greatest(0, least(1, value / 80.0)) AS s FROM events) SELECT user_id, count(*) AS accounts, round(avg(s), 6) AS aggregate_score, count(*) FILTER (s >= 0.5) AS flagged_nodes, CASE WHEN avg(s) >= 0.5 THEN 'adversarial' ELSE 'human_benign' END AS label FROM s GROUP BY 1")
def d9_network_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 80.0).alias("score"))
    return rounded(service.network_flags(e, "user_id"))


@query("SELECT event_id, concat_ws('; ', CASE WHEN value > 80 THEN 'value is high' END, CASE WHEN event_type = 'click' THEN 'kind ' || event_type END, CASE WHEN user_id % 2 = 0 THEN 'even account' END) AS explained FROM events")
def d11_explained(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "events").select("event_id", service.explained((c("value") > 80, "value is high"), (c("event_type") == "click", F.concat(F.lit("kind "), c("event_type"))), (c("user_id") % 2 == 0, "even account")).alias("explained"))


def _any(phrases: list[str]) -> str:
    return "(" + " OR ".join("contains(lower(t), '" + p.replace("'", "''") + "')" for p in phrases) + ")"


_FED = "conv_id % 2 = 0"


@query(f"""WITH t AS (SELECT conv_id, {planted_sql('text', 'conv_id * 7 + turn')} AS t FROM conversations WHERE (conv_id + turn) % 3 = 0),
f AS (SELECT conv_id, bool_or({_any(S.PROTOCOL)}) AS protocol, bool_or({_any(S.RELAY)}) AS relay, bool_or({_any(S.SILENCING)}) AS silence, bool_or({_any(S.DIRECT)}) AS direct,
  sum(len(list_filter({_SENT}, lambda s: len({_lex('s')}) > 0))) AS alerts, (conv_id * 37 % 101) / 200.0 AS hashtag_overlap, (conv_id * 53 % 101) / 150.0 AS peak_synchrony, conv_id % 7 AS replies FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN {_FED} AND protocol THEN 'A2A/MCP Protocol Discovery Spoof' WHEN {_FED} AND (relay OR alerts > 0) THEN 'Distributed Relay Prompt Injection' WHEN {_FED} AND silence THEN 'Federation Moderation Bypass'
  WHEN {_FED} THEN 'Cross-Instance Sybil Bridge Attack' WHEN alerts > 0 OR direct THEN 'Direct Prompt Injection' WHEN hashtag_overlap >= 0.35 OR peak_synchrony >= 0.5 THEN 'Synchronized Hashtag Flood'
  WHEN replies >= 5 THEN 'Central Hub Reply-Hijack' ELSE 'Algorithmic Retweet Ring' END AS attack_profile FROM f""")
def d7_attack_profiles(spark, sf_dir):
    """All eight profiles: each conversation stands for a submission."""
    c = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 3 = 0").select("conv_id", planted(F.col("text"), F.col("conv_id") * 7 + F.col("turn")).alias("text"))
    f = c.groupBy("conv_id").agg(*(F.bool_or(x).alias(n) for n, x in S.phrase_flags(F.col("text")).items()), F.sum(F.size(X.payload_alerts(F.col("text")))).alias("alerts"))
    f = f.withColumn("hashtag_overlap", (F.col("conv_id") * 37 % 101) / 200.0).withColumn("peak_synchrony", (F.col("conv_id") * 53 % 101) / 150.0).withColumn("replies", F.col("conv_id") % 7)
    return f.select("conv_id", S.profile(F.col("conv_id") % 2 == 0, F.col("alerts")).alias("attack_profile"))


@query(f"SELECT doc_id, round(1 - exp(-0.9 * len({_lex('t')})), 6) AS score FROM (SELECT doc_id, {planted_sql('text', 'doc_id')} AS t FROM documents)")
def f4_lexical_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rounded(d.select("doc_id", X.lexical_score(planted(F.col("text"), F.col("doc_id"))).alias("score")))


@query(f"SELECT doc_id, {_lex('t')} AS phrases FROM (SELECT doc_id, {planted_sql('text', 'doc_id')} AS t FROM documents)")
def f5_matches(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.tells(planted(F.col("text"), F.col("doc_id")), X.INJECTION_TELLS).alias("phrases"))


#: Where a phrase begins: the lengths of what is between its places, added up.
_PLACES = """list_transform(range(1, len(string_split(low, p))), lambda i: list_sum(list_transform(string_split(low, p)[1:i], lambda g: length(g))) + (i - 1) * length(p))"""


@query(f"""WITH t AS (SELECT doc_id, lower({planted_sql('text', 'doc_id')}) AS low FROM documents), p AS (SELECT doc_id, low, unnest({_lex('low')}) AS p FROM t),
s AS (SELECT doc_id, p, unnest({_PLACES})::BIGINT AS pos FROM p)
SELECT t.doc_id, count(p)::INT AS n, md5(coalesce(string_agg(pos || ':' || (pos + length(p)) || ':' || p, ',' ORDER BY pos, pos + length(p), p), '')) AS spans FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id""")
def f6_match_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.match_spans(planted(F.col("text"), F.col("doc_id"))).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"], x["phrase"])), ",")).alias("spans"))


@query(rf"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?\n]*[.!?]+|[^.!?\n]+|\n') AS p FROM conversations),
i AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(p) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0), 'p': p[i]}})) AS x FROM p)
SELECT conv_id, turn, count(*) FILTER (trim(x.p, ' ') NOT IN ('', chr(10)))::INT AS n, md5(coalesce(string_agg((x.s + length(x.p) - length(ltrim(x.p, ' ')))::BIGINT || ':' || (x.s + length(x.p) - length(ltrim(x.p, ' ')) + length(trim(x.p, ' ')))::BIGINT, ',' ORDER BY x.s) FILTER (trim(x.p, ' ') NOT IN ('', chr(10))), '')) AS spans FROM i GROUP BY 1, 2""")
def f7_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.sentence_spans(F.col("text")).alias("s"))
    return d.select("conv_id", "turn", F.size("s").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")).alias("spans"))


@query(f"""WITH t AS (SELECT conv_id, turn, {planted_sql('text', 'conv_id * 7 + turn')} AS t FROM conversations), a AS (SELECT conv_id, turn, list_filter({_SENT}, lambda s: len({_lex('s')}) > 0) AS a FROM t)
SELECT conv_id, turn, len(a)::INT AS n, md5(array_to_string(list_transform(a, lambda s: s || '|' || array_to_string({_lex('s')}, '+')), ',')) AS alerts FROM a""")
def f9_alerts(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.payload_alerts(planted(F.col("text"), F.col("conv_id") * 7 + F.col("turn"))).alias("a"))
    return d.select("conv_id", "turn", F.size("a").alias("n"), F.md5(F.array_join(F.transform("a", lambda x: F.concat(x["sentence"], F.lit("|"), F.array_join(x["phrases"], "+"))), ",")).alias("alerts"))


@query()
def analyze_account(spark, sf_dir):
    """The report on a simulated account; checked by what it must say of the four known handles in tests."""
    out = service.analyze_account(spark, "swarm_bridge@rogue.social")
    return out.select("handle", "classification", "network_architecture", "attack_profile", "payload_alerts", "threat_score", "band")

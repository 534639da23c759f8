"""Queries on texts, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import dedup as D
from plumbline.operators import relational as R
from plumbline.operators.splits import balanced_split
from plumbline.queries.base import query, table
from plumbline.queries.graph import rounded

NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)(?:https?://|www\.)\S+'))::INT AS n_urls, md5(array_to_string(regexp_extract_all(html, '(?i)(?:https?://|www\.)\S+'), ' ')) AS urls FROM pages")
def f2_urls(spark, sf_dir):
    u = X.urls(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(u).alias("n_urls"), F.md5(F.array_join(u, " ")).alias("urls"))


_AFTER = r"[^\p{L}\p{N}_]"


@query(rf"""SELECT page_id, list_transform(regexp_extract_all(' ' || html, '{_AFTER}#([A-Za-z0-9_]{{1,60}})', 1), lambda x: lower(x)) AS hashtags,
list_transform(regexp_extract_all(' ' || html, '{_AFTER}@([A-Za-z0-9_]{{2,30}})', 1), lambda x: lower(x)) AS mentions FROM pages""")
def f2_tags(spark, sf_dir):
    """Hashtags and mentions; the SQL reads the sign before one instead of looking behind."""
    return table(spark, sf_dir, "pages").select("page_id", X.hashtags(F.col("html")).alias("hashtags"), X.mentions(F.col("html")).alias("mentions"))


#: The measures of a text.
MEASURES = (
    "n_chars n_words mean_word_len std_word_len n_sentences mean_sentence_len sentence_len_cv type_token_ratio function_word_ratio punct_ratio uppercase_ratio digit_ratio emoji_ratio "
    "exclaim_count question_count n_urls n_hashtags n_mentions has_newline llm_tell_count injection_tell_count imperative_start"
).split()
_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_S = r"list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s', ' ', 'g')) <> '')"
_FW = "[" + ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS) + "]"


_IN = lambda lexicon: "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in lexicon) + "]"


@query(
    rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_W.replace("(text,", "(coalesce(text, ''),")} AS w, {_S.replace("(text,", "(coalesce(text, ''),")} AS s FROM documents),
v AS (SELECT *, list_transform(w, lambda x: length(x)) AS l, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS sl FROM w),
m AS (SELECT doc_id, text, w, length(text)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_words, list_avg(l) AS mean_word_len, list_stddev_pop(l) AS std_word_len, len(s)::DOUBLE AS n_sentences, len(w) / greatest(len(s), 1) AS mean_sentence_len,
  CASE WHEN len(s) > 0 THEN list_stddev_pop(sl) / greatest(list_avg(sl), 1e-6) ELSE 0 END AS sentence_len_cv,
  len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) AS type_token_ratio, len(list_filter(w, lambda x: list_contains({_FW}, lower(x)))) / len(w) AS function_word_ratio,
  len(regexp_extract_all(text, '[.,;:!?''"()-]')) / length(text) AS punct_ratio, len(regexp_extract_all(text, '\p{{Lu}}')) / length(text) AS uppercase_ratio,
  len(regexp_extract_all(text, '\p{{Nd}}')) / length(text) AS digit_ratio, len(regexp_extract_all(text, '\p{{So}}')) / length(text) AS emoji_ratio, len(regexp_extract_all(text, '!'))::DOUBLE AS exclaim_count, len(regexp_extract_all(text, '[?]'))::DOUBLE AS question_count,
  len(regexp_extract_all(text, '(?i)(?:https?://|www\.)\S+'))::DOUBLE AS n_urls,
  len(regexp_extract_all(' ' || text, '{_AFTER}#[A-Za-z0-9_]{{1,60}}'))::DOUBLE AS n_hashtags, len(regexp_extract_all(' ' || text, '{_AFTER}@[A-Za-z0-9_]{{2,30}}'))::DOUBLE AS n_mentions, (contains(text, chr(10)))::INT::DOUBLE AS has_newline,
  len(list_filter({_IN(X.LLM_TELLS)}, lambda p: contains(lower(text), p)))::DOUBLE AS llm_tell_count, len(list_filter({_IN(X.INJECTION_TELLS)}, lambda p: contains(lower(text), p)))::DOUBLE AS injection_tell_count,
  list_contains({_IN(X.IMPERATIVES)}, lower(coalesce(w[1], '')))::INT::DOUBLE AS imperative_start FROM v)
SELECT doc_id, {", ".join(f"CASE WHEN len(w) > 0 THEN round({c}, 6) + 0.0 ELSE 0 END AS {c}" for c in MEASURES)} FROM m"""
)
def f3_stylometry(spark, sf_dir):
    """All measures of all documents, those without words too; the SQL reads the sign before a tag instead of looking behind."""
    return rounded(docs(spark, sf_dir).select("doc_id", X.stylometry(F.col("text")).alias("m")).select("doc_id", *(F.col(f"m.{c}").alias(c) for c in MEASURES)))


@query(r"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN len(a) > 1 THEN len(a) ELSE len(b) END::INT AS n, md5(array_to_string(CASE WHEN len(a) > 1 THEN a ELSE b END, '|')) AS digest FROM p""")
def f8_split_posts(spark, sf_dir):
    p = X.posts_of(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


@query(rf"""WITH t AS (SELECT doc_id, {NORM} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) END::INT AS n FROM t""")
def f10_char_ngrams(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(X.char_ngrams(F.col("text"))).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://\S+', ' ', 'g'), '[^a-z0-9_]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) >= 25 THEN t END) AS key FROM t""")
def f13_cotext(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.cotext(F.col("text"))).alias("key"))


@query()
def f1_normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.normalise(F.col("text"), most=None).alias("text"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({NORM})")
def x1_exact_dedupe(spark, sf_dir):
    return D.exact_dedupe(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id")


@query(f"""WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' ELSE 'c' END AS s, md5({NORM}) AS h FROM documents), u AS (SELECT DISTINCT s, h FROM d), n AS (SELECT s, count(*) AS n FROM u GROUP BY s)
SELECT x.s AS split_a, y.s AS split_b, coalesce(o, 0) AS overlap, round(100.0 * coalesce(o, 0) / greatest(least(x.n, y.n), 1), 6) AS pct FROM n x JOIN n y ON x.s < y.s
LEFT JOIN (SELECT p.s AS a, q.s AS b, count(*) AS o FROM u p JOIN u q ON p.h = q.h AND p.s < q.s GROUP BY 1, 2) ON a = x.s AND b = y.s""")
def x3_leakage(spark, sf_dir):
    s = F.when(F.col("doc_id") % 2 == 0, "a").when(F.col("doc_id") % 3 == 0, "b").otherwise("c")
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    return rounded(R.leakage(docs(spark, sf_dir).withColumn("split", s), "split", norm))


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, {NORM} AS t FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) END) AS g FROM t),
df AS (SELECT g, count(*) AS c FROM g GROUP BY g), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS MATERIALIZED (SELECT doc_id, g FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k, n FROM g JOIN df USING (g) JOIN n USING (doc_id)) WHERE k <= n - ceil(0.85 * n) + 1),
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id WHERE least(nx.n, ny.n) >= 0.85 * greatest(nx.n, ny.n)),
shared AS (SELECT a, b, count(*) AS o FROM cand JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2),
near AS (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS k FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE o >= 0.85 * (na.n + nb.n - o) GROUP BY b),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT near.k, CASE WHEN len(list_filter(near, lambda a: NOT list_contains(gone, a))) > 0 THEN list_append(gone, b) ELSE gone END FROM r JOIN near ON near.k = r.k + 1)
SELECT doc_id FROM documents WHERE NOT list_contains((SELECT gone FROM r ORDER BY k DESC LIMIT 1), doc_id)""")
def x2_near_dedupe(spark, sf_dir):
    """All documents in order of id, each left out if a kept one before it is near; the SQL finds all near pairs by prefixes of their rarest 5-grams."""
    return D.near_dedupe(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id")


_H = "('0x' || substr(md5('42:' || source), 1, 8))::UBIGINT / 4294967296.0"


@query(f"SELECT doc_id, source, CASE WHEN {_H} < 0.7 THEN 'train' WHEN {_H} < 0.85 THEN 'val' ELSE 'test' END AS split FROM documents")
def x4_grouped_split(spark, sf_dir):
    return D.grouped_split(docs(spark, sf_dir).select("doc_id", "source"), "source")


#: The greedy choice in SQL: groups in order, the counts of all folds carried along.
_FOLDS = "[0.70, 0.15, 0.15]::DOUBLE[]"
_COST = "list_transform(range(0, 3), lambda f: list_max(list_transform(range(1, 4), lambda j: CASE WHEN v[j] > 0 THEN (c[f * 3 + j] + v[j]) / (w[f + 1] * t[j]) ELSE -1 END)))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source || '/' || (doc_id % 37) AS grp, toxic FROM documents LEFT JOIN labels USING (doc_id)),
t AS (SELECT list_transform([count(*) FILTER (toxic = 0), count(*) FILTER (toxic = 1), count(*)], lambda x: greatest(x, 1)::DOUBLE) AS t, {_FOLDS} AS w FROM d),
g AS (SELECT grp, [count(*) FILTER (toxic = 0), count(*) FILTER (toxic = 1), count(*)]::DOUBLE[] AS v FROM d GROUP BY grp),
o AS MATERIALIZED (SELECT grp, v, t, w, row_number() OVER (ORDER BY greatest(v[1] / t[1], v[2] / t[2], v[3] / t[3]) DESC, grp) AS k FROM g, t),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS c, NULL::VARCHAR AS grp, 0::BIGINT AS f
  UNION ALL SELECT k, list_transform(range(1, 10), lambda i: c[i] + CASE WHEN (i - 1) // 3 = f THEN v[(i - 1) % 3 + 1] ELSE 0 END), grp, f
  FROM (SELECT o.k, r.c, o.v, o.grp, list_position({_COST}, list_min({_COST})) - 1 AS f FROM r JOIN o ON o.k = r.k + 1))
SELECT doc_id, d.grp, (['train', 'val', 'test'])[f + 1] AS split FROM d JOIN r USING (grp)""")
def x4_balanced_split(spark, sf_dir):
    """Whole groups of documents to folds, both classes of a label and all rows kept in balance."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    d = d.select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 37).cast("string")).alias("grp"), "toxic")
    return balanced_split(d, "grp", "toxic").select("doc_id", "grp", "split")


@query("""SELECT count(*) AS rows, sha256(array_to_string([(sum(('0x' || substr(d, 1 + 8 * 0, 8))::UBIGINT))::VARCHAR, (sum(('0x' || substr(d, 9, 8))::UBIGINT))::VARCHAR, (sum(('0x' || substr(d, 17, 8))::UBIGINT))::VARCHAR, (sum(('0x' || substr(d, 25, 8))::UBIGINT))::VARCHAR,
(sum(('0x' || substr(d, 33, 8))::UBIGINT))::VARCHAR, (sum(('0x' || substr(d, 41, 8))::UBIGINT))::VARCHAR, (sum(('0x' || substr(d, 49, 8))::UBIGINT))::VARCHAR, (sum(('0x' || substr(d, 57, 8))::UBIGINT))::VARCHAR], ':')) AS fingerprint
FROM (SELECT sha256(doc_id || chr(31) || text || chr(31) || lang) AS d FROM documents)""")
def a21_fingerprint(spark, sf_dir):
    return R.fingerprint(docs(spark, sf_dir), ["doc_id", "text", "lang"])


@query("""WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT label, n, round(1.0 / n / avg(1.0 / n) OVER (), 6) AS inverse, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced FROM c""")
def a20_class_weights(spark, sf_dir):
    return rounded(R.class_weights(table(spark, sf_dir, "labels"), "toxic"))

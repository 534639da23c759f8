"""Queries that fit models or iterate; checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features, graph_learner, models, nested, structure
from plumbline.plans import views as V
from plumbline.queries.base import query, table
from plumbline.queries.graph import rounded
from plumbline.schemas import TRANSFER
from plumbline.store import settled, stash
from plumbline.streaming.posting import co_posting_counts


def _features(spark, sf_dir):
    return settled(spark, "features", lambda: features.build_features(*V.network(spark, sf_dir), 3600))


@query()
def n9_forest(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    return models.scores(models.feature_model(f.where("split = 'train'"), TRANSFER), f).select("user_id", "split", "model_score")


@query()
def n6_tfidf(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    return models.scores(models.text_model(d.where("doc_id % 5 <> 0")), d.where("doc_id % 5 = 0")).select("doc_id", "label", "model_score")


@query(V.with_features(3600) + """, ud AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges),
h1 AS (SELECT a AS user_id, avg(in_degree) AS x, avg(burstiness) AS y FROM ud JOIN feats ON user_id = b GROUP BY 1), h2 AS (SELECT a AS user_id, avg(x) AS x, avg(y) AS y FROM ud JOIN h1 ON user_id = b GROUP BY 1)
SELECT f.user_id, round(in_degree, 6) + 0.0 AS in_degree, round(burstiness, 6) + 0.0 AS burstiness, round(coalesce(h1.x, 0), 6) + 0.0 AS in_degree_hop1, round(coalesce(h1.y, 0), 6) + 0.0 AS burstiness_hop1,
round(coalesce(h2.x, 0), 6) + 0.0 AS in_degree_hop2, round(coalesce(h2.y, 0), 6) + 0.0 AS burstiness_hop2 FROM feats f LEFT JOIN h1 USING (user_id) LEFT JOIN h2 USING (user_id)""")
def n8_propagate(spark, sf_dir):
    return rounded(_propagated(spark, sf_dir))


def _propagated(spark, sf_dir):
    return models.propagate(V.edges(spark, sf_dir), _features(spark, sf_dir).select("user_id", "in_degree", "burstiness"), ["in_degree", "burstiness"])


@query("WITH " + V.SQL_VIEWS.strip() + ", " + V.between_sql("SELECT DISTINCT relation AS net, source AS a, target AS b FROM edges WHERE source <> target", "SELECT DISTINCT relation AS net, unnest([source, target]) AS user_id FROM edges") + """
SELECT b.net AS network, b.user_id, round(d / ((n - 1) * (n - 2)), 6) + 0.0 AS betweenness FROM btw b JOIN (SELECT net, count(*) AS n FROM mem GROUP BY net) USING (net)""")
def g14_bridges(spark, sf_dir):
    """Betweenness in each relation's network; the SQL counts from all accounts, as the operator does for up to 400."""
    return rounded(structure.betweenness_by(V.edges(spark, sf_dir), "relation"))


@query("SELECT doc_id, (('0x' || substr(md5('42:' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < (SELECT avg(toxic) FROM labels WHERE doc_id % 5 <> 0))::INT AS prediction FROM labels")
def n7_random_baseline(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return models.random_baseline(d.where("doc_id % 5 <> 0"), d, "doc_id").select("doc_id", "prediction")


@query()
def n7_length_baseline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    return models.length_baseline(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0")).select("doc_id", "label", "model_score")


@query()
def d12_stacking(spark, sf_dir):
    """Two scores stacked by a balanced logistic regression, then calibrated by monotone steps."""
    s = stash(V.scored(spark, sf_dir).select("doc_id", F.col("y").cast("double").alias("label"), F.col("score").alias("graph"), ((F.col("doc_id") * 13 % 101) / 101.0).alias("text")).where("label is not null"), "stack")
    out = models.scores(models.stacked(s.where("doc_id % 5 <> 0"), ["graph", "text"]), s).withColumnRenamed("model_score", "stacked")
    return models.calibrated(out.where("doc_id % 5 <> 0"), out, "stacked", kind="isotonic").select("doc_id", "stacked", "calibrated")


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, count(*) AS posts FROM events GROUP BY 1")
def stream_co_posting(spark, sf_dir):
    return co_posting_counts(V.posts(spark, sf_dir), "1 hour").select(F.unix_timestamp("window.start").alias("start"), "posts")


_WEIGHTS = {"graph": 0.6, "text": 0.4}


def _two_scores(spark, sf_dir):
    return V.scored(spark, sf_dir).select("doc_id", "grp", F.col("y").alias("label"), F.col("score").alias("graph"), ((F.col("doc_id") * 13 % 101) / 101.0).alias("text"))


@query("WITH " + V.SQL_VIEWS.strip() + """, d AS (SELECT grp, y, score AS graph, (doc_id * 13 % 101) / 101.0::DOUBLE AS text FROM scored WHERE y IS NOT NULL AND grp IS NOT NULL),
e AS (SELECT grp, y, unnest(['graph', 'text', 'weighted']) AS kind, unnest([graph, text, (0.0::DOUBLE + graph * 0.6::DOUBLE + text * 0.4::DOUBLE) / 1.0::DOUBLE]) AS s FROM d),
k AS MATERIALIZED (SELECT o.grp AS o, kind, e.grp, y, s FROM e JOIN (SELECT DISTINCT grp FROM d) o ON o.grp <> e.grp),
pts AS (SELECT o, kind, s, count(*) FILTER (y = 1)::DOUBLE AS pos, count(*) FILTER (y = 0)::DOUBLE AS neg FROM k GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY o, kind) AS p FROM pts WINDOW w AS (PARTITION BY o, kind ORDER BY s DESC)),
f AS (SELECT o, kind, s, round(coalesce(3.25 * tp / nullif(3.25 * tp + 2.25 * (p - tp) + fp, 0), 0), 12) AS f FROM c),
b AS (SELECT o, kind, s AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY o, kind ORDER BY f DESC, s) AS i FROM f) WHERE i = 1),
g AS (SELECT o, kind, grp, any_value(threshold) AS threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn FROM k JOIN b USING (o, kind) GROUP BY 1, 2, 3),
st AS (SELECT o, kind, any_value(threshold) AS threshold, avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1, min(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0)) AS worst_recall FROM g GROUP BY 1, 2)
SELECT o, kind, round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1, round(worst_recall, 6) AS worst_recall FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(worst_recall, 12) DESC, round(macro_f1, 12) DESC, kind) AS i FROM st) WHERE i = 1""")
def d13_simple_choice(spark, sf_dir):
    """For each group left out, the kind of score and the threshold that the others choose."""
    return rounded(nested.simple_choice(_two_scores(spark, sf_dir), "grp", _WEIGHTS, key="doc_id"))


@query()
def d13_nested_selection(spark, sf_dir):
    """Every row judged by a choice among scores, their mean and a stacked model that never saw its group, with a calibrated score; a test refits each model by itself."""
    return nested.nested_selection(_two_scores(spark, sf_dir), "grp", _WEIGHTS, key="doc_id")


@query()
def n8_graph_learner(spark, sf_dir):
    """Every account's score by an aggregator over sampled neighbours that was trained on the accounts of one split; a test holds its gradients and its gain over a linear model."""
    f = _features(spark, sf_dir)
    rows = stash(graph_learner.neighbourhoods(V.edges(spark, sf_dir), f.select("user_id", *TRANSFER), TRANSFER).join(f.select("user_id", "label", "split"), "user_id"), "neighbourhoods")
    return graph_learner.scores(rows, graph_learner.train(rows.where("split = 'train'")))

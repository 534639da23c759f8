"""Queries on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.plans import views as V
from plumbline.queries.base import query
from plumbline.queries.graph import WITH, rounded

PTS = WITH + ", pts AS (SELECT grp AS g, score AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1, 2)"
PTS_ALL = WITH + ", pts AS (SELECT 'all' AS g, score AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1, 2)"
_P, _R = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_FB = "coalesce(3.25 * tp / nullif(3.25 * tp + 2.25 * fn + fp, 0), 0)"
_RATES = f"round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F1}, 6) AS f1, round({_FB}, 6) AS f_beta, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy"
_EVAL = """, w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp, sum(pos + neg) OVER (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM pts),
ev AS (SELECT g, coalesce(sum(pos) FILTER (s >= 0.5), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (s >= 0.5), 0)::DOUBLE AS fp, coalesce(sum(pos) FILTER (s < 0.5), 0)::DOUBLE AS fn, coalesce(sum(neg) FILTER (s < 0.5), 0)::DOUBLE AS tn,
  sum(pos * (below + neg / 2)) AS won, sum(pos * ctp / cn) AS ap, sum(pos * (1 - s) ** 2 + neg * s ** 2) AS sq FROM w GROUP BY g)"""
_ALL = f"""g AS "group", (tp + fp + fn + tn)::BIGINT AS n, (tp + fn)::BIGINT AS n_pos, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {_RATES},
  CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 END AS mcc, round(sq / (tp + fp + fn + tn), 6) AS brier,
  CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round(won / ((tp + fn) * (fp + tn)), 6) END AS roc_auc, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round(ap / (tp + fn), 6) END AS average_precision"""


@query(PTS_ALL + _EVAL + f"SELECT {_ALL} FROM ev")
def m2_evaluate(spark, sf_dir):
    return rounded(M.evaluate(V.scored(spark, sf_dir)))


@query(PTS + _EVAL + f"SELECT {_ALL}, (tp + fp + fn + tn) < 20 AS low_support, (tp + fn = 0 OR fp + tn = 0) AS single_class FROM ev")
def m6_per_group(spark, sf_dir):
    return rounded(M.per_group(V.scored(spark, sf_dir), "grp"))


_CAND = ", q AS (SELECT unnest(quantile_cont(score, [" + ", ".join(repr(k / 200) for k in range(201)) + "])) AS t FROM scored), cand AS (SELECT DISTINCT round(greatest(1e-9, least(1 - 1e-9, t)), 9) AS threshold FROM (SELECT t FROM q UNION ALL SELECT unnest([0.5, 0.35, 0.6, 0.82])))"
_SWEEP = f"""{_CAND}, c AS (SELECT threshold, coalesce(sum(pos) FILTER (s >= threshold), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (s >= threshold), 0)::DOUBLE AS fp,
  coalesce(sum(pos) FILTER (s < threshold), 0)::DOUBLE AS fn, coalesce(sum(neg) FILTER (s < threshold), 0)::DOUBLE AS tn FROM cand, pts GROUP BY 1),
sw AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {_RATES}, round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate FROM c)"""
_SWEEP_COLS = "threshold, tp, fp, fn, tn, precision, recall, f1, f_beta, accuracy, alert_rate"


@query(PTS_ALL + _CAND + "SELECT threshold FROM cand")
def m3_grid(spark, sf_dir):
    return M.candidates(V.scored(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold")).distinct()


def _swept(spark, sf_dir):
    s = V.scored(spark, sf_dir)
    return rounded(M.sweep(s, M.candidates(s).select(F.round("threshold", 9).alias("threshold")).distinct()), 9)


@query(PTS_ALL + _SWEEP + f"SELECT {_SWEEP_COLS} FROM sw")
def m4_sweep(spark, sf_dir):
    d = _swept(spark, sf_dir)
    return d.select(*(F.round(c, 6).alias(c) if c not in ("threshold", "tp", "fp", "fn", "tn") else F.col(c) for c in d.columns))


@query(PTS_ALL + _SWEEP + f"SELECT {_SWEEP_COLS} FROM sw ORDER BY recall >= 0.0 DESC, f_beta DESC, threshold LIMIT 1")
def m5_tuned(spark, sf_dir):
    return M.tune(m4_sweep(spark, sf_dir), "f_beta")


@query(PTS + _EVAL + f""", m AS (SELECT avg({_F1}) AS macro_f1, avg({_R}) AS macro_recall, min({_R}) AS worst_recall, (arg_min(g, ({_R}, g))) AS worst_group, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM ev)
SELECT round({_F1}, 6) AS micro_f1, round({_R}, 6) AS micro_recall, round(macro_f1, 6) AS macro_f1, round(macro_recall, 6) AS macro_recall, worst_group, round(worst_recall, 6) AS worst_recall FROM m""")
def m10_micro_macro(spark, sf_dir):
    return rounded(M.micro_macro(V.scored(spark, sf_dir), "grp"))


@query(PTS + _EVAL + f"SELECT g AS name, round({_F1}, 6) AS f1, round({_F1} - max({_F1}) OVER (), 6) + 0.0 AS delta_f1 FROM ev")
def m8_compare(spark, sf_dir):
    return rounded(M.compare(M.evaluate(V.scored(spark, sf_dir), group="grp").select(F.col("group").alias("name"), "f1")))


@query(WITH + "SELECT y AS actual, (score >= 0.5)::INT AS predicted, count(*) AS n FROM scored GROUP BY CUBE (1, 2)")
def m9_confusion(spark, sf_dir):
    return M.confusion(V.scored(spark, sf_dir))


@query(PTS_ALL + "SELECT round(s, 6) AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round(sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w), 6) AS precision FROM pts WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)")
def m11_roc(spark, sf_dir):
    return rounded(M.roc_points(V.scored(spark, sf_dir)))


@query(WITH + "SELECT y, least(floor(score * 50)::BIGINT, 49) AS bin, count(*) AS n, round(count(*) * 50.0 / sum(count(*)) OVER (PARTITION BY y), 6) AS density FROM scored GROUP BY 1, 2")
def m12_histogram(spark, sf_dir):
    return rounded(M.histogram(V.scored(spark, sf_dir)))


@query(WITH + """, b AS (SELECT CASE WHEN score >= 0.82 THEN 'escalate' WHEN score >= 0.6 THEN 'investigate' WHEN score >= 0.35 THEN 'monitor' ELSE 'clear' END AS band, y, score FROM scored)
SELECT n.band, count(y) AS accounts, coalesce(sum(y), 0)::BIGINT AS positives, round(sum(y) / nullif(count(y), 0), 6) AS precision, round(avg(score), 6) AS mean_score, round(coalesce(sum(y), 0) / sum(coalesce(sum(y), 0)) OVER (), 6) AS share_of_positives
FROM (SELECT unnest(['clear', 'monitor', 'investigate', 'escalate']) AS band) n LEFT JOIN b USING (band) GROUP BY n.band""")
def m15_bands(spark, sf_dir):
    return rounded(M.band_table(V.scored(spark, sf_dir)))


@query()
def m7_bootstrap(spark, sf_dir):
    return M.bootstrap(V.scored(spark, sf_dir))


_DRAW = "(" + " + ".join(f"CASE WHEN u >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in M._STEPS) + ")"
_FOLDED = ", ".join(f"{n} := {c}" for n, c in (
    ("accuracy", "(tp + tn) / nullif(tp + fp + fn + tn, 0)"), ("precision", _P), ("recall", _R), ("f1", _F1), ("f_beta", _FB),
    ("mcc", "CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) END"), ("brier", "sq / (tp + fp + fn + tn)"),
    ("roc_auc", "CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN won / ((tp + fn) * (fp + tn)) END"), ("average_precision", "CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN ap / (tp + fn) END"),
))
_ROUNDS = 60


@query(WITH + f""", cell AS (SELECT score AS s, y, count(*) AS c FROM scored GROUP BY 1, 2), b AS (SELECT s, sum(sum(c)) OVER (ORDER BY s) - sum(c) AS before FROM cell GROUP BY s),
rows AS (SELECT r, s, y, unnest(range(0, c)) AS i, before, c FROM cell JOIN b USING (s), (SELECT unnest(range(0, {_ROUNDS})) AS r)),
drawn AS (SELECT r, s, y, ('0x' || substr(md5('42:all:' || before::BIGINT || ':' || y || ':' || r || ':' || (i // 4)), 1 + 8 * (i % 4), 8))::UBIGINT / 4294967296.0 AS u FROM rows),
pts AS (SELECT r AS g, s, coalesce(sum({_DRAW}) FILTER (y = 1), 0) AS pos, coalesce(sum({_DRAW}) FILTER (y = 0), 0) AS neg FROM drawn GROUP BY 1, 2 HAVING sum({_DRAW}) > 0
  UNION ALL SELECT -1, s, coalesce(sum(c) FILTER (y = 1), 0), coalesce(sum(c) FILTER (y = 0), 0) FROM cell GROUP BY s){_EVAL},
m AS (UNPIVOT (SELECT g, unnest(struct_pack({_FOLDED})) FROM ev) ON {", ".join(M.METRICS)} INTO NAME metric VALUE value)
SELECT 'all' AS "group", metric, round(any_value(value) FILTER (g < 0), 6) + 0.0 AS value, round(quantile_cont(value, 0.025) FILTER (g >= 0), 6) + 0.0 AS low, round(quantile_cont(value, 0.975) FILTER (g >= 0), 6) + 0.0 AS high, count(value) FILTER (g >= 0) AS defined FROM m GROUP BY metric""")
def m7_intervals(spark, sf_dir):
    """All metrics with their bootstrap intervals; the draws are hashes, so SQL draws the same."""
    return rounded(M.intervals(V.scored(spark, sf_dir), rounds=_ROUNDS))

"""Threshold-aware metrics of scored rows (y, score), whole or by group.

Scores are folded to one row of counts for each group and distinct score
before anything is ordered, so ties are treated as one point; counts up to a
score are summed in ranges of scores.  Undefined values are null.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.spans import let
from plumbline.operators.relational import quantiles, running

BETA2 = 1.5 * 1.5
LOW_SUPPORT = 20
CUTS = (0.35, 0.60, 0.82)


def prepared(df: DataFrame, y: str = "y", score: str = "score", group: str | None = None) -> DataFrame:
    """(g, y 0/1, s): rows without a label dropped, a missing score counted as 0."""
    s = F.coalesce(F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double")), F.lit(0.0))
    g = F.col(group).cast("string") if group else F.lit("all")
    return df.where(F.col(y).isNotNull()).select(g.alias("g"), (F.col(y) > 0.5).cast("int").alias("y"), s.alias("s"))


def points(p: DataFrame) -> DataFrame:
    """(g, s, pos, neg) with one row for each distinct score."""
    return p.groupBy("g", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, F-beta (0 with an empty denominator), accuracy and MCC (null if undefined)."""
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = z(tp, tp + fp), z(tp, tp + fn)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": z(2 * p * r, p + r),
        "f_beta": z((1 + BETA2) * p * r, BETA2 * p + r), "mcc": F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, root),
    }


def evaluate(df: DataFrame, y: str = "y", score: str = "score", group: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a group: counts at the threshold, rates, Brier score, ROC AUC and average precision.

    Where all scores are 0 or 1 the last three are null; with one class AUC, average precision and MCC are.
    """
    return _evaluated(points(prepared(df, y, score, group)), ["g"], threshold).withColumnRenamed("g", "group")


def _evaluated(pts: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """The same of points (by, s, pos, neg)."""
    d = running(pts, by, ["s"], ["pos", "neg"])
    total = d.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    d = d.join(total, by).withColumn("below", F.col("before_neg")).withColumn("tp", F.col("P") - F.col("before_pos")).withColumn("n", F.col("tp") + F.col("N") - F.col("before_neg"))
    hit = F.col("s") >= threshold
    a = d.groupBy(*by).agg(
        *(F.coalesce(F.sum(F.when(c, F.col(k))), F.lit(0)).alias(n) for n, c, k in (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tn", ~hit, "neg"))),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"), F.sum(F.col("pos") * F.col("tp") / F.col("n")).alias("ap"),
        F.sum(F.col("pos") * (1 - F.col("s")) * (1 - F.col("s")) + F.col("neg") * F.col("s") * F.col("s")).alias("sq"),
        (~F.bool_and(F.col("s").isin(0.0, 1.0))).alias("graded"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = tp + fn, fp + tn
    two = (pos > 0) & (neg > 0)
    x = rates(tp, fp, fn, tn)
    x["mcc"] = F.when(two, F.coalesce(x["mcc"], F.lit(0.0)))
    return a.select(
        *by, (pos + neg).alias("n"), pos.alias("n_pos"), "tp", "fp", "fn", "tn", *(c.alias(n) for n, c in x.items()),
        F.when(F.col("graded"), F.col("sq") / (pos + neg)).alias("brier"), F.when(F.col("graded") & two, F.col("won") / (pos * neg)).alias("roc_auc"),
        F.when(F.col("graded") & two, F.col("ap") / pos).alias("average_precision"),
    )


def id_audit(df: DataFrame, key: str = "user_id", label: str = "label", far: float = 0.1) -> DataFrame:
    """One row (n, auc, leaks): how well an account's number alone tells its label, as the area under its curve; so far from one half means the numbers leak it.

    Keys that aren't whole numbers are left out; auc is null with one class.
    """
    number = F.expr(f"try_cast(`{key}` AS decimal(38,0))") if dict(df.dtypes)[key] == "string" else F.col(key).cast("decimal(38,0)")
    p = df.where(F.col(label).isNotNull()).select(F.lit("all").alias("g"), (F.col(label) > 0.5).cast("int").alias("y"), number.alias("s")).where("s IS NOT NULL")
    d = running(points(p), [], ["s"], ["neg"])
    a = d.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("won"))
    auc = F.try_divide("won", F.col("P") * F.col("N"))
    return a.select(F.coalesce(F.col("P") + F.col("N"), F.lit(0)).alias("n"), auc.alias("auc"), F.coalesce(F.abs(auc - 0.5) >= far, F.lit(False)).alias("leaks"))


def candidates(df: DataFrame, score: str = "score", steps: int = 201) -> DataFrame:
    """(threshold): score quantiles, 0.5 and the band cuts, distinct, inside (0, 1)."""
    p = df.select(F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    q = quantiles(p, "s", [k / (steps - 1) for k in range(steps)])
    t = q.select(F.explode(F.concat(F.coalesce("q", F.array().cast("array<double>")), F.array(*map(F.lit, (0.5, *CUTS))))).alias("t"))
    return t.select(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("t"))).alias("threshold")).distinct()


def sweep(df: DataFrame, thresholds: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Counts and rates at each threshold.

    Thresholds are merged into the distinct scores and one running sum serves
    all: rows are never paired with thresholds.
    """
    d = points(prepared(df, y, score)).select("s", "pos", "neg", F.lit(1).alias("k"))
    t = thresholds.select(F.col("threshold").alias("s"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), F.lit(0).alias("k")).distinct()
    run = running(d.unionByName(t), [], ["s", "k"], ["pos", "neg"]).where("k = 0")
    all_ = d.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    j = run.join(F.broadcast(all_)).withColumn("tp", F.col("P") - F.col("before_pos")).withColumn("fp", F.col("N") - F.col("before_neg"))  # one row
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    x = rates(tp, fp, fn, tn)
    return j.select(F.col("s").alias("threshold"), "tp", "fp", fn.alias("fn"), tn.alias("tn"), *(x[n].alias(n) for n in ("precision", "recall", "f1", "f_beta", "accuracy")), F.try_divide(tp + fp, F.col("P") + F.col("N")).alias("alert_rate"))


def tune(swept: DataFrame, metric: str = "f1", min_precision: float | None = None) -> DataFrame:
    """The row with the best metric, the lowest threshold among equals; a floor of precision that no row meets is ignored."""
    out = swept
    if min_precision is not None:
        ok = F.col("precision") >= min_precision
        out = out.withColumn("_any", F.max(ok).over(Window.partitionBy(F.lit(0)))).where(ok | ~F.col("_any")).drop("_any")
    return out.orderBy(F.desc(F.round(metric, 12)), "threshold").limit(1)


def per_group(df: DataFrame, group: str, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Metrics by group, with low_support (under 20 rows) and single_class; well supported and weakest first."""
    e = evaluate(df, y, score, group, threshold)
    e = e.withColumn("low_support", F.col("n") < LOW_SUPPORT).withColumn("single_class", (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n")))
    return e.orderBy("low_support", "f1", F.desc("n"))


def micro_macro(df: DataFrame, group: str, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: pooled F1 and recall, their means over groups, and the group with the lowest recall."""
    e = evaluate(df, y, score, group, threshold)
    a = e.agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.min(F.struct("recall", "group"))["group"].alias("worst_group"), F.min("recall").alias("worst_recall"))
    x = rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return a.select(x["f1"].alias("micro_f1"), x["recall"].alias("micro_recall"), "macro_f1", "macro_recall", "worst_group", "worst_recall")


def compare(reports: DataFrame) -> DataFrame:
    """Reports (name, f1, ...) best first, with what each lacks to the best."""
    return reports.withColumn("delta_f1", F.col("f1") - F.max("f1").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("f1"), "name")


def confusion(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """(actual, predicted, n) with totals, null standing for all: a cube of two flags."""
    p = prepared(df, y, score).select(F.col("y").alias("actual"), (F.col("s") >= threshold).cast("int").alias("predicted"))
    return p.cube("actual", "predicted").agg(F.count("*").alias("n"))


def roc_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr, precision) at each distinct score."""
    d = points(prepared(df, y, score))
    all_ = d.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = running(d, [], ["s"], ["pos", "neg"]).join(F.broadcast(all_))  # one row
    j = j.withColumn("tp", F.col("P") - F.col("before_pos")).withColumn("fp", F.col("N") - F.col("before_neg"))
    return j.select(F.col("s").alias("threshold"), F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def histogram(df: DataFrame, y: str = "y", score: str = "score", bins: int = 50) -> DataFrame:
    """(y, bin, n, density): scores in equal bins of [0, 1], by class."""
    p = prepared(df, y, score)
    h = p.groupBy("y", F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return h.select("y", "bin", "n", (F.col("n") * bins / F.sum("n").over(Window.partitionBy("y"))).alias("density"))


def band_table(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(band, accounts, positives, precision, mean_score, share_of_positives) of all four bands, empty ones too."""
    from plumbline.operators.scoring import triage

    p = prepared(df, y, score)
    a = p.groupBy(triage(F.col("s"), CUTS).alias("band")).agg(F.count("*").alias("accounts"), F.sum("y").alias("positives"), F.avg("s").alias("mean_score"))
    names = df.sparkSession.createDataFrame([(b,) for b in ("clear", "monitor", "investigate", "escalate")], "band string")
    j = names.join(a, "band", "left").withColumn("accounts", F.coalesce("accounts", F.lit(0))).withColumn("positives", F.coalesce("positives", F.lit(0)))
    total = F.sum("positives").over(Window.partitionBy(F.lit(0)))  # four rows
    return j.select("band", "accounts", "positives", F.try_divide("positives", "accounts").alias("precision"), "mean_score", F.try_divide("positives", total).alias("share_of_positives"))


#: Metrics that have intervals; rows with one score and class up to which each draws its own weight.
METRICS = ["accuracy", "precision", "recall", "f1", "f_beta", "mcc", "brier", "roc_auc", "average_precision"]
OWN = 64
#: What a uniform number must reach for a Poisson(1) draw of 1, 2, ...
_STEPS = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def poisson(c: Column, name: Column) -> Column:
    """The sum of Poisson(1) draws for c rows, by md5 of a name, so that any engine draws the same; above OWN rows the normal draw of that mean and variance."""
    uniform = lambda i: F.conv(F.substr(F.md5(F.concat_ws(":", name, F.floor(i / 4).cast("string"))), (i % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    one = lambda u: sum((F.when(u >= t, 1).otherwise(0) for t in _STEPS), F.lit(0))
    each = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(c, F.lit(OWN)), F.lit(1)).cast("int")), F.lit(0), lambda a, i: a + let(uniform(i - 1), one))
    normal = F.sqrt(-2 * F.log(1 - uniform(F.lit(0)))) * F.cos(2 * math.pi * uniform(F.lit(1)))
    return F.when(c == 0, F.lit(0)).when(c <= OWN, each).otherwise(F.greatest(F.lit(0), F.round(c + F.sqrt(c.cast("double")) * normal))).cast("long")


def intervals(df: DataFrame, y: str = "y", score: str = "score", group: str | None = None, threshold: float = 0.5, rounds: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(group, metric, value, low, high, defined): every metric with the quantiles of its bootstrap replicates, and in how many it is defined.

    Rows of one score and class are one draw a replicate, so replicates are
    tables of weighted points, not of rows; they are evaluated together by one
    running sum along (group, replicate, score).
    """
    pts = points(prepared(df, y, score, group)).withColumn("n", F.col("pos") + F.col("neg"))
    cells = running(pts, ["g"], ["s"], ["n"])
    drawn = lambda k, c: poisson(F.col(c), F.concat_ws(":", F.lit(str(seed)), "g", F.col("before_n").cast("string"), F.lit(str(k)), F.col("r").cast("string")))
    reps = cells.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("g", "r", "s", drawn(1, "pos").alias("pos"), drawn(0, "neg").alias("neg")).where("pos + neg > 0")
    long = lambda d, by: d.unpivot(by, METRICS, "metric", "value")
    ends = long(_evaluated(reps, ["g", "r"], threshold).select("g", "r", *METRICS), ["g", "r"])
    ends = ends.groupBy("g", "metric").agg(F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"), F.count("value").alias("defined"))
    at = long(_evaluated(pts.drop("n"), ["g"], threshold).select("g", *METRICS), ["g"])
    return at.join(ends, ["g", "metric"], "left").select(F.col("g").alias("group"), "metric", "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.coalesce("defined", F.lit(0)).alias("defined"))


def bootstrap(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5, rounds: int = 1000, seed: int = 42, level: float = 0.95, key: str | None = None) -> DataFrame:
    """One row (f1, low, high): a Poisson bootstrap of F1.

    What F1 needs is a row's cell of the confusion table; the sum of Poisson(1)
    draws over c rows is Poisson(c), so each round draws four numbers from the
    counts, whatever the rows.
    """
    import numpy as np
    import pandas as pd

    p = prepared(df, y, score)
    hit = F.col("s") >= threshold
    cells = p.agg(*(F.count_if(c & (F.col("y") == k)).alias(n) for n, c, k in (("tp", hit, 1), ("fp", hit, 0), ("fn", ~hit, 1))))

    def draw(batches):
        for b in batches:
            for tp, fp, fn in b.itertuples(index=False):
                rng = np.random.default_rng(seed)
                t, f, m = (rng.poisson(c, rounds) for c in (tp, fp, fn))
                with np.errstate(invalid="ignore", divide="ignore"):
                    x = np.nan_to_num(2 * t / (2 * t + f + m))
                d = 2 * tp + fp + fn
                lo, hi = np.quantile(x, [(1 - level) / 2, (1 + level) / 2])
                yield pd.DataFrame({"f1": [2 * tp / d if d else 0.0], "low": [lo], "high": [hi]})

    return cells.mapInPandas(draw, "f1 double, low double, high double")

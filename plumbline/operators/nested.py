"""Nested leave-one-group-out selection among score columns, their weighted mean and a stacked logistic model.

Leaving out group o, then i, then fitting is the same as leaving out i, then o:
a model is named by the groups that it never saw.  All models are fitted
together: each Newton step is one aggregate over the rows, joined with the
models that may see them, and each model's standardising sums are all groups'
sums less those left out.  The number of jobs doesn't depend on the groups,
and what comes to the driver is a matrix of the features for each model.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import points, rates
from plumbline.operators.relational import running
from plumbline.store import stash

#: Groups at most (their pairs are models), Newton steps at most, the gain in macro F1 that the stacked model must bring.
GROUPS, STEPS, GAIN = 64, 30, 0.01


def balanced_logistic(rows: DataFrame, models: DataFrame, columns: list[str], on: list[str], penalty: float = 1.0, weigh: bool = True) -> list:
    """[(model, means, deviations, coefficients with the intercept last)] of every model over the rows (y, columns) that it is joined with on columns `on`.

    Features are standardised, classes weigh the same (if asked), and the squares of the coefficients are penalised, the intercept's not.
    """
    d = len(columns)
    seen = rows.join(F.broadcast(models), on)  # a row for each model and group: groups are bounded
    first = seen.groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *(f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()
    fits = {r["model"]: (np.array([r[f"m{i}"] for i in range(d)]), np.array([r[f"s{i}"] or 1.0 for i in range(d)]), np.zeros(d + 1), r["n"] / max(2 * r["pos"], 1), r["n"] / max(2 * (r["n"] - r["pos"]), 1)) for r in first}
    two = {r["model"] for r in first if 0 < r["pos"] < r["n"]}
    spark = rows.sparkSession
    todo = set(two)
    for _ in range(STEPS):
        if not todo:
            break
        now = spark.createDataFrame([(m, *map(float, [*fits[m][0], *fits[m][1], *fits[m][2]]), *(map(float, fits[m][3:]) if weigh else (1.0, 1.0))) for m in todo], ["model", *(f"{k}{i}" for k in "ms" for i in range(d)), *(f"b{i}" for i in range(d + 1)), "w1", "w0"])
        x = [(F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(columns)] + [F.lit(1.0)]
        z = sum((F.col(f"b{i}") * x[i] for i in range(d + 1)), F.lit(0.0))
        w = F.when(F.col("y") == 1, F.col("w1")).otherwise(F.col("w0"))
        at = seen.join(F.broadcast(now), "model").select("model", "y", *(v.alias(f"x{i}") for i, v in enumerate(x)), (1 / (1 + F.exp(-z))).alias("p"), w.alias("w"))
        sums = [F.sum(F.col("w") * (F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(d + 1)]
        sums += [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in itertools.combinations_with_replacement(range(d + 1), 2)]
        keep = penalty * np.append(np.ones(d), 0.0)
        for r in at.groupBy("model").agg(*sums).collect():
            b = fits[r["model"]][2]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + np.diag(keep) + 1e-12 * np.eye(d + 1)
            step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(d + 1)]) - keep * b)
            b += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                todo.discard(r["model"])
    return [(m, f[0], f[1], f[2] if m in two else None) for m, f in fits.items()]


def _table(spark, fits: list, d: int) -> DataFrame:
    """Fits as rows (model, c0 .. cd): coefficients of the plain features, the intercept last; a model of one class scores 0.5."""
    rows = []
    for m, mean, dev, b in fits:
        c = np.zeros(d + 1) if b is None else np.append(b[:d] / dev, b[d] - float((b[:d] / dev * mean).sum()))
        rows.append((m, *map(float, c)))
    return spark.createDataFrame(rows, ["model", *(f"c{i}" for i in range(d + 1))])


def _margin(columns: list[str]) -> Column:
    return sum((F.col(f"c{i}") * F.col(c) for i, c in enumerate(columns)), F.col(f"c{len(columns)}"))


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("\x1f", F.least(a, b), F.greatest(a, b))


def tuned(scored: DataFrame) -> DataFrame:
    """scored (o, kind, grp, y, s) to (o, kind, threshold, macro_f1, worst_recall).

    The threshold is the score of best F-beta over all rows of (o, kind), the
    lowest of equals; then F1 and recall are taken group by group.
    """
    p = scored.select(F.to_json(F.struct("o", "kind")).alias("g"), "grp", "y", "s")
    run = running(points(p), ["g"], ["s"], ["pos", "neg"])
    all_ = run.groupBy("g").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    d = run.join(all_, "g")
    tp, fp = F.col("P") - F.col("before_pos"), F.col("N") - F.col("before_neg")
    d = d.select("g", "s", F.round(rates(tp, fp, F.col("before_pos"), F.col("before_neg"))["f_beta"], 12).alias("f"))
    best = d.groupBy("g").agg(F.min(F.struct((-F.col("f")).alias("f"), "s"))["s"].alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    cells = p.join(F.broadcast(best), "g").groupBy("g", "grp").agg(F.any_value("threshold").alias("threshold"), *(F.count_if(c & (F.col("y") == y)).alias(n) for n, c, y in (("tp", hit, 1), ("fp", hit, 0), ("fn", ~hit, 1), ("tn", ~hit, 0))))
    r = rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    out = cells.groupBy("g").agg(F.any_value("threshold").alias("threshold"), F.avg(r["f1"]).alias("macro_f1"), F.min(r["recall"]).alias("worst_recall"))
    key = F.from_json("g", "o string, kind string")
    return out.select(key["o"].alias("o"), key["kind"].alias("kind"), "threshold", "macro_f1", "worst_recall")


def chosen(state: DataFrame, simple: list[str], gain: float = GAIN) -> DataFrame:
    """(o, kind, threshold, macro_f1, worst_recall) of each fold's choice: the simple kind of best worst recall, then macro F1, the first of equals; the stacked one if it gains enough and has no lower worst recall."""
    order = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(simple)), F.lit(0))
    row = F.struct("kind", "threshold", "macro_f1", "worst_recall")
    key = F.struct((-F.round("worst_recall", 12)).alias("r"), (-F.round("macro_f1", 12)).alias("m"), order.alias("i"), row.alias("x"))
    a = state.groupBy("o").agg(F.min(F.when(F.col("kind") != "stacking", key))["x"].alias("best"), F.max(F.when(F.col("kind") == "stacking", row)).alias("stack"))
    better = (F.col("stack.macro_f1") - F.col("best.macro_f1") >= gain) & (F.col("stack.worst_recall") >= F.col("best.worst_recall"))
    return a.select("o", F.when(F.coalesce(better, F.lit(False)), F.col("stack")).otherwise(F.col("best")).alias("x")).select("o", "x.*")


def simple_scores(df: DataFrame, group: str, label: str, weights: dict[str, float], key: str) -> DataFrame:
    """(key, grp, y, columns, weighted): rows with a label and a group; a missing score is 0."""
    total = sum(weights.values())
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in weights]
    d = df.where(F.col(label).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), (F.col(label) > 0.5).cast("int").alias("y"), *cols)
    return d.withColumn("weighted", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / total)


def _names(d: DataFrame) -> list[str]:
    names = sorted(r[0] for r in d.select("grp").distinct().limit(GROUPS + 1).collect())
    if len(names) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    return names


def _each(names: list[str]) -> Column:
    """A row for every group, which are bounded."""
    return F.explode(F.array(*map(F.lit, names)))


def _unseen(d: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """(o, kind, grp, y, s): every row's score of each kind for each group but its own."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in kinds)))
    return d.select("grp", "y", each.alias("x")).select("grp", "y", "x.*", _each(names).alias("o")).where("grp <> o").select("o", "kind", "grp", "y", "s")


def nested_selection(df: DataFrame, group: str, weights: dict[str, float], label: str = "label", key: str = "user_id", gain: float = GAIN, penalty: float = 1.0) -> DataFrame:
    """(key, group, y, kind, threshold, score, calibrated, predicted): every row judged by what was chosen without its group.

    weights: score columns and their weights in the mean.  For each group o the
    choice and the threshold come from scores of models that saw neither o nor
    the row's own group.  calibrated is a curve fitted to those scores of the
    stacked model, so it too never saw o; of a simple kind it is the score.
    predicted compares the score with the threshold.  Rows without a label or
    a group are left out; with one group alone nothing can be chosen, and no
    rows are returned.
    """
    simple = [*weights, "weighted"]
    d = stash(simple_scores(df, group, label, weights, key), "scores")
    names = _names(d)
    spark, columns = df.sparkSession, list(weights)
    schema = f"{key} {dict(d.dtypes)['key']}, {group} string, y int, kind string, threshold double, score double, calibrated double, predicted int"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    groups = spark.createDataFrame([(g,) for g in names], "grp string")
    left_out = {"\x1f".join(p): set(p) for p in itertools.combinations_with_replacement(names, 2)}
    may_see = spark.createDataFrame([(m, g) for m, out in left_out.items() for g in names if g not in out] or [("", "")], "model string, grp string")
    fits = _table(spark, balanced_logistic(d, may_see, columns, ["grp"], penalty), len(columns))
    # the margin of each row for each group o: of the model without o and the row's group
    both = d.withColumn("o", _each(names)).withColumn("model", _pair(F.col("grp"), F.col("o")))
    at = stash(both.join(F.broadcast(fits), "model", "left").select("key", "grp", "o", "y", F.coalesce(_margin(columns), F.lit(0.0)).alias("margin")), "margins")
    inner = at.where("grp <> o").select("o", F.lit("stacking").alias("kind"), "grp", "y", (1 / (1 + F.exp(-F.col("margin")))).alias("s"))
    picked = stash(chosen(tuned(_unseen(d, names, simple).unionByName(inner)), simple, gain), "picked")
    curves = _table(spark, balanced_logistic(at.where("grp <> o"), groups.select(F.col("grp").alias("o"), F.col("grp").alias("model")), ["margin"], ["o"], 1e-6, weigh=False), 1)
    own = at.where("grp = o").select("key", "grp", "margin").join(F.broadcast(curves.toDF("grp", "c0", "c1")), "grp", "left")
    own = own.select("key", "grp", (1 / (1 + F.exp(-F.col("margin")))).alias("stacking"), (1 / (1 + F.exp(-(F.col("c0") * F.col("margin") + F.col("c1"))))).alias("curve"))
    out = d.join(own, ["key", "grp"]).join(F.broadcast(picked.withColumnRenamed("o", "grp")), "grp")
    score = F.coalesce(*(F.when(F.col("kind") == k, F.col(k)) for k in [*simple, "stacking"]))
    cal = F.when(F.col("kind") == "stacking", F.col("curve")).otherwise(score)
    return out.select(F.col("key").alias(key), F.col("grp").alias(group), "y", "kind", "threshold", score.alias("score"), cal.alias("calibrated"), (score >= F.col("threshold")).cast("int").alias("predicted"))


def simple_choice(df: DataFrame, group: str, weights: dict[str, float], label: str = "label", key: str = "user_id") -> DataFrame:
    """(o, kind, threshold, macro_f1, worst_recall): each group's choice among the simple kinds alone."""
    d = stash(simple_scores(df, group, label, weights, key), "scores")
    simple = [*weights, "weighted"]
    return chosen(tuned(_unseen(d, _names(d) or [""], simple)), simple)

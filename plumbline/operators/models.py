"""Classifiers on features and texts, leave-one-group-out scores, calibration, neighbour propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _probability(df: DataFrame) -> DataFrame:
    return df.withColumn("model_score", vector_to_array("probability")[1])


def feature_model(train: DataFrame, columns: list[str], kind: str = "forest", label: str = "label", weight: str | None = None):
    """A fitted pipeline over feature columns: forest, logistic or boosted."""
    w = {"weightCol": weight} if weight else {}
    models = {
        "forest": lambda: RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=40, maxDepth=6, seed=42, **w),
        "logistic": lambda: LogisticRegression(labelCol=label, featuresCol="_x", maxIter=50, **w),
        "boosted": lambda: GBTClassifier(labelCol=label, featuresCol="_x", maxIter=30, seed=42, **w),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), models[kind]()]).fit(train)


def text_model(train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """Word and word-pair TF-IDF under logistic regression."""
    tok = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\s+")
    pair = NGram(n=2, inputCol="_w", outputCol="_b")
    one, two = HashingTF(inputCol="_w", outputCol="_t1", numFeatures=features), HashingTF(inputCol="_b", outputCol="_t2", numFeatures=features)
    idf = [IDF(inputCol=f"_t{k}", outputCol=f"_i{k}", minDocFreq=2) for k in (1, 2)]
    lr = LogisticRegression(labelCol=label, featuresCol="_x", maxIter=30, regParam=1e-4)
    return Pipeline(stages=[tok, pair, one, two, *idf, VectorAssembler(inputCols=["_i1", "_i2"], outputCol="_x"), lr]).fit(train)


def scores(model, df: DataFrame) -> DataFrame:
    return _probability(model.transform(df)).select(*df.columns, "model_score")


def leave_one_group_out(df: DataFrame, group: str, columns: list[str], kind: str = "logistic") -> DataFrame:
    """df with model_score from a model that never saw the row's group; groups are few, and each is one fit."""
    groups = sorted(r[0] for r in df.select(group).distinct().collect())
    parts = []
    for g in groups:
        rest = df.where(F.col(group) != g)
        test = df.where(F.col(group) == g)
        if rest.select("label").distinct().count() < 2:
            parts.append(test.withColumn("model_score", F.lit(0.5)))
        else:
            parts.append(scores(feature_model(rest, columns, kind), test))
    return reduce(lambda a, b: a.union(b), parts)


def propagate(edges: DataFrame, features: DataFrame, columns: list[str], hops: int = 2) -> DataFrame:
    """Features with the mean of neighbours' features for each hop; the aggregation step of graph learners."""
    und = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    und = und.union(und.select("b", "a")).distinct()
    out, now = features, features.select(F.col("user_id").alias("b"), *columns)
    for h in range(1, hops + 1):
        mean = und.join(now, "b").groupBy("a").agg(*(F.avg(c).alias(c) for c in columns))
        now = mean.withColumnRenamed("a", "b")
        out = out.join(mean.select(F.col("a").alias("user_id"), *(F.col(c).alias(f"{c}_hop{h}") for c in columns)), "user_id", "left")
    return out.fillna(0.0)


def stacked(train: DataFrame, columns: list[str], label: str = "label"):
    """Logistic regression over other models' scores, both classes weighing the same."""
    n = train.where(F.col(label).isNotNull()).groupBy(label).agg((1.0 / F.count("*")).alias("_w"))  # two rows
    return feature_model(train.join(F.broadcast(n), label), columns, "logistic", label, "_w")


def calibrated(fitted: DataFrame, df: DataFrame, score: str = "score", label: str = "label", kind: str = "sigmoid") -> DataFrame:
    """df with calibrated: the share of label 1 at each score, learnt from fitted by a logistic curve or monotone steps."""
    from pyspark.ml.regression import IsotonicRegression

    if kind == "sigmoid":
        model = feature_model(fitted, [score], "logistic", label)
        return scores(model, df).withColumnRenamed("model_score", "calibrated")
    x = VectorAssembler(inputCols=[score], outputCol="_x")
    model = IsotonicRegression(featuresCol="_x", labelCol=label, predictionCol="calibrated").fit(x.transform(fitted))
    return model.transform(x.transform(df)).select(*df.columns, "calibrated")


def length_baseline(train: DataFrame, df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """df with model_score from the text's length alone: what any text model must beat."""
    long = lambda d: d.withColumn("_n", F.log1p(F.char_length(F.coalesce(text, F.lit(""))).cast("double")))
    return scores(feature_model(long(train), ["_n"], "logistic", label), long(df)).drop("_n")


def random_baseline(train: DataFrame, df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """df with a drawn prediction: 1 as often as in train."""
    share = train.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0)).alias("_p"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.join(F.broadcast(share)).withColumn("prediction", (u < F.col("_p")).cast("int")).drop("_p")  # one row

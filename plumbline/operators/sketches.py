"""Sketches of a day that merge: distinct counts and quantiles over any days and groups without their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a distinct sketch's registers: an error of about 1.04 / 2**(K / 2); size of a quantile sketch: ranks off by about 1.7 / SIZE.
K, SIZE = 14, 400


def sketched(df: DataFrame, at: str, by: list[str], distinct: str, value: str) -> DataFrame:
    """(day, by, n, people, sizes): a row a day and group with the sketch of the distinct and of the values, to be stored and merged.

    Rows without a time are left out; a group all of whose values are null has null sketches.
    """
    d = df.where(F.col(at).isNotNull()).select(F.to_date(F.col(at)).alias("day"), *by, F.col(distinct).alias("_d"), F.col(value).cast("double").alias("_v"))
    return d.groupBy("day", *by).agg(F.count("*").alias("n"), F.hll_sketch_agg("_d", F.lit(K)).alias("people"), F.kll_sketch_agg_double("_v", F.lit(SIZE)).alias("sizes"))


def merged(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, n, people, q): counts, estimated distinct and quantiles of stored sketches, whatever days and finer groups they are of."""
    m = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("people").alias("_p"), F.kll_merge_agg_double("sizes").alias("_s"))
    return m.select(*by, "n", F.hll_sketch_estimate("_p").alias("people"), F.array(*(quantile(F.col("_s"), q) for q in shares)).alias("q"))


def quantile(sketch: Column, share: float) -> Column:
    """A quantile that a sketch of values holds, null for an empty one."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))

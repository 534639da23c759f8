"""Equi-joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot: there are fewer hot keys than this, whatever the table's size, so they are broadcast.
SHARE = 1000


def deal(many: DataFrame, few: DataFrame, on: list[str], spread: Column, counts: DataFrame | None = None, total: int | None = None, floor: int = 8) -> tuple[DataFrame, DataFrame]:
    """(many, few) with a column _part to join by as well: the rows of a hot key are dealt by a hash of `spread`, and few repeated for each part.

    A key of no more than `floor` rows is never hot.
    """
    counts = many.groupBy(*on).agg(F.count("*").alias("c")) if counts is None else counts
    total = many.count() if total is None else total
    least = max(total // SHARE, floor)
    hot = F.broadcast(counts.where(F.col("c") > least).select(*on, F.ceil(F.col("c") / least).cast("int").alias("_parts")))
    dealt = many.join(hot, on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), "_parts")).cast("int")).drop("_parts")
    repeated = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt, repeated


def spread_join(many: DataFrame, few: DataFrame, on: list[str], spread: Column, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """many joined with few, which has few rows for each key; hot keys are dealt to several tasks.

    counts: (on, c) of many's keys, and total of its rows, if they are known.  how: inner, left, left_semi or left_anti.
    Null keys match nothing, as in any equi-join.
    """
    dealt, repeated = deal(many, few, on, spread, counts, total)
    return dealt.join(repeated, [*on, "_part"], how).drop("_part")

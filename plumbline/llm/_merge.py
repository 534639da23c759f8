"""Sums of what all tasks send, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks, or sums of such, that are added by one.
FAN = 64


def merged(rows: DataFrame, part: str, add: Callable, schema: str) -> DataFrame:
    """rows (part, task int, ...) added to one for each part, FAN tasks at a time, so that no task reads all of them.

    add takes an iterator of a group's batches, which it needn't hold, and
    gives one batch with one row of the same schema: any order of adding must
    give the same sum.
    """
    for _ in range(2):
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy(part, "task").applyInArrow(add, schema)
    return rows.groupBy(part).applyInArrow(add, schema)

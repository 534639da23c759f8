"""Splits by whole groups that keep the labels' balance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import spread_join
from plumbline.store import stash

#: Items that one task assigns, and classes of a label.
MOST, CLASSES = 4096, 100
NONE = "\x00"


def assign(items: np.ndarray, order: np.ndarray, shares: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The fold of each item (row of counts): in order, that whose fullest count is least once the item is in it, the first of equals.

    A count's fullness is its part of the fold's share of the total; counts that the item lacks don't matter.
    """
    room = shares[:, None] * np.maximum(totals, 1)[None, :]
    have, out = np.zeros_like(room), np.zeros(len(items), np.int64)
    for i in order.tolist():
        mine = np.flatnonzero(items[i])
        f = int(np.argmin(((have[:, mine] + items[i, mine]) / room[:, mine]).max(1))) if len(mine) else 0
        have[f] += items[i]
        out[i] = f
    return out


def _greedy(totals: list[int], folds: int, shares: list[float] | None):
    """One task's items (item, v) to (item, fold)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        v, t = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1), np.array(totals, np.float64)
        weight = (v / np.maximum(t, 1)).max(1)
        own = t if shares is not None else v.sum(0)
        fold = assign(v, np.lexsort((np.arange(len(v)), -weight)), np.array(shares or [1.0 / folds] * folds), own)
        return pd.DataFrame({"bucket": pdf["bucket"], "item": pdf["item"], "fold": fold})

    return run


def balanced_split(df: DataFrame, group: str, label: str, shares: dict[str, float] | None = None, most: int = MOST) -> DataFrame:
    """df with split: whole groups to folds, in descending order of their largest part of any class, each to the fold it fills least.

    What is balanced are the rows of each class and all rows.  Up to `most`
    groups are assigned one by one.  Where there are more, those that are at
    most 1 / most of every total are dealt to buckets, by the class of which
    they have the largest part, and packed into bins of like counts, level by
    level; bins are assigned as groups are, and as each is mostly of one class
    they can still balance what large groups leave uneven.  No task sees more
    than some thousand items.

    A fold's part of a class misses its share by at most the largest item's
    part of that class, if one class's items can be told from another's; with
    groups of mixed classes it is usually much nearer.  Rows without a label
    count as rows only; those without a group are one group.
    """
    shares = shares or {"train": 0.70, "val": 0.15, "test": 0.15}
    names, parts = list(shares), [float(x) for x in shares.values()]
    classes = [r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().limit(CLASSES + 1).collect()]
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes of {label}")
    counts = F.array(*(F.count_if(F.col(label).cast("string") == c) for c in sorted(classes)), F.count("*"))
    groups = stash(df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit(NONE)).alias("item")).agg(counts.alias("v")), "groups")
    sums = groups.agg(*(F.sum(F.col("v")[i]).alias(f"t{i}") for i in range(len(classes) + 1)), F.count("*").alias("n")).first()
    totals, n = [int(sums[i] or 0) for i in range(len(classes) + 1)], sums["n"]
    parts_of = F.zip_with("v", F.array(*(F.lit(float(max(t, 1))) for t in totals)), lambda x, t: x / t)
    part, main = F.array_max(parts_of), F.array_position(parts_of, F.array_max(parts_of))
    items, levels, level = groups, [], 0
    while n > most * (len(totals) + 1):
        light = part <= 1.0 / most
        buckets = math.ceil(n / most)
        bins = max(1, most // buckets)
        dealt = items.where(light).withColumn("bucket", main * buckets + F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(buckets)))
        packed = dealt.groupBy("bucket").applyInPandas(_greedy(totals, bins, None), "bucket long, item string, fold long")
        packed = stash(packed.select("item", F.concat_ws(":", F.lit(NONE + str(level)), "bucket", "fold").alias("bin")), "bins")
        levels.append(packed)
        binned = items.join(packed, "item").groupBy(F.col("bin").alias("item")).agg(F.array(*(F.sum(F.col("v")[i]) for i in range(len(totals)))).alias("v"))
        items, before, level = stash(items.where(~light).select("item", "v").unionByName(binned), "items"), n, level + 1
        n = items.count()
        if n >= before:
            break
    last = items.withColumn("bucket", F.lit(0).cast("long")).groupBy("bucket").applyInPandas(_greedy(totals, len(parts), parts), "bucket long, item string, fold long")
    fold = stash(last.select("item", "fold"), "folds")
    for packed in reversed(levels):
        inner = packed.join(fold.withColumnRenamed("item", "bin"), "bin").select("item", "fold")
        fold = fold.join(packed.select(F.col("bin").alias("item")).distinct(), "item", "left_anti").unionByName(inner)
    named = fold.select(F.col("item").alias("_item"), F.element_at(F.array(*map(F.lit, names)), (F.col("fold") + 1).cast("int")).alias("split"))
    d = df.drop("split").withColumn("_item", F.coalesce(F.col(group).cast("string"), F.lit(NONE)))
    return spread_join(d, named, ["_item"], F.monotonically_increasing_id()).drop("_item")

"""Unique long keys for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.store import stash


def unique_rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text), no text null, every key once; and (key, name) if the given keys repeat or are null.

    In that case the rows are written once under row numbers, which a task that runs again can't change.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, distinct = d.agg(F.count("*"), F.count_distinct("key")).first()
    if rows == distinct:
        return d, None
    d = stash(d.select(F.monotonically_increasing_id().alias("key"), "text", F.col("key").alias("name")), "named")
    return d.select("key", "text"), d.select("key", "name")


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of docs' columns."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(docs: DataFrame, key: str, name: str) -> tuple[DataFrame, bool]:
    """(docs with a column of this new name that every row has for itself, whether that is a row number).

    It is the key if that is unique and never null; else the rows are written once under row numbers, as above.
    """
    rows, distinct = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if rows == distinct:
        return docs.withColumn(name, F.col(key)), False
    return stash(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), True

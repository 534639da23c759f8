"""Column helpers for texts with very many spans: every one costs time in proportion to the text and its spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded in one go, characters of a piece that is cut from; both bound what one step copies.
STRIDE, CHUNK = 256, 1024


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x being computed once however often f names it."""
    return F.transform(F.array(x), f)[0]


def running(xs: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array: op, which is associative, over zero and the numbers before it.

    Folded in strides, and then over the strides' totals, so that no growing array is copied for each element.
    """

    def folded(part: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, none, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def strides(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(v, k * STRIDE + 1, F.lit(STRIDE)))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), lambda acc, x: op(acc, x)))
        return F.flatten(F.zip_with(parts, folded(totals, F.lit(zero)), folded))

    return let(xs, lambda v: let(strides(v), whole))


def total(before: Column, after: Column) -> Column:
    return before + after


def cutter(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(start, end) is that part of the text in code points: found in short pieces, not from the text's start."""

    def cutting(pieces: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            k = F.floor(start / CHUNK).cast("int")
            n = F.floor((end - 1) / CHUNK).cast("int") - k + 1
            near = F.array_join(F.slice(pieces, k + 1, F.greatest(n, F.lit(1))), "")
            return F.when(end > start, F.substr(near, start - k * CHUNK + 1, end - start)).otherwise("")

        return use(cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), cutting)

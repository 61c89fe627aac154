"""Functions of arrays as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(sizes: Column, width: int = 512) -> Column:
    """For each integer of an array the sum of all before it. Folded in pieces of `width`, whose bases are folded first, so
    that time grows with the size, not with its square."""

    def scan(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, zero, step, lambda s: s["out"])

    def summed(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / width).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(held, p * width + 1, width))
        totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return F.when(F.size(held) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.zip_with(pieces, scan(totals, F.lit(0)), scan)))

    return let(sizes, summed)

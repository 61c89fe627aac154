"""Running sums, minima and maxima within a key, and numbers in an order, without a window over a whole key.

The order's range is cut into buckets: BUCKETS of equal width, or, where callers know how dense orders are, of a width that
they give, which saves a look at the range. Each (key, bucket) is summed up first, on the map side too; a window over a key's
buckets gives what lies before each; and a window inside each (key, bucket) does the rest. So a key with a third of all rows
is many tasks' work, as long as its orders are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the order at most.
BUCKETS = 1024

_BOTH = {
    "sum": lambda a, b: F.when(a.isNull() & b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_OF = {"sum": F.sum, "min": F.min, "max": F.max}


def running(rows: DataFrame, keys: list[str], order: str, found: dict[str, tuple[str, Column]], then: tuple[str, ...] = (), inclusive: bool = False, wholes: dict[str, tuple[str, Column]] | None = None, width: float | None = None) -> DataFrame:
    """rows with, for each name of `found`, the (sum, min or max) of a column over the rows of the same keys that come before in
    `order` (a number) and `then` (what parts equal orders) - and over the row itself if `inclusive`; null where there is none;
    and for each name of `wholes` the aggregate over all rows of the keys. Null is a key like others; rows of a null or NaN order
    come first, in one bucket; rows that are equal in order and `then` follow each other in any order."""
    wholes = wholes or {}
    number = F.col(order).cast("double")
    if width is None:
        sound = F.when(~F.isnan(number), number)
        low, high = rows.agg(F.min(sound), F.max(sound)).first()
        scale = BUCKETS / (high - low) if low is not None and high > low else 0.0
        at = F.least(F.floor((number - F.lit(low or 0.0)) * scale), F.lit(BUCKETS - 1)).cast("long")
    else:
        at = F.floor(number / width).cast("long")
    bucket = F.when(number.isNotNull() & ~F.isnan(number), at)  # null for null and NaN, and then first
    named = {**{f"_r_{n}": v for n, v in found.items()}, **{f"_w_{n}": v for n, v in wholes.items()}}
    marked = rows.select("*", F.struct(*keys).alias("_key"), F.struct(bucket.alias("n")).alias("_bucket"), *(c.alias(n) for n, (_, c) in named.items()))
    sums = marked.groupBy("_key", "_bucket").agg(*(_OF[kind](n).alias(n) for n, (kind, _) in named.items()))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    base = sums.select(
        "_key", "_bucket", *(_OF[kind](f"_r_{n}").over(before).alias(f"_b_{n}") for n, (kind, _) in found.items()), *(_OF[kind](f"_w_{n}").over(whole).alias(n) for n, (kind, _) in wholes.items())
    )
    inside = Window.partitionBy("_key", "_bucket").orderBy(F.col(order).asc_nulls_first(), *then).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = marked.drop(*(f"_w_{n}" for n in wholes)).join(base, ["_key", "_bucket"])
    made = [_BOTH[kind](F.col(f"_b_{n}"), _OF[kind](f"_r_{n}").over(inside)).alias(n) for n, (kind, _) in found.items()]
    return joined.select(*rows.columns, *made, *wholes)


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, then: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """rows with their number in the keys' order, from 0."""
    found = running(rows, keys, order, {name: ("sum", F.lit(1).cast("long"))}, then, width=width)
    return found.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

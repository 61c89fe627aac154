"""Keyed state with a bounded number of the most recent entries, and running sums that need no single window."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import cut

#: Documents remembered, and entries kept of each kind of store; fixed values.
LIMIT = 100
KEEP = {"documents": 8, "engines": 2, "ages": 16, "shells": 2}


def latest(changes: DataFrame, key: str, order: list[str], fields: list[str], limit: int = LIMIT) -> DataFrame:
    """(key, fields, at): the state after all changes, the most recent `limit` keys of it.

    A change holds key, `order` columns, and for each field a value and whether it is set (`set_<field>`): unset keeps what
    was, set to null clears. Reduced on the map side; the cap is a distributed top-k."""
    order_by = F.struct(*order)
    aggs = [F.max(F.when(F.col(f"set_{f}"), F.struct(order_by.alias("o"), F.col(f).alias("v")))).alias(f"_{f}") for f in fields]
    state = changes.groupBy(key).agg(F.max(order_by).alias("at"), *aggs)
    return state.select(key, *(F.col(f"_{f}.v").alias(f) for f in fields), "at").orderBy(F.desc("at")).limit(limit)


def inherited(state: DataFrame, field: str) -> DataFrame:
    """The field of the most recent entry that has one."""
    return state.agg(F.max_by(field, F.when(F.col(field).isNotNull(), F.col("at"))).alias(field))


def tolerant(rows: DataFrame, key: str, stored: str, limit: int = LIMIT) -> DataFrame:
    """(key, page, y, settings, extra) of stored JSON of unknown quality, in reading order, capped.

    What is no object, or has neither a place nor settings, goes; a page is 1 at least; a y that is no number is null; fields
    that are not known stay in `extra` as they are."""
    j = F.col(stored)
    page, y = F.get_json_object(j, "$.pos.page").try_cast("double"), F.get_json_object(j, "$.pos.y").try_cast("double")
    settings = F.when(F.get_json_object(j, "$.settings").startswith("{"), F.get_json_object(j, "$.settings"))
    known = rows.where((F.col(key) != "") & F.trim(j).startswith("{"))
    made = known.select("ord", key, F.greatest(F.lit(1), F.floor(page + 0.5)).cast("int").alias("page"), F.when((F.abs(y) < float("inf")) & ~F.isnan(y), y).alias("y"), settings.alias("settings"), j.alias("extra"))
    made = made.withColumn("page", F.when(F.get_json_object(F.col("extra"), "$.pos.page").isNotNull(), F.col("page")))
    return made.where("page is not null or settings is not null").orderBy("ord").limit(limit).drop("ord")


def newest(rows: DataFrame, group: str, at: list[Column], k: int) -> DataFrame:
    """The k newest rows of each group."""
    w = Window.partitionBy(group).orderBy(*at)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def current_generation(results: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Results of each key's latest generation; older ones come too late."""
    last = results.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(last, [key, generation], "left_semi")


def settle(moves: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, first, settled, n): bursts of moves; one settles when none follows within the gap."""
    return moves.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("settled"), F.count(F.lit(1)).alias("n")).drop("w")


#: Buckets of a running sum at most, so that the one window over their sums is of bounded size.
BUCKETS = 10_000


def running_offset(rows: DataFrame, order: str, size: str, width: int) -> DataFrame:
    """rows with `offset`, the sum of sizes before each in `order` (an integer). Buckets of `width` orders or more, BUCKETS of
    them at most, are summed first, their prefix sums joined back, and a window runs inside each bucket alone: no task sees
    all rows. A row without an order has no place: it is kept, its offset is null, and its size is in no other's offset; a
    null size counts as nothing. Rows of equal order follow each other in any order."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    lost = rows.where(F.col(order).isNull()).withColumn("offset", F.lit(None).cast("long"))
    if low is None:
        return lost
    width = max(width, -(-(high - low + 1) // BUCKETS))
    marked = rows.where(F.col(order).isNotNull()).withColumn("_bucket", F.floor((F.col(order) - F.lit(low)) / width))
    sums = marked.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    base = sums.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # BUCKETS rows at most
    inner = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.join(F.broadcast(base), "_bucket").withColumn("offset", (F.col("_base") + F.coalesce(F.sum(size).over(inner), F.lit(0))).cast("long"))
    return placed.drop("_bucket", "_base").unionByName(lost)


def alike(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined to right on the keys, nulls equal to nulls: left's columns, then right's that are no keys."""
    other = right.select(*(F.col(k).alias(f"_of_{k}") if k in keys else k for k in right.columns))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"_of_{k}" for k in keys))


def memoised(wanted: DataFrame, memo: DataFrame, keys: list[str], measure: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What measure gives for the wanted keys, and the memo with it: what the memo holds is taken, only the rest is measured.

    measure: (keys) -> (keys, values); keys without a result are remembered too, with nulls;
    null is a key like others."""
    asked = wanted.select(*keys).distinct()
    fresh = alike(asked, memo.select(*keys), keys, "left_anti")
    made = cut(alike(fresh, measure(fresh), keys, "left"))
    known = memo.unionByName(made)
    return alike(known, asked, keys, "left_semi"), known


def trimmed(memo: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """The memo without what is no longer of use: keys that are not among `keep`; null is a key like others."""
    return alike(memo, keep.select(*keys).distinct(), keys, "left_semi")


def listed(cached: DataFrame, known: DataFrame, order: str, note: str = "cached locally") -> DataFrame:
    """(ord, and the columns of known): entries that are cached first, with a note of their own, then all that are known."""
    both = cached.withColumn("note", F.lit(note)).withColumn("_part", F.lit(0)).unionByName(known.withColumn("_part", F.lit(1)))
    columns = [c for c in known.columns if c != order]
    return both.select(F.struct(F.col("_part").alias("part"), F.col(order).alias("n")).alias("ord"), *columns)

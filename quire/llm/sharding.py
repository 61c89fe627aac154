"""Sharding by sampled splitters.

Law: `bytes`, sizes near equal. Records have the key (hash of the text, id, tie), so equal texts are neighbours, and
splitters lie between texts: a group of equal texts stays in one shard, unless several quantiles fall into it and it is
larger than a WHOLE-th of a shard (for heavy records a GROUP-th) or RANGE_ROWS rows, and only then is it split, by id.
1. Every record is drawn into the sample with a probability proportional to its weight, half its share of the bytes and
   half its share of the rows; heavy records are drawn always. The expected sample is bounded by `sample`.
2. Weighted quantiles of the sample are the splitters of the key space; records are assigned to ranges by binary search.
3. The ranges' rows and bytes are counted. A range that holds more than `OVERFULL` times its share of either is
   subdivided at splitters drawn from inside it, again until none is left that a new splitter divides.
4. Runs of ranges form the shards, cut where the prefix sum of bytes is nearest to each quantile; a record's slot is its
   range's prefix of rows plus its rank in the range.
Records larger than a `HEAVY`-th of a shard are not cut around but placed first, the largest group of equal texts to the
emptiest shard; there are fewer of them than shards times HEAVY.

Defined results: a null text has size 1 and checksum 0 and sorts by the hash of the empty text; an empty table gives an
empty result; repeated rows, null ids and ties are told apart by their place in the scan, which a checkpoint fixes;
other columns are not read. What reaches the driver: the heavy records, whose number parameters bound, and PER_RANGE sampled
records and two totals for each range, of which there are shards * RANGES or one for every RANGE_ROWS rows, if that is more. Shuffles: one of narrow rows by range, a range being a bounded share of the rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mapped

SHARDS = 16
#: Ranges per shard at least; each range is a window partition of about rows / (shards * RANGES).
RANGES = 64
#: Rows of a range at most, roughly; more rows make more ranges.
RANGE_ROWS = 1_000_000
#: Expected sampled records per range.
PER_RANGE = 16
OVERFULL = 2.5
HEAVY = 64
#: Heavy records of equal texts stay together up to this part of a shard.
GROUP = 2
#: Groups of light records stay together up to this part of a shard, by their weight, and up to RANGE_ROWS rows.
WHOLE = 16
FIRST = -(1 << 63)

Key = tuple[int, int, int]


def splitters(sample: list[tuple[int, int, int, float]], n: int, large: float = 0.0) -> list[Key]:
    """n - 1 quantiles at most of weighted keys, moved to where their text begins unless several fall into one text that weighs
    more than `large`."""
    if not sample:
        return []
    sample = sorted(sample)
    reach = np.cumsum([s[3] for s in sample])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, n) / n)
    chosen = sorted({sample[min(int(i), len(sample) - 1)][:3] for i in at})
    held, weight = Counter(h for h, _, _ in chosen), defaultdict(float)
    for h, _, _, w in sample:
        weight[h] += w
    return sorted({k for k in chosen if held[k[0]] > 1 and weight[k[0]] > large} | {(h, FIRST, FIRST) for h in held})


def range_of(bounds: np.ndarray, h: np.ndarray, i: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (rows of three) are lower than or equal to each key."""
    low, high = np.searchsorted(bounds[:, 0], h, side="left"), np.searchsorted(bounds[:, 0], h, side="right")
    out = low.astype(np.int64)
    for k in np.unique(low[high > low]).tolist():
        rows = np.flatnonzero((low == k) & (high > low))
        own = bounds[k : high[rows[0]]]
        a, b = i[rows], t[rows]
        first, last = np.searchsorted(own[:, 1], a, side="left"), np.searchsorted(own[:, 1], a, side="right")
        n = first.copy()
        for r in np.flatnonzero(last > first).tolist():
            n[r] += np.searchsorted(own[first[r] : last[r], 2], b[r], side="right")
        out[rows] += n
    return out


def assign(keyed: DataFrame, bounds: list[Key]) -> DataFrame:
    """keyed with its range, `rng`."""
    if not bounds:
        return keyed.withColumn("rng", F.lit(0).cast("long"))
    held = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, i, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "i", "t"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_of(held, h, i, t))], names=[*batch.schema.names, "rng"])

    return mapped(keyed, run, T.StructType([*keyed.schema.fields, T.StructField("rng", T.LongType())]))


def draw(keyed: DataFrame, rows: int, size: int, n: int, seed: int) -> list[tuple[int, int, int, float]]:
    """A sample of about n records, weighted by shares of bytes and rows: keys and the weights they stand for."""
    weight = F.col("size") / F.lit(2.0 * max(size, 1)) + F.lit(0.5 / max(rows, 1))
    chance = weight * F.lit(float(n))
    luck = (F.xxhash64(F.lit(seed), "h", "i", "t") / F.lit(2.0**64)) + F.lit(0.5)
    drawn = keyed.where(luck < chance).select("h", "i", "t", F.greatest(weight, F.lit(1.0 / n)).alias("w"))
    return [(r["h"], r["i"], r["t"], r["w"]) for r in drawn.collect()]  # about n rows


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, size, text_crc32, shard, slot."""
    text = F.col(text_col)
    key = F.col(id_col).cast("long") if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(id_col)
    keyed = cut(
        docs.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
            F.coalesce(key, F.lit(-(1 << 63))).alias("i"), F.monotonically_increasing_id().alias("t"),
        )
    )
    rows, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    target = size / shards
    heavy_floor = max(target / HEAVY, 1.0)

    # heavy records: fewer than shards * HEAVY
    load = [0.0] * shards
    place: dict[int, int] = {}
    queue = [(0.0, s) for s in range(shards)]
    alike: dict[int, list] = defaultdict(list)
    for r in sorted(keyed.where(F.col("size") > heavy_floor).select("size", "h", "i", "t").collect(), key=lambda r: (r["i"], r["t"])):
        alike[r["h"]].append(r)
    together = []
    for own in alike.values():
        together += [own] if sum(r["size"] for r in own) <= target / GROUP else [[r] for r in own]
    for own in sorted(together, key=lambda own: (-sum(r["size"] for r in own), own[0]["h"], own[0]["i"], own[0]["t"])):
        filled, s = heapq.heappop(queue)
        for r in own:
            place[r["t"]] = s
        load[s] = filled + sum(r["size"] for r in own)
        heapq.heappush(queue, (load[s], s))
    light = keyed.where(F.col("size") <= heavy_floor)

    n = max(shards * RANGES, rows // RANGE_ROWS)
    large = min(1 / (shards * WHOLE), RANGE_ROWS / max(rows, 1))  # of a group, as a share of all
    bounds = splitters(draw(light, rows, size, n * PER_RANGE, 0), n, large)
    totals: dict[int, tuple[int, int]] = {}
    for seed in itertools.count(1):
        ranged = assign(light, bounds)
        totals = {r["rng"]: (r["n"], r["b"]) for r in ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
        full = [k for k, (a, b) in totals.items() if a > max(1, OVERFULL * rows / n) or b > max(heavy_floor, OVERFULL * size / n)]
        if not full:
            break
        a, b = (sum(totals[k][i] for k in full) for i in (0, 1))
        more = draw(ranged.where(F.col("rng").isin(full)), a, b, PER_RANGE * 4 * len(full), seed)
        inner = splitters(more, 4 * len(full), large / (a / rows / 2 + b / max(size, 1) / 2))
        if not set(inner) - set(bounds):
            break
        bounds = sorted({*bounds, *inner})

    # shards are runs of ranges; each takes ranges while that brings its bytes nearer to the even share
    even = [max(0.0, (target if shards else 0) - x) for x in load]
    free = sum(b for _, b in totals.values())
    scale = free / sum(even) if sum(even) else 0.0
    ends = np.cumsum([x * scale for x in even])
    of_range: dict[int, tuple[int, int]] = {}
    taken = [0] * shards
    at, s = 0.0, 0
    for k in sorted(totals):
        a, b = totals[k]
        while s < shards - 1 and at + b / 2 > ends[s]:
            s += 1
        of_range[k] = (s, taken[s])
        taken[s] += a
        at += b

    held = {k: v for k, v in of_range.items()}
    if not held:
        part = light.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    else:
        spark = docs.sparkSession
        lookup = spark.createDataFrame([(k, s, p) for k, (s, p) in held.items()], "rng long, shard int, before long")
        rank = F.row_number().over(Window.partitionBy("rng").orderBy("h", "i", "t")).cast("long") - 1
        ranked = assign(light, bounds).withColumn("rank", rank)
        part = ranked.join(F.broadcast(lookup), "rng").select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"))  # a row per range
    if not place:
        return part.withColumnRenamed("id", id_col)
    spots = []
    for t, s in sorted(place.items()):
        spots.append((t, s, taken[s]))
        taken[s] += 1
    spot = docs.sparkSession.createDataFrame(spots, "t long, shard int, slot long")
    big = keyed.where(F.col("size") > heavy_floor).join(F.broadcast(spot), "t").select("id", "size", "text_crc32", "shard", "slot")  # fewer than shards * HEAVY rows
    return part.unionByName(big).withColumnRenamed("id", id_col)

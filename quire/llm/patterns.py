"""Sequential patterns by one pass of a dense tensor recurrence.

A pattern is a tuple of 1 to 4 event types. A client supports it if events of these types follow each other, each more than 0
and at most `gap` after the one before, and all within `span`, in whole microseconds. No candidates are generated: for every
tuple of up to three types a numpy array, indexed by the types, holds the latest end of an occurrence and the start that goes
with it, and a fourth array tells which tuples of four have occurred. The latest end is enough, for the best start never moves
back while the end moves on: the start of a longer pattern's occurrence is that of the latest occurrence of its prefix, so both
limits are easiest to meet from there. Events of equal time are one batch: all read the arrays as they were before it.

How it is spread: a client's events lie in blocks of `BLOCK` microseconds; those of a block's first `span` are copies for the
block before, so that every occurrence lies whole in the block of its first event. Blocks, not clients, are shuffled and
sorted, so a client with a third of all rows is many keys. Inside a task a block falls into stretches without a pause over
`gap`; many stretches advance together, a step for each time of theirs, and their arrays are one tensor of bounded size. What a
task found of a client is one bitmap over the tuples; bitmaps are merged by client (a row a client and task at most, give or
take full tables), counted, and only counts by tuple leave that stage. Wider patterns are found by an equi-join of a
pattern's shorter forms with patterns of the same support.

Defined results: rows without client, time or type are left out; repeated rows and equal times change nothing; an empty
table gives an empty result; other columns are not read. Types are taken as they are, the empty text and names that hold
the sign `>` included. Types that too few clients have can't be part of a kept pattern and are left out first; more than
TYPES others are an error (the arrays grow with the fourth power of their number). Times with a zone are instants, times
without one are read as they stand.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import cut, mapped

SECOND = 1_000_000
#: Microseconds of a block; at least the span.
BLOCK = 3600 * SECOND
#: Types of events that enough clients have, at most.
TYPES = 16
#: Bytes of one tensor, bytes of the bitmaps that a task holds, and rows it handles together.
TENSOR_BYTES, HELD_BYTES, ROWS = 16 << 20, 16 << 20, 400_000
NEVER = np.iinfo(np.int64).min // 2


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time column; without a zone the session's zone has no part in it."""
    t = F.col(column)
    if not isinstance(rows.schema[column].dataType, TimestampNTZType):
        return F.unix_micros(t.cast("timestamp"))
    day = F.unix_date(t.cast("date")).cast("long") * 86400
    return (day + F.hour(t) * 3600 + F.minute(t) * 60) * SECOND + (F.expr(f"extract(second from `{column}`)") * SECOND).cast("long")


def click_events(clicks: DataFrame) -> DataFrame:
    """(client, at, kind): clicks with client, time and type; a click whose crc32(click_id) is divisible by 5 adds `open` a
    second before and `shut` a second after it."""
    rows = clicks.where("client_id is not null and ts is not null and kind is not null")
    at = micros(rows, "ts")
    own = F.struct(at.alias("at"), F.col("kind").alias("kind"))
    added = [F.struct((at + shift).alias("at"), F.lit(kind).alias("kind")) for kind, shift in (("open", -SECOND), ("shut", SECOND))]
    marked = F.coalesce(F.crc32(F.col("click_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select(F.col("client_id").alias("client"), F.explode(F.when(marked, F.array(own, *added)).otherwise(F.array(own))).alias("e")).select("client", "e.at", "e.kind")


def frequent_types(events: DataFrame, least: int, percent: int) -> tuple[list[str], int]:
    """Types that at least `least` clients and `percent` of the clients with events have, in order; the number of these clients."""
    seen = events.select("client", F.explode(F.array("kind", F.lit(None).cast("string"))).alias("kind")).distinct()
    counted = seen.groupBy("kind").count()  # the row without a type counts the clients
    rows = counted.orderBy(F.desc("count"), F.col("kind").asc_nulls_first()).limit(TYPES + 2).collect()
    if not rows:
        return [], 0
    kept = sorted(r["kind"] for r in rows if r["kind"] is not None and r["count"] >= least and 100 * r["count"] >= percent * rows[0]["count"])
    if len(kept) > TYPES:
        raise ValueError(f"more than {TYPES} types of events are frequent")
    return kept, rows[0]["count"]


def tuples(k: int) -> list[tuple[int, ...]]:
    """All tuples of 1 to 4 types out of k, in the order of the bitmap."""
    return [t for n in (1, 2, 3, 4) for t in itertools.product(range(k), repeat=n)]


class Stretch:
    """Arrays of n stretches side by side. end and start are indexed by stretch, last type, and the types before it in
    order; so a step writes whole rows. four: the tuples of four types that have occurred, indexed alike."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.end = [np.full((n, *[k] * m), NEVER) for m in (1, 2, 3)]
        self.start = [e.copy() for e in self.end]
        self.four = np.zeros((n, k, k, k, k), bool)

    def step(self, n: int, now: np.ndarray, who: np.ndarray, kind: np.ndarray, gap: int, span: int) -> None:
        """The first n stretches reach time `now`; events `kind` of stretches `who` happen then, all at once."""
        live = []
        for end, start in zip(self.end, self.start, strict=True):
            t = now.reshape(n, *[1] * (end.ndim - 1))
            live.append((t - end[:n] <= gap) & (t - start[:n] <= span))
        self.four[who, kind] |= self._turned(live[2])[who]
        begun = [self._turned(s[:n]).copy() for s in self.start[:2]]
        for m in (1, 0):  # longer ones first: they read what was before
            ok = self._turned(live[m])[who]
            at = now[who].reshape(-1, *[1] * (ok.ndim - 1))
            self.end[m + 1][who, kind] = np.where(ok, at, self.end[m + 1][who, kind])
            self.start[m + 1][who, kind] = np.where(ok, begun[m][who], self.start[m + 1][who, kind])
        self.end[0][who, kind] = self.start[0][who, kind] = now[who]

    @staticmethod
    def _turned(x: np.ndarray) -> np.ndarray:
        """Types in the pattern's order: the last type's axis, the first after the stretch, goes to the end."""
        return np.moveaxis(x, 1, -1)

    def found(self) -> np.ndarray:
        """A row of bits for each stretch, in the order of tuples()."""
        n = len(self.four)
        parts = [self._turned(e > NEVER).reshape(n, -1) for e in self.end]
        return np.concatenate([*parts, self._turned(self.four).reshape(n, -1)], axis=1)


def support_bits(group: np.ndarray, at: np.ndarray, kind: np.ndarray, k: int, gap: int, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by group and time: (row, bits) pairs of arrays - for some rows, one of each stretch, the tuples of the
    stretch as packed bits. Tuples of a single event are included."""
    if not len(group):
        return
    fresh = np.r_[True, (group[1:] != group[:-1]) | (at[1:] - at[:-1] > gap)]
    later = fresh | np.r_[True, at[1:] != at[:-1]]
    stretch, moment = np.cumsum(fresh) - 1, np.cumsum(later) - 1
    first_moment = moment[fresh]
    row_of, length = np.flatnonzero(fresh), np.diff(np.r_[first_moment, moment[-1] + 1])
    step = moment - first_moment[stretch]
    # one type at one time is one event
    order = np.lexsort((kind, moment))
    once = np.r_[True, (moment[order][1:] != moment[order][:-1]) | (kind[order][1:] != kind[order][:-1])]
    order = order[once]
    rank_order = np.argsort(-length, kind="stable")
    rank = np.empty_like(rank_order)
    rank[rank_order] = np.arange(len(rank_order))
    wave = max(1, TENSOR_BYTES // (k**4 + 16 * (k + k**2 + k**3)))
    times = at[later]
    by = order[np.lexsort((rank[stretch[order]], step[order], rank[stretch[order]] // wave))]
    place = rank[stretch[by]]
    edges = np.flatnonzero(np.r_[True, (place[1:] // wave != place[:-1] // wave) | (step[by][1:] != step[by][:-1]), True])
    starts = [int(e) for e in edges]
    state, base = None, -1
    for begin, end in zip(starts, starts[1:], strict=False):
        rows = by[begin:end]
        own = place[begin] // wave * wave
        if own != base:
            if state is not None:
                yield row_of[rank_order[base : base + wave]], np.packbits(state.found(), axis=1)
            base, state = own, Stretch(min(wave, len(rank_order) - own), k)
        i = int(step[rows[0]])
        who = place[begin:end] - base
        n = int(who[-1]) + 1  # stretches are sorted by length: those that have a step i come first
        now = times[first_moment[rank_order[base : base + n]] + i]
        state.step(n, now, who, kind[rows], gap, span)
    yield row_of[rank_order[base : base + wave]], np.packbits(state.found(), axis=1)


def _merged(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], bits[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.bitwise_or.reduceat(bits, first, axis=0)


def client_bits(events: DataFrame, types: list[str], gap: int, span: int) -> DataFrame:
    """(client, bits): bitmaps of the tuples that a client supports, of which a client may have several."""
    k, block = len(types), max(BLOCK, span)
    code = F.array_position(F.lit(types), F.col("kind")).cast("int") - 1
    here = F.floor(F.col("at") / block).cast("long")
    blocks = F.when(F.col("at") - here * block <= span, F.array(here, here - 1)).otherwise(F.array(here))
    rows = events.select("client", "at", code.cast("byte").alias("kind")).where("kind >= 0").select("client", F.explode(blocks).alias("block"), "at", "kind")
    rows = rows.repartition("client", "block").sortWithinPartitions("client", "block", "at")
    client_type = rows.schema["client"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind_ = None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), kind_), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["client", "bits"])
            held.clear()
            return batch

        for table in _whole(batches, span):
            kind_ = table.schema.field("client").type
            client = table.column("client").combine_chunks().dictionary_encode()
            who = np.asarray(client.indices).astype(np.int64)
            names = client.dictionary
            block_ = np.asarray(table.column("block"))
            group = np.cumsum(np.r_[True, (who[1:] != who[:-1]) | (block_[1:] != block_[:-1])])
            for row, bits in support_bits(group, np.asarray(table.column("at")), np.asarray(table.column("kind")).astype(np.int64), k, gap, span):
                keys, merged = _merged(who[row], bits)
                for name, b in zip(names.take(pa.array(keys)).to_pylist(), merged, strict=True):
                    old = held.get(name)
                    held[name] = b if old is None else old | b
                if len(held) * merged.shape[1] > HELD_BYTES:
                    yield flush()
        if held:
            yield flush()

    return mapped(rows, run, f"client {client_type}, bits binary")


def _whole(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.Table]:
    """Tables of about ROWS rows of a stream sorted by client, block and time, cut between blocks. A block of more rows is cut
    at a time, and the rows of the span before it are in both tables, so that every occurrence lies whole in one; the most
    that is held is ROWS and a span of one client."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        client, block = table.column("client"), np.asarray(table.column("block"))
        last = table.slice(table.num_rows - 1, 1)
        same = np.asarray(pc.equal(client, last.column("client")[0])) & (block == block[-1])
        begin = int(np.argmax(same))
        if begin:
            yield table.slice(0, begin)
        else:
            yield table
            at = np.asarray(table.column("at"))
            begin = int(np.searchsorted(at, at[-1] - span))
        rest = table.slice(begin)
        held, rows = rest.to_batches(), 0  # ROWS more before the next cut, so that each one moves on
    if held:
        yield pa.Table.from_batches(held)


def supports(bits: DataFrame, k: int) -> DataFrame:
    """(code, support, clients_crc) of each tuple with a supporter; code: its place in tuples(k)."""
    rows = bits.select("client", F.crc32(F.col("client").cast("string")).alias("crc"), "bits").repartition("client").sortWithinPartitions("client")
    n = k + k**2 + k**3 + k**4
    step = max(1, min(2048, TENSOR_BYTES // (4 * n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        last, open_bits, open_crc = None, None, 0

        def add(crc: np.ndarray, packed: np.ndarray) -> None:
            for begin in range(0, len(crc), step):
                own = np.unpackbits(packed[begin : begin + step], axis=1, count=n).astype(np.float32)
                support[:] += own.sum(axis=0, dtype=np.float64).astype(np.int64)
                for shift in (0, 12, 24):  # sums of 12 bits of 2048 numbers are exact in single precision
                    piece = ((crc[begin : begin + step] >> shift) & 0xFFF).astype(np.float32)
                    total[:] += (piece @ own).astype(np.int64) << shift

        for batch in batches:
            if not batch.num_rows:
                continue
            client = batch.column("client").dictionary_encode()
            who = np.asarray(client.indices)
            packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            merged = np.bitwise_or.reduceat(packed, first, axis=0)
            crc = np.asarray(batch.column("crc"))[first]
            names = client.dictionary.to_pylist()
            if open_bits is not None and names[0] == last:
                merged[0] |= open_bits
            elif open_bits is not None:
                add(np.array([open_crc]), open_bits[None])
            add(crc[:-1], merged[:-1])
            last, open_bits, open_crc = names[-1], merged[-1].copy(), int(crc[-1])
        if open_bits is not None:
            add(np.array([open_crc]), open_bits[None])
        hit = np.flatnonzero(support)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(support[hit]), pa.array(total[hit])], names=["code", "support", "clients_crc"])

    parts = mapped(rows, run, "code int, support long, clients_crc long")
    return parts.groupBy("code").agg(F.sum("support").alias("support"), F.sum("clients_crc").alias("clients_crc"))


def mine(events: DataFrame, gap: int = 300 * SECOND, span: int = 450 * SECOND, least: int = 2, percent: int = 3) -> DataFrame:
    """(types array<string>, length, support, clients_crc, n_wider, closed): patterns of 1 to 4 types that at least `least`
    clients and `percent` of the clients with events support. events: (client, at in microseconds, kind)."""
    if not 0 < gap <= span <= BLOCK:
        raise ValueError("0 < gap <= span <= BLOCK must hold")
    spark = events.sparkSession
    events = events.where("client is not null and at is not null and kind is not null")
    types, clients = frequent_types(events, least, percent)
    if not types:
        return spark.createDataFrame([], "types array<string>, length int, support long, clients_crc long, n_wider long, closed boolean")
    k = len(types)
    counted = supports(client_bits(events, types, gap, span), k)
    kept = cut(counted.where((F.col("support") >= least) & (100 * F.col("support") >= percent * clients)))
    named = kept.withColumn("types", _types(F.col("code"), types))
    return widened(named)


def _types(code: Column, types: list[str]) -> Column:
    """The types of a tuple's code."""
    k, out, base = len(types), None, 0
    names = F.lit(types)
    for n in (1, 2, 3, 4):
        own = [F.element_at(names, (F.floor((code - base) / k**p) % k + 1).cast("int")) for p in range(n - 1, -1, -1)]
        out = F.when(code < base + k**n, F.array(*own)) if out is None else out.when(code < base + k**n, F.array(*own))
        base += k**n
    return out


def widened(kept: DataFrame) -> DataFrame:
    """Kept patterns with n_wider: how many longer ones of the same support become it by deleting entries."""
    t = F.col("types")
    shorter = []
    for n in (2, 3, 4):
        for m in range(1, n):
            shorter += [F.when(F.size(t) == n, F.array(*(t[i] for i in chosen))) for chosen in itertools.combinations(range(n), m)]
    inner = kept.select("support", F.explode(F.array_distinct(F.filter(F.array(*shorter), lambda x: x.isNotNull()))).alias("types"))
    wider = inner.groupBy("types", "support").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return kept.join(wider, ["types", "support"], "left").select("types", F.size("types").alias("length"), "support", "clients_crc", n.alias("n_wider"), (n == 0).alias("closed"))


#: The rows of op11_patterns in DuckDB's SQL, chains joined one event at a time. CRC-32 is its rule over bits.
SQL = """
with recursive bytes as (select i, i::bigint as v, 0 as n from range(256) r(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, n + 1 from bytes where n < 8),
steps as (select list(v order by i) as tab from bytes where n = 8),
rows as (select client_id, ts, kind, click_id, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(click_id::varchar, ''), ''), lambda c: ascii(c)::bigint)),
  lambda s, b: xor(s >> 8, tab[1 + xor(s & 255, b)])) as state from clicks, steps where client_id is not null and ts is not null and kind is not null),
marked as (select client_id, ts, kind, click_id is not null and xor(state, 4294967295) % 5 = 0 as twice from rows),
events as (select distinct client_id, t, kind from (
  select client_id, epoch_us(ts) as t, kind from marked
  union all select client_id, epoch_us(ts) - 1000000, 'open' from marked where twice
  union all select client_id, epoch_us(ts) + 1000000, 'shut' from marked where twice)),
one as (select client_id, [kind] as p, t as s, t as e from events),
two as (select o.client_id, list_append(o.p, v.kind) as p, max(o.s) as s, v.t as e from one o join events v on o.client_id = v.client_id and v.t > o.e and v.t <= o.e + 300000000 group by 1, 2, 4),
three as (select o.client_id, list_append(o.p, v.kind) as p, max(o.s) as s, v.t as e from two o join events v on o.client_id = v.client_id and v.t > o.e and v.t <= o.e + 300000000 and v.t <= o.s + 450000000 group by 1, 2, 4),
four as (select o.client_id, list_append(o.p, v.kind) as p, max(o.s) as s, v.t as e from three o join events v on o.client_id = v.client_id and v.t > o.e and v.t <= o.e + 300000000 and v.t <= o.s + 450000000 group by 1, 2, 4),
held as (select distinct client_id, p from (select client_id, p from one union all select client_id, p from two union all select client_id, p from three union all select client_id, p from four)),
clients_ as (select client_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(client_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda s, b: xor(s >> 8, tab[1 + xor(s & 255, b)])), 4294967295) as crc
  from (select distinct client_id from events), steps),
kept as (select p, count(*) as support, sum(crc) as crc from held join clients_ using (client_id) group by p
  having count(*) >= 2 and 100 * count(*) >= 3 * (select count(*) from clients_)),
cuts as (select distinct w.p as wide, w.support, list_transform(list_filter(range(1, len(w.p) + 1), lambda i: (m.m >> (i - 1)::int) & 1 = 1), lambda i: w.p[i]) as p
  from kept w, range(1, 15) m(m) where m.m < (1 << len(w.p)::int) - 1),
wider as (select p, support, count(*) as n from cuts group by 1, 2)
select array_to_string(k.p, '>') as pattern, len(k.p)::int as length, k.support::bigint as support, k.crc::bigint as clients_crc, coalesce(w.n, 0)::bigint as n_wider, w.n is null as closed
from kept k left join wider w on k.p = w.p and k.support = w.support
"""

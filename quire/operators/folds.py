"""Folds over the sorted rows of a key, for what depends on each row before and has no form as a join or a window.

Rows are dealt out by key and sorted; a task reads them as a stream and holds the state of one key alone, never its rows. A key is
one task's work, so callers make keys small where they can: a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship


def folded(rows: DataFrame, key: str, order: list[str | Column], columns: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `fold` gives for each key's rows - the columns' values, in order - as (key, schema). Null is a key like others."""
    sides = [F.col(c) if isinstance(c, str) else c for c in order]
    plain = rows.select(F.col(key).alias("key"), *(c.alias(f"o{n}") for n, c in enumerate(sides)), *(F.col(c).alias(f"c{n}") for n, c in enumerate(columns)))
    dealt = plain.repartition("key").sortWithinPartitions("key", *(f"o{n}" for n in range(len(order))))
    kind = dealt.schema["key"].dataType.simpleString()
    names, width = [f"c{n}" for n in range(len(columns))], 20_000
    out_type = rows.sparkSession.createDataFrame([], f"key {kind}, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_type)
        state: dict = {"key": None, "at": None}  # the key's column, and the row in it where the key begins
        stream = _told(batches, names, state)
        more = next(stream, None)
        out: list[tuple] = []
        keys: list[tuple[pa.Array, int]] = []
        while more is not None:
            key, following = (state["key"], state["at"]), None

            def own(head=more) -> Iterator[tuple]:
                nonlocal following
                yield head[1]
                for row in stream:
                    if row[0]:
                        following = row
                        return
                    yield row[1]

            rest = own()
            for made in fold(rest):
                out.append(made)
                keys.append(key)
                if len(out) == width:
                    yield _batch(keys, out, arrow)
                    out, keys = [], []
            for _ in rest:  # what the fold has not asked for
                pass
            more = following
        if out:
            yield _batch(keys, out, arrow)

    return ship(dealt).mapInArrow(run, out_type).withColumnRenamed("key", key)


def _told(batches: Iterator[pa.RecordBatch], names: list[str], state: dict) -> Iterator[tuple[bool, tuple]]:
    """Rows of the named columns, with whether each begins a key; keys are compared a batch at a time, never made Python's."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key")
        fresh = _begins(keys)
        fresh[0] = last is None or last.type != keys.type or _begins(pa.concat_arrays([last, keys.slice(0, 1)]))[1]
        columns = [_values(b.column(n)) for n in names]
        rows = zip(*columns, strict=True) if columns else iter([()] * b.num_rows)
        for at, (begins, row) in enumerate(zip(fresh, rows, strict=True)):
            if begins:
                state["key"], state["at"] = keys, at
            yield begins, row
        last = keys.slice(len(keys) - 1)


def _begins(keys: pa.Array) -> list[bool]:
    """For each key whether it differs from the one before; null equals null, a struct is compared by its fields."""
    n = len(keys) - 1
    differs = np.zeros(n, bool)
    leaves = [keys]
    while leaves:
        leaf = leaves.pop()
        there = leaf.is_valid().to_numpy(zero_copy_only=False)
        differs |= there[1:] != there[:-1]
        if pa.types.is_struct(leaf.type):
            leaves += leaf.flatten()
        else:
            differs |= pc.fill_null(pc.not_equal(leaf.slice(1), leaf.slice(0, n)), False).to_numpy(zero_copy_only=False)
    return [True, *differs.tolist()]


def _values(column: pa.Array) -> list:
    """A column's values as Python's, by way of numpy where it holds numbers alone, or lists of them."""
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(kind) and (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type)) and not column.values.null_count:
        flat, ends, there = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist(), column.is_valid().to_pylist()
        return [flat[a:z] if own else None for own, a, z in zip(there, ends, ends[1:], strict=False)]
    return column.to_pylist()


def _batch(keys: list[tuple[pa.Array, int]], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    taken = []
    for _, group in groupby(keys, key=lambda k: id(k[0])):
        own = list(group)
        taken.append(own[0][0].take(pa.array([at for _, at in own], pa.int64())))
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(taken).cast(schema[0].type), *columns], schema=schema)

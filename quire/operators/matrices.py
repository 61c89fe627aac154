"""Transforms of nested groups: every drawing's product of the matrices of the groups that are open around it.

A matrix (a, b, c, d, e, f) takes (x, y) to (a x + c y + e, b x + d y + f). Products don't commute and groups nest, so a running
sum's trick does not do; but what a block of rows does to the stack of open groups can be said in short - how many it closes,
and the products of those it leaves open - and such sayings can be joined in turn. So blocks are summed up on their own, the
sums of a key are joined in order, which gives each block the stack that it begins with, and then each block is gone through on
its own: no task reads a key's rows, only its blocks' sums, of which a key has BLOCKS at most, each as long as the stack is
deep."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import cut
from .folds import folded

Matrix = tuple[float, ...]
#: Blocks of a key at most, and rows of a block that it is not worth to cut.
BLOCKS, ROWS = 10_000, 4096
#: Numbers of the order in a block at most where a key's rows lie far apart; keys whose bounds are broadcast.
MOST, FEW = 1 << 16, 1_000_000
STACK = "array<array<double>>"


def product(outer: Matrix, inner: Matrix) -> Matrix:
    """The matrix that does inner first."""
    a, b, c, d, e, f = outer
    p, q, r, s, t, u = inner
    return a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f


def opened(stack: list[Matrix], own: Matrix) -> None:
    stack.append(product(stack[-1], own) if stack else own)


def summed(rows: Iterator[tuple]) -> Iterator[tuple[int, list[Matrix]]]:
    """What a block's rows (kind, matrix) do: the groups that they close of those open before, and the products they leave."""
    closed, left = 0, []
    for kind, matrix in rows:
        if kind == "open":
            opened(left, tuple(matrix))
        elif kind == "close":
            if left:
                left.pop()
            else:
                closed += 1
    yield closed, [list(m) for m in left]


def begun(rows: Iterator[tuple]) -> Iterator[tuple[int, list[Matrix]]]:
    """The stack before each block of a key, from (block, closed, left) in order."""
    stack: list[Matrix] = []
    for block, closed, left in rows:
        yield block, [list(m) for m in stack]
        stack = stack[: max(0, len(stack) - closed)]
        base = stack[-1] if stack else None
        stack += [product(base, tuple(m)) if base else tuple(m) for m in left]


def gone_through(rows: Iterator[tuple]) -> Iterator[tuple[int, Matrix | None]]:
    """The product at each drawing of a block, whose first row holds the stack that it begins with."""
    stack: list[Matrix] = []
    for n, kind, matrix, before in rows:
        if before is not None:
            stack = [tuple(m) for m in before]
        elif kind == "open":
            opened(stack, tuple(matrix))
        elif kind == "close":
            if stack:
                stack.pop()
        elif kind == "draw":
            yield n, list(stack[-1]) if stack else None


def composed(rows: DataFrame, key: str, order: str, kind: str = "kind", matrix: str = "matrix", width: int = ROWS) -> DataFrame:
    """(key, order, total): for each row of kind `draw` the product of the matrices of the open groups around it, outermost
    first; null where none is open. Rows are `open` (with an array of six numbers), `close` or `draw`; order is an integer,
    unique in a key. A `close` with nothing open does nothing; rows of other kinds, of a null order, and an `open` whose matrix
    has a null or not six numbers, are left out."""
    six = (F.size(matrix) == 6) & F.forall(matrix, lambda x: x.isNotNull())
    sound = rows.where(F.col(order).isNotNull() & (F.col(kind).isin("close", "draw") | ((F.col(kind) == "open") & six)))
    kept = cut(sound.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.count(F.lit(1)).alias("_rows")))
    low, high, keys = kept.agg(F.min("_low"), F.max("_high"), F.count(F.lit(1))).first()
    least = width if low is None else max(width, -(-(high - low + 1) // BLOCKS))
    # as wide as `width` of the key's own rows take, for a key may have few of the numbers; no block has more than MOST numbers for that
    own_width = F.greatest(F.lit(least), F.least(F.lit(MOST), F.ceil((F.col("_high") - F.col("_low") + 1) * F.lit(float(width)) / F.col("_rows")))).cast("long")
    kept = kept.select("_key", "_low", own_width.alias("_width"))
    sound = sound.join(F.broadcast(kept) if keys <= FEW else kept, F.col(key).eqNullSafe(F.col("_key")))
    block = F.floor((F.col(order) - F.col("_low")) / F.col("_width")).cast("long")
    own = F.struct(F.col(key).alias("k"), block.alias("b"))
    plain = sound.select(own.alias("own"), F.col(order).cast("long").alias("n"), F.col(kind).alias("kind"), F.transform(matrix, lambda x: x.cast("double")).alias("matrix"))
    sums = folded(plain, "own", ["n"], ["kind", "matrix"], summed, f"closed int, left {STACK}")
    spread = sums.select(F.col("own.k").alias("k"), F.col("own.b").alias("b"), "closed", "left")
    before = cut(folded(spread, "k", ["b"], ["b", "closed", "left"], begun, f"b long, before {STACK}"))
    heads = before.select(F.struct("k", "b").alias("own"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<double>").alias("matrix"), "before")
    both = plain.withColumn("before", F.lit(None).cast(STACK)).unionByName(heads)
    found = folded(both, "own", [F.col("n").isNotNull(), "n"], ["n", "kind", "matrix", "before"], gone_through, "n long, total array<double>")
    return found.select(F.col("own.k").alias(key), F.col("n").alias(order), "total")

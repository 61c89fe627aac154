"""Rasters of pages in strips: how many cells boxes cover, and how many after a dilation by one cell to each side.

A page is never held: its raster falls into strips of `side` cells of a row, and a strip is the bits of a number. A box sets bits in
each strip that it reaches; the strip's cells are the bits of all its boxes together, a sum that Spark hashes. What touches a union
of boxes is the union of the boxes wider by one cell to each side, so both rasters come from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a strip, at most the bits of a long.
SIDE = 64


def coverage(boxes: DataFrame, keys: list[str], cell: float = 1.0, side: int = SIDE) -> DataFrame:
    """(keys, covered, dilated): the cells of each page's raster that boxes (x, y, width, height) cover, and those within one
    cell of these. A cell is covered by a box that reaches into it. Boxes without an area, or with a side that is null or not
    finite, cover nothing, and pages without a cell have no row; keys may be null. The raster has no edge."""
    if not 1 <= side <= 64:
        raise ValueError("a strip has 1 to 64 cells")
    edge = lambda at: F.floor(at / cell).cast("long")
    last = lambda at: F.ceil(at / cell).cast("long") - 1
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    finite = F.lit(True)
    for c in (x, y, w, h):
        finite &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cells = boxes.where(finite & (w > 0) & (h > 0)).select(
        F.struct(*keys).alias("page"), edge(x).alias("x0"), edge(y).alias("y0"), last(x + w).alias("x1"), last(y + h).alias("y1")
    )
    strip = lambda c: F.floor(c / side).cast("long")
    bands = cells.withColumn("band", F.explode(F.sequence(strip(F.col("y0") - 1), strip(F.col("y1") + 1))))  # so that a tall box makes no long array
    top = F.col("band") * side
    rows = bands.withColumn("row", F.explode(F.sequence(F.greatest(F.col("y0") - 1, top), F.least(F.col("y1") + 1, top + (side - 1)))))
    each = rows.withColumn("strip", F.explode(F.sequence(strip(F.col("x0") - 1), strip(F.col("x1") + 1))))
    base = F.col("strip") * side
    own = F.when(F.col("row").between(F.col("y0"), F.col("y1")), _bits(F.col("x0") - base, F.col("x1") - base, side)).otherwise(F.lit(0).cast("long"))
    bits = each.select("page", "row", "strip", own.alias("own"), _bits(F.col("x0") - 1 - base, F.col("x1") + 1 - base, side).alias("near"))
    strips = bits.groupBy("page", "row", "strip").agg(F.bit_or("own").alias("own"), F.bit_or("near").alias("near"))
    found = strips.groupBy("page").agg(F.sum(F.bit_count("own").cast("long")).alias("covered"), F.sum(F.bit_count("near").cast("long")).alias("dilated"))
    return found.select("page.*", "covered", "dilated")


def _bits(first: Column, last: Column, side: int) -> Column:
    """A number whose bits from first to last are set, as far as they lie in a strip."""
    low, high = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(side - 1)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - high + low)
    return F.when(low <= high, F.call_function("shiftleft", ones, low)).otherwise(F.lit(0).cast("long"))

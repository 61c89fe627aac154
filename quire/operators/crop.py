"""Content boxes: what is left of a page when empty lines, ruled-out lines and thin drawings are dropped.

Boxes are min and max over two filtered inputs, so the aggregation is partial on the map side and nothing but one row per
page is shuffled. Padding is a projection: changing it measures nothing again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: Drawings lower than this are rules and hairlines; a fixed value.
TALL = 32.0


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def tall_inside(width: float, height: float) -> Column:
    """Drawings that count: higher than TALL and fully on the page."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    return (h > TALL) & (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)


def union_box(keys: list[str], boxes: DataFrame) -> DataFrame:
    """The bounding box (left, top, right, bottom) of boxes by keys."""
    sound = boxes.where(finite(*(F.col(c) for c in ("x", "y", "width", "height"))))
    return sound.groupBy(*keys).agg(
        F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")
    )


def content_box(spans: DataFrame, drawings: DataFrame, patterns: list[str], width: float, height: float, keys: list[str]) -> DataFrame:
    """(keys, x, y, width, height) of each page with content; none at all without patterns."""
    if not patterns:
        return spans.select(*keys, "x", "y", "width", "height").limit(0)
    box = ["x", "y", "width", "height"]
    kept = rules.keep(spans, patterns).select(*keys, *box).unionByName(drawings.where(tall_inside(width, height)).select(*keys, *box))
    clamped = union_box(keys, kept).select(
        *keys, F.greatest("left", F.lit(0.0)).alias("l"), F.greatest("top", F.lit(0.0)).alias("t"), F.least("right", F.lit(width)).alias("r"), F.least("bottom", F.lit(height)).alias("b")
    )
    return clamped.where("l < r and t < b").select(*keys, F.col("l").alias("x"), F.col("t").alias("y"), (F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height"))


def padded(boxes: DataFrame, padding: float, width: float, height: float) -> DataFrame:
    """Boxes grown on all sides, within the page; padding that is not positive changes nothing."""
    if not (padding > 0) or padding == float("inf"):
        return boxes
    l, t = F.greatest(F.col("x") - padding, F.lit(0.0)), F.greatest(F.col("y") - padding, F.lit(0.0))  # noqa: E741
    r, b = F.least(F.col("x") + F.col("width") + padding, F.lit(width)), F.least(F.col("y") + F.col("height") + padding, F.lit(height))
    return boxes.withColumns({"x": l, "y": t, "width": r - l, "height": b - t})


def shown_y(document_y: Column, crop_top: Column) -> Column:
    return document_y - F.coalesce(crop_top, F.lit(0.0))


def document_y(shown: Column, crop_top: Column) -> Column:
    return shown + F.coalesce(crop_top, F.lit(0.0))

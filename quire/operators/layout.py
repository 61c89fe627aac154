"""Laying pages out in rows, and finding those in view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

#: Zoom limits; fixed values.
LEAST, MOST = 0.05, 12.0
#: Rows or pages of a bucket, in which a document is numbered and summed up.
ROWS = 4096


def place(pages: DataFrame, doc: str, gap: float = 14.0, padding: float = 16.0, scale: float = 1.0, columns: int = 1, first_alone: bool = False) -> DataFrame:
    """(doc, index, row, left, top, width, height): pages (doc, index, width, height) in rows of `columns`, rows as high as
    their highest page, pages centred both ways. Rows are aggregated first, and what lies above a row is a running sum in
    buckets, so no window runs over a document."""
    i = F.col("index")
    row = F.floor(i / columns) if not first_alone else F.when(i == 0, F.lit(0)).otherwise(F.floor((i - 1) / columns) + 1)
    sized = pages.select(doc, "index", row.cast("long").alias("row"), (F.col("width") * scale).alias("width"), (F.col("height") * scale).alias("height"))
    rows = sized.groupBy(doc, "row").agg(F.max("height").alias("row_height"), F.max("width").alias("widest"), (F.sum("width") + gap * (F.count(F.lit(1)) - 1)).alias("natural"))
    tops = running(rows, [doc], "row", {"above": ("sum", F.col("row_height") + gap)}, wholes={"most": ("max", F.col("widest"))}, width=ROWS)
    tops = tops.select(doc, "row", "row_height", "natural", "most", (padding + F.coalesce("above", F.lit(0.0))).alias("row_top"))
    across = Window.partitionBy(doc, "row").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("width") + gap).over(across), F.lit(0.0))
    left = padding + F.greatest(F.lit(0.0), (F.col("most") - F.col("natural")) / 2) + before
    return sized.join(tops, [doc, "row"]).select(doc, "index", "row", left.alias("left"), (F.col("row_top") + (F.col("row_height") - F.col("height")) / 2).alias("top"), "width", "height")


#: Height of a cell in which pages and views meet.
CELL = 1024.0


def _celled(frame: DataFrame, low: Column, high: Column) -> DataFrame:
    """frame with a row for each cell from low to high."""
    return frame.withColumn("cell", F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL))))


def _sides(boxes: DataFrame, doc: str) -> DataFrame:
    return boxes.select(doc, F.col("index").cast("long").alias("index"), "top", (F.col("top") + F.col("height")).alias("bottom"))


def visible(boxes: DataFrame, views: DataFrame, doc: str, overscan: float = 0.0) -> DataFrame:
    """(doc, view, first, last): pages that meet each view (doc, view, top, height), widened by overscan; where none does,
    the page nearest to its middle. Pages and views meet in cells of a fixed height, so a view meets its surroundings alone."""
    asked = views.dropDuplicates([doc, "view"]).select(
        doc, "view", (F.col("top") - overscan).alias("low"), (F.col("top") + F.col("height") + overscan).alias("high"), (F.col("top") + F.col("height") / 2).alias("middle")
    )
    b, v = _celled(_sides(boxes, doc), F.col("top"), F.col("bottom")), _celled(asked, F.col("low"), F.col("high"))
    meet = b.join(v, [doc, "cell"]).where("bottom >= low and top <= high").groupBy(doc, "view").agg(F.min("index").alias("a"), F.max("index").alias("z"))
    found = asked.join(meet, [doc, "view"], "left")
    near = nearest(boxes, found.where("a is null").select(doc, F.col("view").alias("point"), F.col("middle").alias("y")), doc).select(doc, F.col("point").alias("view"), F.col("index").alias("n"))
    out = found.join(near, [doc, "view"], "left").select(doc, "view", F.coalesce("a", "n").alias("first"), F.coalesce("z", "n").alias("last"))
    return out.where("first is not null")


def nearest(boxes: DataFrame, points: DataFrame, doc: str) -> DataFrame:
    """(doc, point, index): the page closest to each height (doc, point, y); the lower index wins ties. Pages around a point
    meet it in its cell; the next top below and the last bottom above are running minima in buckets over both."""
    sides = _sides(boxes, doc)
    asked = points.dropDuplicates([doc, "point"]).select(doc, "point", F.col("y").cast("double").alias("y"))
    inside = _celled(sides, F.col("top"), F.col("bottom")).join(asked.withColumn("cell", F.floor(F.col("y") / CELL)), [doc, "cell"]).where("top <= y and bottom >= y")
    found = inside.select(doc, "point", F.lit(0.0).alias("d"), "index")
    for side, sign in (("top", -1), ("bottom", 1)):
        ends = sides.select(doc, (F.col(side) * sign).alias("at"), F.lit(0).alias("probe"), F.struct((F.col(side) * -sign).alias("far"), "index").alias("best"))
        probes = asked.select(doc, (F.col("y") * sign).alias("at"), F.lit(1).alias("probe"), "point", "y")
        both = ends.unionByName(probes, allowMissingColumns=True)
        seen = running(both, [doc], "at", {"near": ("min", F.col("best"))}, ("probe",), inclusive=True, width=ROWS * CELL).where("probe = 1 and near is not null")
        found = found.unionByName(seen.select(doc, "point", (F.col("y") * sign + F.col("near.far")).alias("d"), F.col("near.index").alias("index")))
    return found.groupBy(doc, "point").agg(F.min(F.struct("d", "index")).alias("n")).select(doc, "point", F.col("n.index").alias("index"))


def at_offset(boxes: DataFrame, offsets: DataFrame, doc: str, padding: float = 16.0) -> DataFrame:
    """(doc, offset, index): the last page whose top is not below offset + padding, the first page before that. An as-of
    match as a running maximum in buckets over both."""
    both = boxes.select(doc, F.col("top").alias("at"), F.col("index").cast("long").alias("index"), F.lit(0).alias("probe"), F.lit(None).cast("double").alias("offset")).unionByName(
        offsets.select(doc, (F.col("offset") + padding).alias("at"), F.lit(None).cast("long").alias("index"), F.lit(1).alias("probe"), F.col("offset").cast("double").alias("offset"))
    )
    seen = running(both, [doc], "at", {"last": ("max", F.col("index"))}, ("probe",), inclusive=True, width=ROWS * CELL)
    return seen.where("probe = 1").select(doc, "offset", F.coalesce("last", F.lit(0)).alias("index"))


def fit_scale(pages: DataFrame, doc: str, width: float, height: float, padding: float = 16.0) -> DataFrame:
    """(doc, fit_width, fit_page): scales that fit the widest page, and the widest and highest page, into a view."""
    clamp = lambda x: F.least(F.lit(MOST), F.greatest(F.lit(LEAST), x))
    wide, high = F.lit(width - 2 * padding) / F.max("width"), F.lit(height - 2 * padding) / F.max("height")
    return pages.groupBy(doc).agg(clamp(wide).alias("fit_width"), clamp(F.least(wide, high)).alias("fit_page"))


def priority(index: Column, first: Column, last: Column, direction: Column) -> Column:
    """0 in view, else twice the distance, and one more behind the direction of travel."""
    away = F.greatest(first - index, index - last)
    behind = ((direction > 0) & (index < first)) | ((direction < 0) & (index > last))
    return F.when(away <= 0, 0).otherwise(away * 2 + behind.cast("int"))


def lookahead(pages: DataFrame, first: Column, last: Column, direction: Column, n: int) -> DataFrame:
    """The n pages that come into view next."""
    i = F.col("index")
    return pages.where(((direction >= 0) & (i > last) & (i <= last + n)) | ((direction < 0) & (i < first) & (i >= first - n)))


def install_next(window: DataFrame, finished: DataFrame, doc: str, moving: bool = False) -> DataFrame:
    """The finished page of each document to show next: least priority, then index; while moving, pages in view alone."""
    ready = window.join(finished, [doc, "index"], "left_semi")
    ready = ready.where("priority = 0") if moving else ready
    return ready.groupBy(doc).agg(F.min(F.struct("priority", "index")).alias("n")).select(doc, F.col("n.index").alias("index"))


def work_order(pages: DataFrame, doc: str, here: Column) -> DataFrame:
    """pages with `ord`: the current one first, then ascending. Numbered in buckets: what comes before the current one moves up."""
    marked = pages.withColumn("_here", (F.col("index") == here).cast("int"))
    found = running(marked, [doc], "index", {"_n": ("sum", F.lit(1).cast("long"))}, wholes={"_any": ("max", F.col("_here"))}, width=ROWS)
    n = F.coalesce("_n", F.lit(0))
    return found.withColumn("ord", F.when(F.col("_here") == 1, 0).when(F.col("index") < here, n + F.col("_any")).otherwise(n).cast("int")).drop("_here", "_n", "_any")


def ladder(levels: DataFrame, doc: str, close: float = 1e-3) -> DataFrame:
    """(doc, level) sorted, a level dropped that is within `close` of the one before it in the unfiltered list."""
    w = Window.partitionBy(doc).orderBy("level")
    return levels.withColumn("gap", F.col("level") - F.lag("level").over(w)).where(F.col("gap").isNull() | (F.col("gap") > close)).drop("gap")


def next_level(levels: DataFrame, now: DataFrame, doc: str) -> DataFrame:
    """(doc, level): the rung nearest to `scale`, the lower of two equally near."""
    near = levels.join(now, doc)
    return near.groupBy(doc).agg(F.min(F.struct(F.abs(F.col("level") - F.col("scale")).alias("d"), "level")).alias("n")).select(doc, F.col("n.level").alias("level"))


def retain_nearest(results: DataFrame, doc: str, centre: Column, k: int) -> DataFrame:
    """The k results nearest to a centre; of equally far ones the lower index goes first."""
    w = Window.partitionBy(doc).orderBy(F.abs(F.col("index") - centre), F.desc("index"))
    return results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

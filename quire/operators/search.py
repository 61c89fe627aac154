"""Search that ignores blanks and case, across the runs of a page but never across pages.

All of it happens inside a page's row; the only exchange is the final order and cap of the hit list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import prefix_sums

#: Hits listed at most, per page and in all; bands painted at most. Fixed values.
MAX_HITS, MAX_BANDS = 1000, 400


def normal(query: str) -> str:
    """The query as it is looked for."""
    return "".join(c.lower() for c in query if c not in " \t\n\r\f\x0b")


def joined(runs: Column) -> Column:
    """The searchable text of a page's runs."""
    return F.array_join(F.transform(runs, tx.normalise), "")


def starts(norm: Column, query: str, most: int | None = MAX_HITS) -> Column:
    """Offsets of non-overlapping occurrences, left to right, `most` at most or all; none for an empty query."""
    q = normal(query)
    if not q:
        return F.array().cast("array<int>")
    literal = "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(norm, literal, -1)
    parts = parts if most is None else F.slice(parts, 1, most + 1)
    before = prefix_sums(F.transform(parts, F.length))  # of each part but the first, a hit goes before it
    return F.transform(F.filter(before, lambda _, i: i > 0), lambda at, i: at + i * len(q))


def page_hits(runs: DataFrame, query: str, key: str = "page_id", most: int | None = MAX_HITS) -> DataFrame:
    """(key, norm, starts): the hits of each page, capped per page unless `most` is None."""
    norm = runs.select(key, joined(F.col("runs")).alias("norm"))
    return norm.withColumn("starts", starts(F.col("norm"), query, most))


def hits(runs: DataFrame, query: str, key: str = "page_id", most: int = MAX_HITS) -> DataFrame:
    """(key, start, end) by page and offset, the first `most`."""
    n = len(normal(query))
    each = page_hits(runs, query, key).select(key, F.explode("starts").alias("start"))
    return each.select(key, "start", (F.col("start") + n).alias("end")).orderBy(key, "start").limit(most)


def state(runs: DataFrame, query: str, key: str = "page_id") -> DataFrame:
    """One row: hits listed, pages, and whether the list was cut - which only a sum over capped pages can cause."""
    n = page_hits(runs, query, key).select(F.size("starts").cast("long").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("pages")).select(
        F.least("n", F.lit(MAX_HITS)).alias("listed"), "pages", (F.col("n") > MAX_HITS).alias("truncated")
    )


def run_spans(runs: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, spans): (run_no, start, end) of each run in the page's searchable text."""
    return _normal_runs(runs, key).select(key, _spans(F.col("norms")).alias("spans"))


def _normal_runs(runs: DataFrame, key: str) -> DataFrame:
    return runs.select(key, F.transform("runs", tx.normalise).alias("norms"))


def _spans(norms: Column) -> Column:
    sizes = F.transform(norms, F.length)
    both = F.zip_with(prefix_sums(sizes), sizes, lambda at, n: F.struct(at.alias("start"), (at + n).alias("end")))
    return F.transform(both, lambda s, i: F.struct(i.alias("run_no"), s["start"].alias("start"), s["end"].alias("end")))


def hit_runs(runs: DataFrame, query: str, key: str = "page_id") -> DataFrame:
    """(key, start, run_no) for every run that a hit touches, of all hits of a page; all in the page's row."""
    n = len(normal(query))
    both = _normal_runs(runs, key).select(key, _spans(F.col("norms")).alias("spans"), starts(F.array_join("norms", ""), query, None).alias("starts"))
    each = both.select(key, "spans", F.explode("starts").alias("start"))
    touched = F.filter("spans", lambda s: (s["start"] < F.col("start") + n) & (s["end"] > F.col("start")))
    return each.select(key, "start", F.explode(touched).alias("r")).select(key, "start", F.col("r.run_no").alias("run_no"))


def step(active: Column, delta: int, count: Column) -> Column:
    """The next active hit: the first or last where none is, else around the end."""
    return F.when(count == 0, -1).when(active < 0, F.lit(0) if delta > 0 else count - 1).otherwise(F.pmod(active + delta + count, count))


def paint(found: DataFrame, active: int, key: str = "page_id", most: int = MAX_BANDS) -> DataFrame:
    """The hits that are painted: the active one first, then in order."""
    return found.orderBy(F.col("n") != active, key, "start").limit(most)


def bands(boxes: Column) -> Column:
    """Boxes (x, y, w, h) of one hit merged into lines: by y and x, a box joins the last line if it is within half its
    height and no further right than 0.4 heights behind its end."""
    order = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h"))))

    def add(out: Column, b: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joins = F.coalesce((F.abs(b["y"] - last["y"]) < last["h"] * 0.5) & (b["x"] <= last["x"] + last["w"] + last["h"] * 0.4), F.lit(False))
        x, y = F.least(last["x"], b["x"]), F.least(last["y"], b["y"])
        w = F.greatest(last["x"] + last["w"], b["x"] + b["w"]) - x
        h = F.greatest(last["y"] + last["h"], b["y"] + b["h"]) - y
        merged = F.struct(y.alias("y"), x.alias("x"), w.alias("w"), h.alias("h"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(order, F.slice(order, 1, 0), add)

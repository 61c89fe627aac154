"""Queries of page layout: each source of documents is a long document, its texts are the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.workers import cut
from ..operators import layout
from ..operators.running import numbered
from ..sources.documents import table


def _pages(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return numbered(docs, ["source"], "doc_id", "index", width=1 << 20).select("source", "index", (F.lit(600.0) + F.pmod("n_chars", F.lit(3)) * 50).alias("width"), (F.lit(200.0) + F.pmod(F.col("n_chars") * 397, F.lit(1000))).alias("height"))


def _boxes(spark, d):
    return layout.place(_pages(spark, d), "source", columns=2, first_alone=True)


def _tops(boxes):
    """Views down each document, from above its first page to below its last."""
    ends = boxes.groupBy("source").agg((F.floor(F.max(F.col("top") + F.col("height"))) + 1000).cast("int").alias("end"))
    return ends.select("source", F.explode(F.sequence(F.lit(-500), "end", F.lit(1370))).alias("view"))


def page_layout(spark, d):
    return _boxes(spark, d)


def visible_pages(spark, d):
    boxes = cut(_boxes(spark, d))  # laid out once, for the views and for what they meet
    views = _tops(boxes).select("source", "view", F.col("view").cast("double").alias("top"), F.lit(900.0).alias("height"))
    return layout.visible(boxes, views, "source")


def nearest_page(spark, d):
    boxes = cut(_boxes(spark, d))
    return layout.nearest(boxes, _tops(boxes).select("source", F.col("view").alias("point"), F.col("view").cast("double").alias("y")), "source")


def offset_page(spark, d):
    boxes = cut(_boxes(spark, d))
    return layout.at_offset(boxes, _tops(boxes).select("source", F.col("view").cast("double").alias("offset")), "source")


def fit_scales(spark, d):
    return layout.fit_scale(_pages(spark, d), "source", 1200.0, 800.0)


def priority_order(spark, d):
    first, last = F.lit(10), F.lit(14)
    marked = _pages(spark, d).withColumn("priority", layout.priority(F.col("index"), first, last, F.lit(1)).cast("long"))
    ranked = numbered(marked, ["source"], "priority", "n", ("index",), width=layout.ROWS)
    return ranked.select("source", "index", "priority", (F.col("n") + 1).cast("int").alias("n"))


def install_order(spark, d):
    marked = _pages(spark, d).withColumn("priority", layout.priority(F.col("index"), F.lit(10), F.lit(14), F.lit(-1)).cast("long"))
    finished = _pages(spark, d).where("width > 600")
    return layout.install_next(marked, finished, "source")


def lookahead_pages(spark, d):
    return layout.lookahead(_pages(spark, d), F.lit(3), F.lit(6), F.lit(1), 4).select("source", "index")


def work_order(spark, d):
    return layout.work_order(_pages(spark, d).select("source", "index"), "source", F.lit(5))


def retain_nearest(spark, d):
    return layout.retain_nearest(_pages(spark, d).select("source", "index"), "source", F.lit(20), 12)


def zoom_ladder(spark, d):
    levels = table(spark, d, "customer").select(F.col("c_mktsegment").alias("doc"), F.round(F.col("c_acctbal") / 10000, 3).alias("level")).where("level > 0").distinct()
    return layout.ladder(levels, "doc", 1.5e-3)


def nearest_level(spark, d):
    now = table(spark, d, "customer").select(F.col("c_mktsegment").alias("doc")).distinct().withColumn("scale", F.lit(0.5))
    return layout.next_level(zoom_ladder(spark, d), now, "doc")


def zoom_options(spark, d):
    """Labels of the rungs of each segment, the first of equal labels staying."""
    levels = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_mktsegment").alias("doc"), F.col("c_custkey").alias("ord"), numbers.zoom_label(F.when(F.col("c_nationkey") == 3, "fit-width").otherwise("custom"), F.col("c_acctbal") / 10000).alias("label"))
    return levels.groupBy("doc", "label").agg(F.min("ord").alias("ord"))


QUERIES = [page_layout, visible_pages, nearest_page, offset_page, fit_scales, priority_order, install_order, lookahead_pages, work_order, retain_nearest, zoom_ladder, nearest_level, zoom_options]
PAGES = """pages_ AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS "index", 600.0::DOUBLE + n_chars % 3 * 50 AS width, 200.0::DOUBLE + n_chars * 397 % 1000 AS height FROM documents)"""
BOXES = f"""{PAGES}, r AS (SELECT *, CASE WHEN "index" = 0 THEN 0 ELSE ("index" - 1) // 2 + 1 END AS "row" FROM pages_),
rows_ AS (SELECT source, "row", max(height) AS rh, sum(width) + 14.0 * (count(*) - 1) AS nat, max(width) AS w FROM r GROUP BY source, "row"),
tops AS (SELECT source, "row", rh, nat, max(w) OVER (PARTITION BY source) AS most, 16.0 + coalesce(sum(rh + 14) OVER (PARTITION BY source ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rt FROM rows_),
boxes AS (SELECT r.source, r."index", r."row", cast(16.0 + greatest(0, (most - nat) / 2) + coalesce(sum(r.width + 14) OVER (PARTITION BY r.source, r."row" ORDER BY r."index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS "left",
  cast(rt + (rh - r.height) / 2 AS DOUBLE) AS top, r.width, r.height FROM r JOIN tops ON r.source = tops.source AND r."row" = tops."row")"""
VIEWS = """views AS (SELECT source, cast(unnest(range(-500, cast(floor(max(top + height)) AS BIGINT) + 1001, 1370)) AS INTEGER) AS view FROM boxes GROUP BY source)"""
NEAREST = """(SELECT b.source, v.view, arg_min(b."index", greatest(b.top - (v.view + {0}), v.view + {0} - b.top - b.height, 0) * 100000 + b."index") AS i FROM boxes b JOIN views v ON b.source = v.source GROUP BY b.source, v.view)"""
PRIORITY = 'CASE WHEN greatest({a} - "index", "index" - {z}) <= 0 THEN 0 ELSE greatest({a} - "index", "index" - {z}) * 2 + CASE WHEN {behind} THEN 1 ELSE 0 END END'
LADDER = """l AS (SELECT DISTINCT c_mktsegment AS doc, round(c_acctbal / 10000, 3) AS level FROM customer WHERE round(c_acctbal / 10000, 3) > 0), g AS (SELECT doc, level, level - lag(level) OVER (PARTITION BY doc ORDER BY level) AS gap FROM l), ladder AS (SELECT doc, level FROM g WHERE gap IS NULL OR gap > 0.0015)"""
SQL = {
    "page_layout": f'WITH {BOXES} SELECT source, "index", "row", "left", top, width, height FROM boxes',
    "visible_pages": f"""WITH {BOXES}, {VIEWS}, m AS (SELECT v.source, v.view, min(b."index") AS a, max(b."index") AS z FROM boxes b JOIN views v ON b.source = v.source AND b.top + b.height >= v.view AND b.top <= v.view + 900 GROUP BY v.source, v.view)
      SELECT n.source, n.view, coalesce(a, i) AS first, coalesce(z, i) AS last FROM {NEAREST.format(450)} n LEFT JOIN m ON n.source = m.source AND n.view = m.view""",
    "nearest_page": f'WITH {BOXES}, {VIEWS} SELECT source, view AS point, i AS "index" FROM {NEAREST.format(0)}',
    "offset_page": f"""WITH {BOXES}, {VIEWS} SELECT v.source, cast(v.view AS DOUBLE) AS "offset", coalesce(max(b."index"), 0) AS "index" FROM views v LEFT JOIN boxes b ON b.source = v.source AND b.top <= v.view + 16 GROUP BY v.source, v.view""",
    "fit_scales": f"WITH {PAGES} SELECT source, least(12.0, greatest(0.05, 1168.0::DOUBLE / max(width))) AS fit_width, least(12.0, greatest(0.05, least(1168.0::DOUBLE / max(width), 768.0::DOUBLE / max(height)))) AS fit_page FROM pages_ GROUP BY source",
    "priority_order": f"""WITH {PAGES}, p AS (SELECT source, "index", {PRIORITY.format(a=10, z=14, behind='"index" < 10')} AS priority FROM pages_) SELECT source, "index", priority, cast(row_number() OVER (PARTITION BY source ORDER BY priority, "index") AS INTEGER) AS n FROM p""",
    "install_order": f"""WITH {PAGES}, p AS (SELECT source, "index", {PRIORITY.format(a=10, z=14, behind='"index" > 14')} AS priority FROM pages_ WHERE width > 600), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, "index") AS n FROM p) SELECT source, "index" FROM r WHERE n = 1""",
    "lookahead_pages": f'WITH {PAGES} SELECT source, "index" FROM pages_ WHERE "index" > 6 AND "index" <= 10',
    "work_order": f"""WITH {PAGES} SELECT source, "index", cast(row_number() OVER (PARTITION BY source ORDER BY "index" <> 5, "index") - 1 AS INTEGER) AS ord FROM pages_""",
    "retain_nearest": f"""WITH {PAGES}, r AS (SELECT source, "index", row_number() OVER (PARTITION BY source ORDER BY abs("index" - 20), "index" DESC) AS n FROM pages_) SELECT source, "index" FROM r WHERE n <= 12""",
    "zoom_ladder": f"WITH {LADDER} SELECT doc, level FROM ladder",
    "nearest_level": f"WITH {LADDER}, r AS (SELECT doc, level, row_number() OVER (PARTITION BY doc ORDER BY abs(level - 0.5), level) AS n FROM ladder) SELECT doc, level FROM r WHERE n = 1",
    "zoom_options": """SELECT c_mktsegment AS doc, cast(cast(floor(c_acctbal / 10000 * 100 + 0.5) AS BIGINT) AS VARCHAR) || CASE WHEN c_nationkey = 3 THEN '% (fit width)' ELSE '' END AS label, min(c_custkey) AS ord FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2""",
}

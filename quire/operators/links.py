"""Links: scanning, classifying, hit areas, anchors, and the outline of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.workers import cut

NOWHERE = -1


def scan(pages: DataFrame) -> DataFrame:
    """(page_id, n, uri) of every anchor, in document order."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("n", "uri"))


def classified(links: DataFrame) -> DataFrame:
    """links (uri, and dest_page from 0 or null) with kind and target_page: a destination or an address without a scheme is
    internal, the latter nowhere; an external link has no page either."""
    dest = F.col("dest_page")
    kind = F.when(dest.isNotNull(), "internal").when(urls.external(F.col("uri")), "external").otherwise("internal")
    target = F.when(dest.isNotNull(), dest + 1).otherwise(NOWHERE).cast("int")
    return links.withColumn("kind", kind).withColumn("target_page", target).withColumn("openable", urls.openable(F.col("uri")))


def hit_areas(links: DataFrame) -> DataFrame:
    """Links that can be clicked: a finite rectangle with an area, and a page to go to or an external address."""
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    sound = F.lit(True)
    for c in sides:
        sound &= ~F.isnan(c) & (F.abs(c) < float("inf"))
    area = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return links.where(sound & area & ((F.col("kind") == "external") | (F.col("target_page") >= 1)))


def anchor_target(tag: Column) -> Column:
    """(href, page, y, openable) of an anchor's markup: a page that is no integer drops the link (null), a y that is no
    number is null."""
    get = lambda name: F.nullif(F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1), F.lit(""))
    page, href = get("data-page").try_cast("int"), get("href")
    made = F.struct(href.alias("href"), page.alias("page"), get("data-y").try_cast("double").alias("y"), href.isNotNull().alias("openable"))
    return F.when(href.isNotNull() | page.isNotNull(), made)


def outline(nodes: DataFrame) -> DataFrame:
    """(root, id, ord, depth, title, page): nodes (id, parent, pos, title, page) of a forest in pre-order, ord from 0 within
    each root.

    By path doubling: each node holds the path from an ancestor, first its parent, down to itself; a round joins it to that
    ancestor's own path, so that a node of depth d is done after log2(d) rounds. What is no forest is an error that names
    nodes: an id that is repeated or null, a parent that is not there, and circles - nodes that no root reaches, which show
    when a round ends with as many open nodes as it began with."""
    _none(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null"), "ids of the outline are repeated or null, so that a node may be its own ancestor")
    child = nodes.select("id", F.col("parent").alias("up"))
    _none(child.where("up is not null").join(nodes.select(F.col("id").alias("up")), "up", "left_anti"), "nodes of the outline have a parent that is not there")
    step = F.struct(F.col("pos").alias("pos"), F.col("id").alias("id"))
    paths = cut(nodes.select("id", F.col("parent").alias("up"), "title", "page", F.array(step).alias("path")))
    left = paths.where("up is not null").count()
    while left:
        above = paths.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        joined = paths.where("up is not null").join(above, "up").select("id", F.col("next").alias("up"), "title", "page", F.concat("above", "path").alias("path"))
        paths = cut(joined.unionByName(paths.where("up is null")))
        before, left = left, paths.where("up is not null").count()
        if left == before:
            _none(paths.where("up is not null"), "nodes of the outline are their own ancestors or under such nodes")
    place = F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1
    return paths.withColumn("root", F.col("path")[0]["id"]).select("root", "id", place.alias("ord"), (F.size("path") - 1).alias("depth"), "title", "page")


def _none(wrong: DataFrame, what: str) -> None:
    """An error that names some of the nodes, if there are any."""
    named = [r["id"] for r in wrong.select("id").orderBy("id").limit(10).collect()]
    if named:
        raise ValueError(f"{what}: {', '.join(map(repr, named))}")


def active(entries: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, page, ord): for each page of places the last entry in document order - not the highest page - among those with
    0 < entry page <= page; null where there is none. One window over the union of both, a running maximum."""
    both = entries.where("page > 0").select(key, "page", F.col("ord").cast("int").alias("ord"), F.lit(0).alias("probe")).unionByName(
        places.select(key, "page", F.lit(None).cast("int").alias("ord"), F.lit(1).alias("probe"))
    )
    w = Window.partitionBy(key).orderBy("page", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("ord", F.max("ord").over(w)).where("probe = 1").select(key, "page", "ord")

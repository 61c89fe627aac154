"""Queries of links, addresses, digests and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..functions import text as tx
from ..operators import links
from ..sources import documents as src
from ..sources.documents import table


def link_classify(spark, d):
    found = links.scan(table(spark, d, "pages")).unionByName(table(spark, d, "pages").select("page_id", F.lit(-1).alias("n"), F.col("url").alias("uri")))
    dest = F.regexp_extract("uri", r"page=(\d+)", 1).try_cast("int")
    return links.classified(found.withColumn("dest_page", dest)).select("page_id", "n", "uri", "kind", "target_page", "openable")


def link_areas(spark, d):
    found = links.scan(table(spark, d, "pages")).withColumn("dest_page", F.when(F.col("n") % 3 == 0, F.col("n")))
    size = F.length("uri").cast("double")
    placed = links.classified(found).select("page_id", "n", "kind", "target_page", (F.col("n") * 10.0).alias("x0"), F.lit(5.0).alias("y0"), (F.col("n") * 10.0 + size - 4).alias("x1"), F.lit(15.0).alias("y1"))
    return links.hit_areas(placed)


def url_keys(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.document_key(u).alias("key"), urls.file_name(u).alias("name"), urls.with_pdf(urls.file_name(u)).alias("file"), urls.without_scheme(u).alias("shown"))


def pdf_like_urls(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", urls.pdf_url(u).alias("pdf"), urls.pdf_url(F.concat(F.lower(F.regexp_replace(u, "[?#].*$", "")), F.lit(".PDF?x"))).alias("made"), urls.external(u).alias("external"), urls.openable(u).alias("openable"),
        urls.extension_openable(u).alias("extension"),
    )


def page_metadata(spark, d):
    return src.metadata(table(spark, d, "documents"))


def key_ids(spark, d):
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", tx.key_id(b).alias("key_id"), tx.content_name(b).alias("name"))


def integrity_names(spark, d):
    b = F.col("url").cast("binary")
    return table(spark, d, "pages").select("page_id", tx.integrity(b).alias("integrity"), F.crc32(b).alias("crc"), tx.two_lane_digest(F.array("url", F.col("page_id").cast("string"))).alias("digest"))


def program_ids(spark, d):
    b = F.col("url").cast("binary")
    return table(spark, d, "pages").select("page_id", tx.program_id(F.col("page_id").cast("string"), b).alias("id"), tx.base36(tx.fnv1a(b)).alias("base36"), tx.word_sum(b).alias("words"))


def zoom_texts(spark, d):
    texts = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*(F.lit(t) for t in ZOOM)), F.col("n_nationkey") + 1).alias("raw"))
    parsed = texts.withColumn("z", numbers.parse_zoom(F.col("raw")))
    return parsed.select("n_nationkey", F.col("z.mode").alias("mode"), F.round("z.value", 6).alias("value"), numbers.zoom_label(F.col("z.mode"), F.coalesce("z.value", F.lit(0.7234))).alias("label"))


ZOOM = ["150", " 75 ", "150%", "1.5", "2x", "1.5%", "12", ".5", "fit width", "Fit-width", "fit page", "page", "Fit", "229% (fit width)", "", " ", "abc", "-50", "0", "10 apples", "1.2.3", "%", "11.99", "100x", "auto"]


def clamps(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", numbers.fade(x / 10000).alias("fade"), numbers.clamp_zoom(x / 500).alias("zoom"), numbers.percent(x / 1000).alias("percent"), numbers.progress(x, F.lit(5000.0)).alias("progress"),
        numbers.clamp_page(x / 100, F.lit(50)).alias("page"), tx.round2(x / 7).alias("r"),
    )


def _tree(spark, d):
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    a = region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("title"), F.lit(0).cast("long").alias("page"))
    b = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), F.col("n_nationkey").cast("long"), "n_name", F.pmod(F.col("n_nationkey") * 7, F.lit(40)).cast("long"))
    c = customer.select(F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey")), F.col("c_custkey"), "c_name", F.pmod(F.col("c_custkey") * 13, F.lit(50)) - 1)
    return a.union(b).union(c)


def outline_flatten(spark, d):
    return links.outline(_tree(spark, d)).select("root", "id", F.col("ord").cast("long").alias("ord"), "depth", "page")


def outline_active(spark, d):
    entries = links.outline(_tree(spark, d))
    places = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("root"), F.explode(F.expr("sequence(1L, 50L)")).alias("page"))
    return links.active(entries, places, "root").select("root", "page", F.coalesce(F.col("ord").cast("long"), F.lit(-1)).alias("ord"))


QUERIES = [link_classify, link_areas, url_keys, pdf_like_urls, page_metadata, key_ids, integrity_names, program_ids, zoom_texts, clamps, outline_flatten, outline_active]
SCAN = """scan AS (SELECT page_id, cast(i AS INTEGER) AS n, u[i + 1] AS uri FROM (SELECT page_id, u, unnest(range(0, len(u))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1) AS u FROM pages)))"""
OUTLINE = """tree AS (
  SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth, 0 AS page, [r_regionkey] AS path FROM region UNION ALL
  SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1, n_nationkey * 7 % 40, [n_regionkey, n_nationkey] FROM nation UNION ALL
  SELECT 'r' || n_regionkey, 'c' || c_custkey, 2, c_custkey * 13 % 50 - 1, [n_regionkey, n_nationkey, c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS ord, depth, cast(page AS BIGINT) AS page FROM tree)"""
SQL = {
    "link_classify": f"""WITH {SCAN}, l AS (SELECT page_id, n, uri FROM scan UNION ALL SELECT page_id, -1, url FROM pages), c AS (SELECT *, try_cast(nullif(regexp_extract(uri, 'page=(\\d+)', 1), '') AS INTEGER) AS dest, regexp_matches(uri, '^[A-Za-z][A-Za-z0-9+.-]+:') AS ext FROM l)
      SELECT page_id, n, uri, CASE WHEN dest IS NULL AND ext THEN 'external' ELSE 'internal' END AS kind, CASE WHEN dest IS NOT NULL THEN dest + 1 ELSE -1 END AS target_page, regexp_matches(uri, '(?i)^(https?://|mailto:|tel:)\\S') AS openable FROM c""",
    "link_areas": f"""WITH {SCAN} SELECT page_id, n, 'internal' AS kind, n + 1 AS target_page, n * 10.0::DOUBLE AS x0, 5.0::DOUBLE AS y0, n * 10.0::DOUBLE + length(uri) - 4 AS x1, 15.0::DOUBLE AS y1 FROM scan WHERE n % 3 = 0 AND length(uri) > 4
      UNION ALL SELECT page_id, n, 'external', -1, n * 10.0::DOUBLE, 5.0::DOUBLE, n * 10.0::DOUBLE + length(uri) - 4, 15.0::DOUBLE FROM scan WHERE n % 3 <> 0 AND regexp_matches(uri, '^[A-Za-z][A-Za-z0-9+.-]+:') AND length(uri) > 4""",
    "url_keys": """WITH p AS (SELECT page_id, url, string_split(url, '#')[1] AS bare, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages),
      k AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest, string_split(path, '/')[-1] AS name FROM p)
      SELECT page_id, 'url:' || scheme || '://' || host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS key, name, CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END AS file, regexp_replace(url, '(?i)^[a-z][a-z0-9+.-]*://', '') AS shown FROM k""",
    "pdf_like_urls": """SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) LIKE '%.pdf' AS pdf, true AS made, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]+:') AS external, regexp_matches(url, '(?i)^(https?://|mailto:|tel:)\\S') AS openable, regexp_matches(url, '(?i)^(https?|file):') AS extension FROM pages""",
    "page_metadata": "SELECT doc_id, string_split(text, '\n')[1] AS title, source AS producer, CASE WHEN trim(lang) = '' THEN cast(doc_id + 1 AS VARCHAR) ELSE trim(lang) END AS label FROM documents",
    "key_ids": "SELECT doc_id, translate(substr(sha256(text), 1, 32), '0123456789abcdef', 'abcdefghijklmnop') AS key_id, substr(sha256(text), 1, 12) AS name FROM documents",
    "zoom_texts": "WITH t(n, raw) AS (VALUES " + ", ".join(f"({i}, {t!r})" for i, t in enumerate(ZOOM)) + """),
      p AS (SELECT n, lower(trim(raw)) AS x FROM t), q AS (SELECT n, x, try_cast(nullif(regexp_extract(x, '^([0-9]*\\.?[0-9]+)\\s*(%|x|×)?$', 1), '') AS DOUBLE) AS v, regexp_extract(x, '^([0-9]*\\.?[0-9]+)\\s*(%|x|×)?$', 2) AS u FROM p),
      m AS (SELECT n, CASE WHEN contains(x, 'width') THEN 'fit-width' WHEN contains(x, 'page') OR x IN ('fit', 'auto', 'full', 'whole') THEN 'fit-page' WHEN v > 0 THEN 'custom' END AS mode,
        CASE WHEN contains(x, 'width') OR contains(x, 'page') OR NOT coalesce(v > 0, false) THEN NULL WHEN u = '%' THEN v / 100 WHEN u <> '' THEN v WHEN v >= 12 THEN v / 100 ELSE v END AS value FROM q)
      SELECT n_nationkey, mode, round(value, 6) AS value, cast(cast(floor(coalesce(value, 0.7234) * 100 + 0.5) AS BIGINT) AS VARCHAR) || CASE mode WHEN 'fit-width' THEN '% (fit width)' WHEN 'fit-page' THEN '% (fit page)' ELSE '' END AS label FROM nation JOIN m ON n = n_nationkey""",
    "clamps": """SELECT c_custkey, least(0.5, greatest(0.05, c_acctbal / 10000)) AS fade, least(12.0, greatest(0.05, c_acctbal / 500)) AS zoom, cast(floor(c_acctbal / 1000 * 100 + 0.5) AS BIGINT) AS percent, least(1.0, c_acctbal / 5000.0::DOUBLE) AS progress,
      cast(least(50, greatest(1, floor(c_acctbal / 100 + 0.5))) AS INTEGER) AS page, round(c_acctbal / 7, 2) AS r FROM customer""",
    "outline_flatten": f"WITH {OUTLINE} SELECT root, id, ord, depth, page FROM o",
    "outline_active": f"WITH {OUTLINE}, p AS (SELECT 'r' || r_regionkey AS root, unnest(range(1, 51)) AS page FROM region) SELECT p.root, p.page, coalesce(max(o.ord), -1) AS ord FROM p LEFT JOIN o ON o.root = p.root AND o.page > 0 AND o.page <= p.page GROUP BY p.root, p.page",
    "program_ids": """WITH u AS (SELECT page_id, url, list_transform(string_split(url, ''), lambda c: cast(unicode(c) AS BIGINT)) AS b FROM pages),
      f AS (SELECT page_id, url, b, list_reduce(list_prepend(2166136261::BIGINT, b), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h, list_concat(b, list_transform(range(0, (4 - len(b) % 4) % 4), lambda i: 0::BIGINT)) AS w FROM u)
      SELECT page_id, page_id || '|' || len(b) || '|' || lower(to_base(h, 16)) AS id, lower(to_base(h, 36)) AS base36, cast(list_sum(list_transform(w, lambda x, i: x << (8 * (3 - (i - 1) % 4)))) % 4294967296 AS BIGINT) AS words FROM f""",
}

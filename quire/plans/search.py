"""Queries of runs and search."""

from __future__ import annotations

from ..functions import text as tx
from ..operators import search
from ..sources.corpus import read_corpus
from ..sources.documents import page_runs, run_rows, table
from ..sources.page_files import listed_pages, write_pages
from ..streaming.growing import GrowingIndex
from ..streaming.streams import fresh_folder
from pyspark.sql import functions as F

PHRASE, RARE = "The ", "Tion and"

NORM = "lower(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]', '', 'g'))"
RUNS_SQL = """runs AS (
  SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<(?:p|h1|li|a|title)\\b[^>]*>(.*?)</(?:p|h1|li|a|title)>', 1),
    lambda x: replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS runs FROM pages),
norms AS (SELECT page_id, runs, array_to_string(list_transform(runs, lambda x: lower(regexp_replace(x, '[ \\t\\n\\r\\f\\x0B]', '', 'g'))), '') AS norm FROM runs),
parts AS (SELECT page_id, runs, norm, string_split(norm, 'the') AS p FROM norms),
hits AS (SELECT page_id, unnest(list_transform(range(1, len(p)), lambda i: cast(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + (i - 1) * 3 AS INTEGER))) AS start FROM parts)"""
SPANS_SQL = """lens AS (SELECT page_id, list_transform(runs, lambda x: length(lower(regexp_replace(x, '[ \\t\\n\\r\\f\\x0B]', '', 'g')))) AS l FROM runs),
spans AS (SELECT page_id, unnest(range(0, len(l))) AS run_no, l FROM lens),
placed AS (SELECT page_id, cast(run_no AS INTEGER) AS run_no, cast(coalesce(list_sum(l[1:run_no]), 0) AS INTEGER) AS s, cast(list_sum(l[1:run_no + 1]) AS INTEGER) AS e FROM spans)"""


def page_run_rows(spark, d):
    return run_rows(table(spark, d, "pages"))


def search_hits(spark, d):
    return search.hits(page_runs(table(spark, d, "pages")), PHRASE)


def search_truncated(spark, d):
    return search.state(page_runs(table(spark, d, "pages")), PHRASE)


def search_per_page(spark, d):
    return search.page_hits(page_runs(table(spark, d, "pages")), PHRASE).select("page_id", F.size("starts").alias("n"))


def search_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("text").alias("runs"))
    found = search.page_hits(docs, PHRASE, "doc_id")
    return found.select("doc_id", F.size("starts").alias("n"), F.coalesce(F.array_max("starts"), F.lit(-1)).alias("last"))


def hit_run_overlap(spark, d):
    return search.hit_runs(page_runs(table(spark, d, "pages")), PHRASE)


def run_offsets(spark, d):
    spans = search.run_spans(page_runs(table(spark, d, "pages")))
    return spans.select("page_id", F.explode("spans").alias("s")).select("page_id", "s.run_no", F.col("s.start").alias("s"), F.col("s.end").alias("e"))


def painted_hits(spark, d):
    found = search.page_hits(page_runs(table(spark, d, "pages")), PHRASE).select("page_id", F.posexplode("starts").alias("n", "start"))
    return search.paint(found, 3)


def escaped_runs(spark, d):
    rows = run_rows(table(spark, d, "pages"))
    return rows.select("page_id", "run_no", tx.escape_text(F.col("text")).alias("t"), tx.escape_attribute(F.col("text")).alias("a"))


def search_growing(spark, d):
    """A rarer phrase on an index that a common one has begun."""
    index = GrowingIndex(page_runs(table(spark, d, "pages")), f"{fresh_folder(spark)}/index")
    index.search(PHRASE)
    return index.search(RARE)[0]


def page_text_files(spark, d):
    """A text file for each page, the files listed, and read back as a corpus that is fetched once."""
    folder = fresh_folder(spark)
    texts = page_runs(table(spark, d, "pages")).select("page_id", F.array_join("runs", "\n").alias("text"))
    write_pages(texts, "page_id", "text", f"{folder}/pages")
    files = listed_pages(spark, f"{folder}/pages").where("size > 0")
    files.select(F.concat("name", F.lit("\t"), "uri").alias("value")).write.text(f"{folder}/list")
    found = read_corpus(spark, f"{folder}/list", f"{folder}/cache", "")
    return found.select(F.col("name").cast("long").alias("page_id"), F.length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


QUERIES = [page_text_files, search_growing, page_run_rows, search_hits, search_truncated, search_per_page, search_documents, hit_run_overlap, run_offsets, painted_hits, escaped_runs]
RARE_SQL = RUNS_SQL.replace("'the'", "'tionand'").replace("(i - 1) * 3", "(i - 1) * 7")
SQL = {
    "page_text_files": f"WITH {RUNS_SQL} SELECT page_id, cast(strlen(array_to_string(runs, chr(10))) AS BIGINT) AS bytes, md5(array_to_string(runs, chr(10))) AS digest FROM runs WHERE array_to_string(runs, chr(10)) <> ''",
    "search_growing": f"WITH {RARE_SQL} SELECT page_id, start, start + 7 AS \"end\" FROM hits ORDER BY page_id, start LIMIT 1000",
    "page_run_rows": f"WITH {RUNS_SQL} SELECT page_id, cast(i AS INTEGER) AS run_no, runs[i + 1] AS text FROM (SELECT page_id, runs, unnest(range(0, len(runs))) AS i FROM runs)",
    "search_hits": f"WITH {RUNS_SQL} SELECT page_id, start, start + 3 AS \"end\" FROM hits ORDER BY page_id, start LIMIT 1000",
    "search_truncated": f"WITH {RUNS_SQL}, n AS (SELECT least(len(p) - 1, 1000) AS n FROM parts) SELECT least(cast(sum(n) AS BIGINT), 1000) AS listed, count(*) AS pages, sum(n) > 1000 AS truncated FROM n",
    "search_per_page": f"WITH {RUNS_SQL} SELECT page_id, cast(least(len(p) - 1, 1000) AS INTEGER) AS n FROM parts",
    "search_documents": """WITH n AS (SELECT doc_id, lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]', '', 'g')) AS norm FROM documents),
      p AS (SELECT doc_id, string_split(norm, 'the')[1:1001] AS p FROM n)
      SELECT doc_id, cast(len(p) - 1 AS INTEGER) AS n, cast(CASE WHEN len(p) = 1 THEN -1 ELSE list_sum(list_transform(p[1:len(p) - 1], lambda x: length(x))) + 3 * (len(p) - 2) END AS INTEGER) AS last FROM p""",
    "hit_run_overlap": f"WITH {RUNS_SQL}, {SPANS_SQL} SELECT h.page_id, h.start, r.run_no FROM hits h JOIN placed r ON h.page_id = r.page_id AND r.s < h.start + 3 AND r.e > h.start",
    "run_offsets": f"WITH {RUNS_SQL}, {SPANS_SQL} SELECT page_id, run_no, s, e FROM placed",
    "painted_hits": f"WITH {RUNS_SQL}, n AS (SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS INTEGER) AS n, start FROM hits) SELECT page_id, n, start FROM n ORDER BY n <> 3, page_id, start LIMIT 400",
    "escaped_runs": f"""WITH {RUNS_SQL}, r AS (SELECT page_id, cast(i AS INTEGER) AS run_no, replace(replace(replace(runs[i + 1], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM (SELECT page_id, runs, unnest(range(0, len(runs))) AS i FROM runs))
      SELECT page_id, run_no, t, replace(replace(t, '"', '&quot;'), '''', '&#39;') AS a FROM r""",
}

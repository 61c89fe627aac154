"""Queries of points, fonts' outlines and reading fixation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fixation, matrices, rasters, spatial
from ..sources.documents import ADVANCE, LEADING, LINES_PER_PAGE, MARGIN, grid_spans, run_rows, table

CELL = 8.0


def _points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 0.04).alias("y"), F.col("c_mktsegment").alias("code"))


def _probes(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("probe"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 0.04).alias("y"), F.lit("BUILDING").alias("code"))


def eps_neighbours(spark, d):
    return spatial.neighbours(_probes(spark, d), _points(spark, d), "probe", "point").select("probe", "point")


def eps_unique(spark, d):
    return spatial.unique_neighbour(_probes(spark, d), _points(spark, d), "probe", "point")


def eps_conflicts(spark, d):
    return spatial.conflicts(_probes(spark, d), _points(spark, d), "probe", "point", "code")


def script_safety(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.unsafe_characters(F.col("text")).alias("unsafe"), F.length("text").cast("long").alias("n"))


def fixation_summary(spark, d):
    return fixation.counts(table(spark, d, "conversations"), ["conv_id", "turn"])


def fixation_summary_documents(spark, d):
    return fixation.counts(table(spark, d, "documents"), ["doc_id"])


def fixation_segments(spark, d):
    return fixation.segment_rows(table(spark, d, "documents"), "doc_id", scope=fixation.Scope("short"))


def run_words(spark, d):
    """Words across the runs of pages: a run that begins with a small letter carries the run before it on."""
    runs = run_rows(table(spark, d, "pages")).withColumn("joins", F.col("text").rlike("^[a-z]"))
    marked = fixation.with_joined_segments(runs, ["page_id"])
    fixed = F.aggregate(F.flatten("parts"), F.lit(0).cast("long"), lambda a, s: a + F.when(s["fixation"], s["chars"]).otherwise(0))
    return marked.select("page_id", "first", F.size("parts").alias("runs"), fixed.alias("fixed"))


def nested_transforms(spark, d):
    """Clicks and purchases open a group that turns and moves, views close one, errors and sign-ups draw."""
    n, kind = F.col("event_id"), F.col("event_type")
    turn = F.array(*(F.lit(v) for v in (0.0, 1.0, -1.0, 0.0)), (n % 7).cast("double"), (n % 5).cast("double"))
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(kind.isin("click", "purchase"), "open").when(kind == "view", "close").otherwise("draw").alias("kind"), turn.alias("matrix"))
    found = matrices.composed(rows, "user_id", "event_id", width=64)
    return found.select("user_id", "event_id", *(F.coalesce(F.get("total", F.lit(i)), F.lit(-1.0)).alias(c) for i, c in enumerate("abcdef")))


def ink_coverage(spark, d):
    return rasters.coverage(grid_spans(table(spark, d, "documents")), ["doc_id", "page_no"], CELL)


QUERIES = [run_words, nested_transforms, ink_coverage, eps_neighbours, eps_unique, eps_conflicts, script_safety, fixation_summary, fixation_summary_documents, fixation_segments]
NEAR = "near AS (SELECT s_suppkey AS probe, c_custkey AS point, c_mktsegment AS code FROM supplier JOIN customer ON abs(s_acctbal / 100 - c_acctbal / 100) <= 0.05 AND abs(s_nationkey * 0.04::DOUBLE - c_nationkey * 0.04::DOUBLE) <= 0.05)"
TOP = "stack[len(stack)]"
SQL = {
    "nested_transforms": f"""WITH RECURSIVE m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'view' THEN 2 ELSE 3 END AS kind FROM events),
      w AS (SELECT user_id, cast(0 AS BIGINT) AS i, cast(0 AS BIGINT) AS event_id, 0 AS kind, cast([] AS DOUBLE[][]) AS stack FROM (SELECT DISTINCT user_id FROM m)
        UNION ALL SELECT user_id, i, event_id, kind, CASE kind WHEN 2 THEN stack[1:len(stack) - 1] WHEN 1 THEN list_append(stack,
            CASE WHEN len(stack) = 0 THEN [0.0, 1.0, -1.0, 0.0, event_id % 7, event_id % 5]
            ELSE [{TOP}[3], {TOP}[4], -{TOP}[1], -{TOP}[2], {TOP}[1] * (event_id % 7) + {TOP}[3] * (event_id % 5) + {TOP}[5], {TOP}[2] * (event_id % 7) + {TOP}[4] * (event_id % 5) + {TOP}[6]] END) ELSE stack END
        FROM (SELECT w.user_id, m.i, m.event_id, m.kind, w.stack FROM w JOIN m ON w.user_id = m.user_id AND m.i = w.i + 1))
      SELECT user_id, event_id, coalesce({TOP}[1], -1) AS a, coalesce({TOP}[2], -1) AS b, coalesce({TOP}[3], -1) AS c, coalesce({TOP}[4], -1) AS d, coalesce({TOP}[5], -1) AS e, coalesce({TOP}[6], -1) AS f FROM w WHERE kind = 3""",
    "ink_coverage": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, i - 1 AS line, length(l[i]) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
      b AS (SELECT doc_id, cast(line // {LINES_PER_PAGE} + 1 AS INTEGER) AS page_no, cast(floor({MARGIN} / {CELL}) AS BIGINT) AS x0, cast(ceil(({MARGIN} + n * {ADVANCE}) / {CELL}) AS BIGINT) - 1 AS x1, {MARGIN} + line % {LINES_PER_PAGE} * {LEADING} AS y FROM s WHERE n > 0),
      c AS (SELECT doc_id, page_no, x0, x1, unnest(range(cast(floor(y / {CELL}) AS BIGINT), cast(ceil((y + 10.0) / {CELL}) AS BIGINT))) AS y FROM b),
      r AS (SELECT doc_id, page_no, y, max(x1 - x0 + 1) AS n FROM c GROUP BY ALL), d AS (SELECT doc_id, page_no, v, max(n) + 2 AS n FROM (SELECT doc_id, page_no, n, unnest(range(y - 1, y + 2)) AS v FROM r) GROUP BY ALL)
      SELECT doc_id, page_no, covered, dilated FROM (SELECT doc_id, page_no, cast(sum(n) AS BIGINT) AS covered FROM r GROUP BY ALL) JOIN (SELECT doc_id, page_no, cast(sum(n) AS BIGINT) AS dilated FROM d GROUP BY ALL) USING (doc_id, page_no)""",
    "eps_neighbours": f"WITH {NEAR} SELECT probe, point FROM near",
    "eps_unique": f"WITH {NEAR} SELECT probe, min(point) AS point FROM near GROUP BY probe HAVING min(point) = max(point)",
    "eps_conflicts": f"WITH {NEAR} SELECT DISTINCT probe FROM near WHERE code <> 'BUILDING'",
    "script_safety": "SELECT doc_id, cast(length(regexp_replace(text, '[^" + tx.JOINING_CLASS.replace("\\x{", "\\x{") + "]', '', 'g')) AS BIGINT) AS unsafe, cast(length(text) AS BIGINT) AS n FROM documents",
    "fixation_summary": r"""WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM conversations)
      SELECT conv_id, turn, cast(coalesce(list_sum(list_transform(w, lambda x: CASE WHEN NOT regexp_matches(x, '\p{L}') THEN 0 WHEN length(x) <= 0 THEN 0 WHEN length(x) <= 4 THEN length(x) - 1 WHEN length(x) <= 12 THEN length(x) - 2
        WHEN length(x) <= 17 THEN length(x) - 3 WHEN length(x) <= 24 THEN length(x) - 4 WHEN length(x) <= 29 THEN length(x) - 5 WHEN length(x) <= 35 THEN length(x) - 6 WHEN length(x) <= 42 THEN length(x) - 7 WHEN length(x) <= 48 THEN length(x) - 8 ELSE length(x) - 9 END)), 0) AS BIGINT) AS fixed,
        cast(length(text) AS BIGINT) AS chars FROM w""",
}

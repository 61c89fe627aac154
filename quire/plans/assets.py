"""Queries of stylesheets, font files, resources, page counters, memos, rule lists and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fonts, memory, programs, rules, search, spans
from ..sources.documents import run_rows, table
from ..streaming import streams
from .search import RUNS_SQL


def _sheets(spark, d):
    """A stylesheet for each region: a rule for each nation, some of them blank lines, some without a family."""
    key = F.col("n_nationkey")
    rule = F.concat(F.lit("@font-face { font-family: '"), "n_name", F.lit("'; src: url(\"face-"), key.cast("string"), F.lit('"); }'))
    line = F.when(key % 7 == 0, "  ").when(key % 5 == 0, F.concat(F.lit("@media p"), key.cast("string"), F.lit(" {}"))).otherwise(rule)
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("r")))).alias("l"))
    return rows.select("n_regionkey", F.array_join("l.r", "\n").alias("css"))


def stylesheet_assets(spark, d):
    return fonts.rule_assets(_sheets(spark, d), "n_regionkey")


def served_faces(spark, d):
    key = F.col("n_nationkey")
    known = table(spark, d, "nation").where("n_nationkey % 3 <> 0")
    face = lambda order, url: known.select("n_regionkey", order.alias("ord"), F.col("n_name").alias("family"), F.concat(F.lit("face-"), key.cast("string")).alias("uri"), url.alias("url"), F.lit("woff2").alias("format"), (key * 100).alias("bytes"), key.alias("glyphs"))
    faces = face(key, F.concat(F.lit("blob:"), key.cast("string"))).unionByName(face(F.lit(-1), F.lit("old")))
    return fonts.served(fonts.rule_assets(_sheets(spark, d), "n_regionkey"), faces, "n_regionkey")


def font_directories(spark, d):
    tables = table(spark, d, "part").groupBy(F.col("p_brand").alias("font_key"), F.col("p_type").alias("tag")).agg(F.sum("p_size").alias("length"))
    return fonts.directory(tables)


def resource_walk(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    own = (k % 97).alias("resource")
    inner = part.where("p_partkey % 5 <> 0").select(own, ((k * 7 + 3) % 97).alias("child")).unionByName(part.where("p_partkey % 3 = 0").select(own, ((k * 11 + 5) % 97).alias("child"))).distinct()
    entries = part.select(own, (k % 13).alias("font")).distinct()
    roots = table(spark, d, "region").select(F.col("r_regionkey").alias("page"), (F.col("r_regionkey") * 10 + 1).cast("long").alias("resource"))
    return fonts.resource_fonts(roots, inner, entries)


def ligature_orders(spark, d):
    k = F.col("p_partkey")
    given = table(spark, d, "part").select(F.col("p_brand").alias("font_key"), F.col("p_size").alias("first"), F.sequence(F.lit(1).cast("long"), k % 3 + 1).alias("rest"), (k % 50).alias("by"))
    return fonts.ligature_rules(given).select("font_key", "first", F.array_join(F.transform("rest", lambda x: x.cast("string")), ",").alias("rest"), "by", "ord")


def page_letter_names(spark, d):
    gid = F.pmod("l_partkey", F.lit(97)).cast("int")
    uses = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("font_key"), gid.alias("gid"), F.pmod("l_orderkey", F.lit(50)).alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_quantity") > 49, F.col("l_suppkey").cast("string")).alias("letters"),
    )
    named = uses.where("gid % 2 = 0").select("font_key", "gid", F.concat(F.lit("g"), F.col("gid").cast("string")).alias("letters")).distinct()
    return fonts.letters_by_name(uses, named)


def run_breaks(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", (((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("seq"), F.col("l_returnflag").alias("entry"), F.col("l_linestatus").alias("paint"), (F.col("l_tax") > 0.04).alias("matrix"), (F.col("l_quantity") > 45).alias("markup"),
        (F.lit(1) + (F.col("l_quantity") < 5).cast("int")).alias("letters"), (F.col("l_discount") > 0.05).alias("faded"),
    )
    return spans.broken_runs(items, ["l_orderkey"]).select("l_orderkey", "seq", "run_no", "group_no")


def page_counters(spark, d):
    mode = F.col("l_suppkey") % 6
    kind = F.when(mode == 0, "image").when(mode == 1, "shade").when(mode == 2, "space").otherwise("glyph")
    items = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("page"), kind.alias("kind"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("face"), F.col("l_linenumber").alias("run_no"), (F.col("l_discount") > 0.05).alias("faded")
    )
    return spans.page_stats(items, ["page"])


def merged_bands(spark, d):
    """The items of an order as boxes of one hit, merged into lines."""
    box = F.struct((F.col("l_quantity") * 1.0).alias("x"), (F.col("l_linenumber") * 3.0).alias("y"), (F.col("l_quantity") % 7 + 1.0).alias("w"), (F.col("l_linenumber") % 3 * 4.0 + 2.0).alias("h"))
    hits = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    each = hits.select("l_orderkey", F.posexplode(search.bands(F.col("boxes"))).alias("n", "b"))
    return each.select("l_orderkey", "n", "b.x", "b.y", "b.w", "b.h")


def example_list(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("known").alias("note"))
    both = memory.listed(nation.where("n_nationkey % 4 = 0"), nation, "n_nationkey")
    return both.select(F.col("ord.part").alias("part"), F.col("ord.n").alias("n"), "n_name", "note")


def memo_measures(spark, d):
    """Measures of all users' events, those of every third user from a memo."""
    events, keys = table(spark, d, "events"), ["user_id", "event_type"]

    def measure(asked):
        return events.where("value > 60").join(asked, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))

    empty = measure(events.select(*keys).limit(0))
    _, memo = memory.memoised(events.where("user_id % 3 = 0"), empty, keys, measure)
    return memory.memoised(events, memo, keys, measure)[0].select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("most", F.lit(-1.0)).alias("most"))


def _titled(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("needs_title"))


def rule_selection(spark, d):
    return rules.select_all(_titled(spark, d), F.lit(""))


def rule_all_selected(spark, d):
    given, chosen = _titled(spark, d), rule_selection(spark, d)
    state = lambda name, ids: rules.all_selected(given, ids, F.lit("")).select(F.lit(name).alias("what"), "all_selected")
    return state("all", chosen).unionByName(state("some", chosen.where("id % 10 <> 1")))


def rules_in_order(spark, d):
    rows = lambda name, key, text: table(spark, d, name).select(F.col(key).cast("long").alias("ord"), F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("id"), F.col(text).alias("pattern"))
    return rules.in_order(rows("region", "r_regionkey", "r_name"), rows("nation", "n_nationkey", "n_name"), rows("supplier", "s_suppkey", "s_name"))


def walked_runs(spark, d):
    out = streams.walk(spark, d, "pages", table(spark, d, "pages").schema, run_rows)
    return spark.read.parquet(out).select("page_id", "run_no", "text")


def program_names(spark, d):
    """A font program for each part, its glyphs named by the words of the part's name, and the names read back from the bytes."""
    words = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("words"))
    found = programs.glyph_names(programs.made_programs(words, "p_partkey", "words"), "p_partkey")
    return found.select("p_partkey", "gid", "name", F.coalesce(F.get("codes", F.lit(0)), F.lit(-1)).alias("code"))


QUERIES = [program_names, 
    stylesheet_assets, served_faces, font_directories, resource_walk, ligature_orders, page_letter_names, run_breaks, page_counters, merged_bands, example_list, memo_measures, rule_selection, rule_all_selected,
    rules_in_order, walked_runs,
]
SHEET = """sheet AS (SELECT n_regionkey, n_nationkey AS k, n_name, cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS n,
  CASE WHEN n_nationkey % 5 = 0 THEN '@media p' || n_nationkey || ' {}' ELSE '@font-face { font-family: ''' || n_name || '''; src: url("face-' || n_nationkey || '"); }' END AS css FROM nation WHERE n_nationkey % 7 <> 0),
asset AS (SELECT n_regionkey, k, n_name, n, CASE WHEN k % 5 = 0 THEN css ELSE n_name END AS family, css FROM sheet)"""
SQL = {
    "program_names": """WITH w AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x, i: list_position(string_split(p_name, ' '), x) = i) AS words FROM part)
      SELECT p_partkey, cast(i AS INTEGER) AS gid, CASE WHEN i = 0 THEN '.notdef' ELSE words[i] END AS name, cast(CASE WHEN i = 0 THEN -1 ELSE 64 + i END AS INTEGER) AS code FROM (SELECT p_partkey, words, unnest(range(0, len(words) + 1)) AS i FROM w)""",
    "stylesheet_assets": f"WITH {SHEET} SELECT n_regionkey, n, family, css FROM asset",
    "served_faces": f"""WITH {SHEET} SELECT n_regionkey, n, family, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN replace(css, '"face-' || k || '"', '"blob:' || k || '"') ELSE css END AS css,
      CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'woff2' ELSE 'woff' END AS format, cast(CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN k * 100 ELSE 0 END AS BIGINT) AS bytes, cast(CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN k ELSE 0 END AS BIGINT) AS glyphs FROM asset""",
    "font_directories": """WITH t AS (SELECT p_brand AS font_key, p_type AS tag, cast(sum(p_size) AS BIGINT) AS length FROM part GROUP BY 1, 2),
      n AS (SELECT *, count(*) OVER (PARTITION BY font_key) AS tables, (length + 3) // 4 * 4 AS padded FROM t)
      SELECT font_key, tag, cast(row_number() OVER w - 1 AS INTEGER) AS ord, cast(12 + 16 * tables + coalesce(sum(padded) OVER (PARTITION BY font_key ORDER BY tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, tables,
        cast(16 * (1 << (length(bin(tables)) - 1)) AS BIGINT) AS search_range, cast(length(bin(tables)) - 1 AS INTEGER) AS selector, cast(16 * tables - 16 * (1 << (length(bin(tables)) - 1)) AS BIGINT) AS shift FROM n WINDOW w AS (PARTITION BY font_key ORDER BY tag)""",
    "resource_walk": """WITH RECURSIVE e AS (SELECT p_partkey % 97 AS resource, (p_partkey * 7 + 3) % 97 AS child FROM part WHERE p_partkey % 5 <> 0 UNION SELECT p_partkey % 97, (p_partkey * 11 + 5) % 97 FROM part WHERE p_partkey % 3 = 0),
      f AS (SELECT DISTINCT p_partkey % 97 AS resource, p_partkey % 13 AS font FROM part),
      r(page, resource, depth) AS (SELECT r_regionkey, cast(r_regionkey * 10 + 1 AS BIGINT), 0 FROM region UNION SELECT r.page, e.child, r.depth + 1 FROM r JOIN e ON e.resource = r.resource WHERE r.depth < 6),
      m AS (SELECT page, resource, min(depth) AS depth FROM r GROUP BY page, resource) SELECT page, m.resource, depth, font FROM m JOIN f ON m.resource = f.resource""",
    "ligature_orders": """WITH g AS (SELECT DISTINCT p_brand AS font_key, p_size AS first, range(1, p_partkey % 3 + 2) AS rest, p_partkey % 50 AS "by" FROM part)
      SELECT font_key, first, array_to_string(rest, ',') AS rest, "by", cast(row_number() OVER (PARTITION BY font_key ORDER BY first, len(rest) DESC, "by", rest) - 1 AS INTEGER) AS ord FROM g""",
    "page_letter_names": """WITH u AS (SELECT l_returnflag AS font_key, cast(l_partkey % 97 AS INTEGER) AS gid, l_orderkey % 50 AS page_no, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 49 THEN cast(l_suppkey AS VARCHAR) END AS letters FROM lineitem),
      p AS (SELECT font_key, gid, page_no, coalesce(arg_max(letters, seq) FILTER (WHERE letters IS NOT NULL), CASE WHEN gid % 2 = 0 THEN 'g' || gid END) AS letters FROM u GROUP BY 1, 2, 3)
      SELECT font_key, gid, arg_min(letters, page_no) AS letters FROM p WHERE letters IS NOT NULL GROUP BY 1, 2""",
    "run_breaks": """WITH i AS (SELECT l_orderkey, ((cast(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity AS BIGINT) AS seq, l_returnflag AS entry, l_linestatus AS paint, l_tax > 0.04 AS matrix, l_quantity > 45 AS markup, CASE WHEN l_quantity < 5 THEN 2 ELSE 1 END AS letters, l_discount > 0.05 AS faded FROM lineitem),
      f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(entry) OVER w IS DISTINCT FROM entry OR lag(paint) OVER w IS DISTINCT FROM paint OR lag(matrix) OVER w IS DISTINCT FROM matrix OR markup THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS run_no FROM f),
      c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR letters > 1 OR lag(letters) OVER w > 1 OR lag(faded) OVER w IS DISTINCT FROM faded THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY l_orderkey, run_no ORDER BY seq))
      SELECT l_orderkey, seq, cast(run_no AS BIGINT) AS run_no, cast(sum(cut) OVER (PARTITION BY l_orderkey, run_no ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_no FROM c""",
    "page_counters": """WITH i AS (SELECT l_orderkey % 500 AS page, CASE l_suppkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'shade' WHEN 2 THEN 'space' ELSE 'glyph' END AS kind, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS face, l_linenumber AS run_no, l_discount > 0.05 AS faded FROM lineitem)
      SELECT page, count(*) FILTER (WHERE kind = 'glyph') AS glyphs, count(*) FILTER (WHERE kind = 'glyph' AND face IS NOT NULL) AS as_text, count(*) FILTER (WHERE kind = 'glyph' AND face IS NULL) AS as_outlines, count(DISTINCT CASE WHEN kind = 'glyph' AND face IS NOT NULL THEN run_no END) AS runs,
        count(*) FILTER (WHERE kind = 'space') AS spaces, count(DISTINCT CASE WHEN kind = 'glyph' THEN face END) AS fonts, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'shade') AS shades, count(*) FILTER (WHERE kind = 'glyph' AND face IS NOT NULL AND faded) AS faded FROM i GROUP BY page""",
    "merged_bands": """WITH RECURSIVE i AS (SELECT l_orderkey, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY y, x, w, h) AS INTEGER) AS k, x, y, w, h FROM
        (SELECT l_orderkey, cast(l_quantity AS DOUBLE) AS x, l_linenumber * 3.0::DOUBLE AS y, cast(l_quantity % 7 + 1.0 AS DOUBLE) AS w, l_linenumber % 3 * 4.0::DOUBLE + 2.0 AS h FROM lineitem)),
      s(l_orderkey, k, n, x, y, w, h) AS (SELECT l_orderkey, k, 0, x, y, w, h FROM i WHERE k = 1
        UNION ALL SELECT l_orderkey, k, CASE WHEN j THEN n ELSE n + 1 END, CASE WHEN j THEN least(sx, x) ELSE x END, CASE WHEN j THEN least(sy, y) ELSE y END,
          CASE WHEN j THEN greatest(sx + sw, x + w) - least(sx, x) ELSE w END, CASE WHEN j THEN greatest(sy + sh, y + h) - least(sy, y) ELSE h END
        FROM (SELECT i.*, s.n, s.x AS sx, s.y AS sy, s.w AS sw, s.h AS sh, abs(i.y - s.y) < s.h * 0.5 AND i.x <= s.x + s.w + s.h * 0.4 AS j FROM s JOIN i ON i.l_orderkey = s.l_orderkey AND i.k = s.k + 1)),
      l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, n ORDER BY k DESC) AS r FROM s) SELECT l_orderkey, n, x, y, w, h FROM l WHERE r = 1""",
    "example_list": "SELECT 0 AS part, n_nationkey AS n, n_name, 'cached locally' AS note FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 1, n_nationkey, n_name, 'known' FROM nation",
    "memo_measures": "WITH k AS (SELECT DISTINCT user_id, event_type FROM events), m AS (SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events WHERE value > 60 GROUP BY 1, 2) SELECT k.user_id, k.event_type, coalesce(n, 0) AS n, coalesce(most, -1.0) AS most FROM k LEFT JOIN m ON k.user_id = m.user_id AND k.event_type = m.event_type",
    "rule_selection": "SELECT p_partkey AS id FROM part WHERE p_size % 2 <> 0",
    "rule_all_selected": "SELECT 'all' AS what, true AS all_selected UNION ALL SELECT 'some', count(*) = 0 FROM part WHERE p_size % 2 <> 0 AND p_partkey % 10 = 1",
    "rules_in_order": "SELECT 0 AS src, cast(r_regionkey AS BIGINT) AS ord, 'region-' || r_regionkey AS id, r_name AS pattern FROM region UNION ALL SELECT 1, n_nationkey, 'nation-' || n_nationkey, n_name FROM nation UNION ALL SELECT 2, s_suppkey, 'supplier-' || s_suppkey, s_name FROM supplier",
    "walked_runs": f"WITH {RUNS_SQL} SELECT page_id, cast(i AS INTEGER) AS run_no, runs[i + 1] AS text FROM (SELECT page_id, runs, unnest(range(0, len(runs))) AS i FROM runs)",
}

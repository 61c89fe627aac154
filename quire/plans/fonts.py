"""Queries of codes, glyphs and fonts: documents' characters stand for glyph uses, the language for the font.

The queries of these with a SQL twin read conversations, the role for the font, as their twins do; those named _documents
read all characters of all documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fonts
from ..sources.documents import table


def _uses(spark, d):
    """Characters of conversations: the role is the font, the glyph the code modulo 211, seq is conversation, turn and place."""
    rows = table(spark, d, "conversations").select(F.col("role").alias("font_key"), F.col("conv_id").alias("page_no"), "turn", "text")
    each = rows.select("font_key", "page_no", "turn", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    return _coded(each, F.struct("page_no", "turn", "pos"))


def _document_uses(spark, d):
    """Characters of documents: the language is the font, seq counts over each whole text."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("font_key"), F.col("doc_id").alias("page_no"), "text")
    each = rows.select("font_key", "page_no", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    return _coded(each, F.col("page_no").cast("long") * (1 << 31) + F.col("pos"))


def _coded(each, seq):
    code = F.ascii("ch")  # the code point
    return each.select("font_key", "page_no", seq.alias("seq"), code.alias("ucs"), F.pmod(code * 7, F.lit(211)).cast("int").alias("gid"))


def _spelled(found):
    """found with the place where it was first seen as text."""
    return found.withColumn("ord", F.concat_ws(":", "ord.page_no", "ord.turn", "ord.pos"))


def first_code_wins(spark, d):
    return _spelled(fonts.first_codes(_uses(spark, d), ["font_key", "gid"]))


def font_pairs(spark, d):
    return _spelled(fonts.pairs(_uses(spark, d)))


def font_coverage(spark, d):
    uses = _uses(spark, d)
    known = uses.where("font_key = 'user'").select(F.explode(F.array(F.lit("assistant"), F.lit("system"))).alias("font_key"), F.col("ucs").alias("code")).distinct()
    found = fonts.coverage(uses, known)
    return found.select("font_key", "total", "missing", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def glyph_codes(spark, d):
    return fonts.codes_of(_uses(spark, d)).select("font_key", "gid", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def code_ranges(spark, d):
    return _ranges(_uses(spark, d))


def _ranges(uses):
    codes = uses.select("font_key", F.col("ucs").alias("code")).distinct()
    rank = F.dense_rank().over(Window.partitionBy("font_key").orderBy("code"))
    return fonts.ranges(codes.withColumn("gid", (F.col("code") + F.floor(rank / 20)).cast("int")))


def first_code_wins_documents(spark, d):
    return fonts.first_codes(_document_uses(spark, d), ["font_key", "gid"])


def font_pairs_documents(spark, d):
    return fonts.pairs(_document_uses(spark, d))


def font_coverage_documents(spark, d):
    """What other languages use beyond the characters of English, and all of English."""
    uses = _document_uses(spark, d)
    known = uses.where("font_key = 'en'").select(F.col("ucs").alias("code")).distinct()
    other = table(spark, d, "documents").where("lang <> 'en'").select(F.col("lang").alias("font_key")).distinct()
    found = fonts.coverage(uses, other.crossJoin(known))
    return found.select("font_key", "total", "missing", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def glyph_codes_documents(spark, d):
    return fonts.codes_of(_document_uses(spark, d)).select("font_key", "gid", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def code_ranges_documents(spark, d):
    return _ranges(_document_uses(spark, d))


def list_expansion(spark, d):
    kind = F.col("event_type")
    number = F.when(kind == "signup", F.col("event_id"))
    return fonts.numbered(table(spark, d, "events"), ["user_id"], "event_id", number, F.when(kind == "error", "").otherwise(kind))


def first_registrations(spark, d):
    return fonts.first_registration(table(spark, d, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice")


def named_glyphs(spark, d):
    parts = table(spark, d, "part")
    glyphs = parts.select(F.col("p_brand").alias("font"), F.col("p_type").alias("name"), F.col("p_partkey").alias("gid"))
    uses = parts.select("p_partkey", F.col("p_brand").alias("font"), F.col("p_type").alias("name"))
    return fonts.named_glyph(uses, glyphs).select("p_partkey", "gid", fonts.entry_key(F.when(F.col("p_partkey") % 2 == 0, F.col("font")), F.col("name")).alias("entry"))


def page_letters(spark, d):
    uses = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("font_key"), F.pmod("l_partkey", F.lit(97)).cast("int").alias("gid"), F.pmod("l_orderkey", F.lit(50)).alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_quantity") > 40, F.col("l_suppkey").cast("string")).alias("letters"))
    return fonts.letters(uses)


def glyph_assign(spark, d):
    uses = _document_uses(spark, d).select("font_key", F.col("seq").alias("ord"), F.col("ucs").alias("code"), "gid")
    return fonts.assign(uses.withColumn("letters", F.when(F.col("gid") == 5, "fi")))


def outline_boxes(spark, d):
    points = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") - 25).alias("x"), F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("y"))
    return fonts.outline_bounds(points, ["l_orderkey"])


def face_metrics(spark, d):
    boxes = outline_boxes(spark, d).withColumn("font_key", F.pmod("l_orderkey", F.lit(7))).withColumn("advance", F.col("l_orderkey"))
    return fonts.face_metrics(boxes)


def outline_deltas(spark, d):
    points = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("x"), F.pmod("event_id", F.lit(100)).cast("double").alias("y"))
    return fonts.deltas(points, ["user_id"], "event_id", 2.0)


QUERIES = [first_code_wins, font_pairs, font_coverage, glyph_codes, code_ranges, first_code_wins_documents, font_pairs_documents, font_coverage_documents, glyph_codes_documents, code_ranges_documents, list_expansion, first_registrations, named_glyphs, page_letters, glyph_assign, outline_boxes, face_metrics, outline_deltas]
USES = """raw AS (SELECT role AS font_key, conv_id AS page_no, turn, string_split(text, '') AS cs FROM conversations WHERE text <> ''),
e AS (SELECT font_key, page_no, {'p': page_no, 't': turn, 'i': i} AS seq, cast(unicode(cs[i + 1]) AS INTEGER) AS ucs FROM (SELECT *, unnest(range(0, len(cs))) AS i FROM raw)),
uses AS (SELECT *, cast(ucs * 7 % 211 AS INTEGER) AS gid FROM e)"""
SQL = {
    "first_code_wins": f"WITH {USES}, m AS (SELECT font_key, gid, arg_min(ucs, seq) AS code, min(seq) AS o FROM uses GROUP BY font_key, gid) SELECT font_key, gid, code, o.p || ':' || o.t || ':' || o.i AS ord FROM m",
    "font_pairs": f"WITH {USES}, m AS (SELECT font_key, ucs AS code, gid, min(seq) AS o FROM uses GROUP BY font_key, ucs, gid) SELECT font_key, code, gid, o.p || ':' || o.t || ':' || o.i AS ord FROM m",
    "font_coverage": f"""WITH {USES}, k AS (SELECT DISTINCT ucs FROM uses WHERE font_key = 'user'), m AS (SELECT u.font_key, u.ucs, u.font_key = 'user' OR k.ucs IS NULL AS gone FROM uses u LEFT JOIN k ON u.ucs = k.ucs),
      t AS (SELECT font_key, count(*) AS total, cast(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM m GROUP BY font_key),
      g AS (SELECT font_key, string_agg(cast(ucs AS VARCHAR), ',' ORDER BY ucs) AS codes FROM (SELECT DISTINCT font_key, ucs FROM m WHERE gone) GROUP BY font_key)
      SELECT t.font_key, total, missing, coalesce(codes, '') AS codes FROM t LEFT JOIN g ON t.font_key = g.font_key""",
    "glyph_codes": f"WITH {USES}, g AS (SELECT DISTINCT font_key, gid, ucs FROM uses) SELECT font_key, gid, string_agg(cast(ucs AS VARCHAR), ',' ORDER BY ucs) AS codes FROM g GROUP BY font_key, gid",
    "code_ranges": f"""WITH {USES}, c AS (SELECT DISTINCT font_key, ucs AS code FROM uses), g AS (SELECT *, code + row_number() OVER (PARTITION BY font_key ORDER BY code) // 20 AS gid, code - row_number() OVER (PARTITION BY font_key ORDER BY code) AS island FROM c)
      SELECT font_key, min(code) AS first, max(code) AS last, cast(min(gid) AS INTEGER) AS first_gid FROM g GROUP BY font_key, island, gid - code""",
    "list_expansion": """WITH m AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS num, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS name, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events),
      c AS (SELECT *, max(num) OVER (PARTITION BY user_id, part) + count(CASE WHEN num IS NULL THEN 1 END) OVER (PARTITION BY user_id, part ORDER BY event_id) - 1 AS code FROM m)
      SELECT user_id, event_id, name, code FROM c WHERE num IS NULL AND part > 0 AND name <> ''""",
    "first_registrations": """WITH e AS (SELECT p_brand AS name, p_retailprice, 0 AS k, p_partkey FROM part UNION ALL SELECT p_type, p_retailprice, 1, p_partkey FROM part),
      r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_retailprice, k, p_partkey) AS n FROM e WHERE name IS NOT NULL) SELECT name, p_partkey FROM r WHERE n = 1""",
    "named_glyphs": """WITH g AS (SELECT p_brand AS font, p_type AS name, min(p_partkey) AS gid FROM part GROUP BY 1, 2)
      SELECT p_partkey, g.gid, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'named' || chr(0) || p_type END AS entry FROM part JOIN g ON p_brand = font AND p_type = name""",
    "page_letters": """WITH u AS (SELECT l_returnflag AS font_key, cast(l_partkey % 97 AS INTEGER) AS gid, l_orderkey % 50 AS page_no, l_orderkey * 10 + l_linenumber AS seq, cast(l_suppkey AS VARCHAR) AS letters FROM lineitem WHERE l_quantity > 40),
      p AS (SELECT font_key, gid, page_no, arg_max(letters, seq) AS letters FROM u GROUP BY 1, 2, 3) SELECT font_key, gid, arg_min(letters, page_no) AS letters FROM p GROUP BY 1, 2""",
    "outline_boxes": "SELECT l_orderkey, coalesce(min(l_quantity - 25), 0) AS min_x, coalesce(max(l_quantity - 25), 0) AS max_x, coalesce(min(CASE WHEN l_tax > 0.01 THEN l_discount END), 0) AS min_y, coalesce(max(CASE WHEN l_tax > 0.01 THEN l_discount END), 0) AS max_y FROM lineitem GROUP BY l_orderkey",
    "face_metrics": """WITH b AS (SELECT l_orderkey, min(l_quantity - 25) AS x0, max(l_quantity - 25) AS x1, coalesce(min(CASE WHEN l_tax > 0.01 THEN l_discount END), 0) AS y0, coalesce(max(CASE WHEN l_tax > 0.01 THEN l_discount END), 0) AS y1 FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey % 7 AS font_key, greatest(max(y1), 0.7) AS ascender, least(min(y0), -0.2) AS descender, cast(floor(min(x0)) AS BIGINT) AS "left", cast(floor(min(y0)) AS BIGINT) AS bottom, cast(ceil(max(x1)) AS BIGINT) AS "right", cast(ceil(max(y1)) AS BIGINT) AS top, cast(sum(l_orderkey) // count(*) AS BIGINT) AS advance FROM b GROUP BY l_orderkey % 7""",
    "outline_deltas": """WITH p AS (SELECT user_id, event_id, cast(round(value * 2) AS BIGINT) AS x, cast(round(event_id % 100 * 2.0) AS BIGINT) AS y FROM events)
      SELECT user_id, event_id, x - coalesce(lag(x) OVER w, 0) AS dx, y - coalesce(lag(y) OVER w, 0) AS dy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
}

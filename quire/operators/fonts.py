"""Codes, glyphs and coverage: first-wins and last-wins reductions, range compression, expansion, code assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.workers import cut

#: The private-use area; fixed values.
PRIVATE_FIRST, PRIVATE_LAST = 0xE000, 0xF8FF
#: Ligature codes by letters; fixed by Unicode, the lower code where two spell the same.
LIGATURE_CODE = {letters: ord(c) for c, letters in reversed(tx.LIGATURES.items())}


def usable(code: Column) -> Column:
    return (code > 0) & (code <= 0x10FFFF) & (code != 0xFFFD)


def first_codes(uses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, ord): the first usable code of each key, and where the key was first seen, usable or not.

    Uses are brought down to a row per key and code by the least seq, hashed where seq is a number; only these few rows are
    compared as pairs, for which Spark has to sort."""
    least = uses.groupBy(*keys, "ucs").agg(F.min("seq").alias("seq"))
    return least.groupBy(*keys).agg(F.min(F.when(usable(F.col("ucs")), F.struct("seq", "ucs"))).alias("f"), F.min("seq").alias("ord")).select(*keys, F.col("f.ucs").alias("code"), "ord")


def pairs(uses: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, code, gid, ord): distinct pairs in the order they were first seen."""
    return uses.where(usable(F.col("ucs"))).groupBy(font, F.col("ucs").alias("code"), "gid").agg(F.min("seq").alias("ord"))


def letters(uses: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, gid, letters): the last letters within a page, of the first page that has any."""
    by_page = uses.where("letters is not null").groupBy(font, "gid", "page_no").agg(F.max_by("letters", "seq").alias("letters"))
    return by_page.groupBy(font, "gid").agg(F.min_by("letters", "page_no").alias("letters"))


def letters_by_name(uses: DataFrame, names: DataFrame, font: str = "font_key") -> DataFrame:
    """letters, where a glyph that a page draws without any takes those that the document's own names (font, gid, letters)
    give it; the first page with either wins."""
    by_page = uses.groupBy(font, "gid", "page_no").agg(F.max_by("letters", F.when(F.col("letters").isNotNull(), F.col("seq"))).alias("own"))
    named = names.groupBy(font, "gid").agg(F.min("letters").alias("named"))
    either = by_page.join(named, [font, "gid"], "left").withColumn("letters", F.coalesce("own", "named")).where("letters is not null")
    return either.groupBy(font, "gid").agg(F.min_by("letters", "page_no").alias("letters"))


def coverage(uses: DataFrame, known: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, total, missing, codes): uses of each font, those whose (font, code) is not known, and the missing codes,
    sorted; most used first."""
    seen = uses.groupBy(font, "ucs").agg(F.count(F.lit(1)).alias("n"))
    marked = seen.join(known.select(font, F.col("code").alias("ucs"), F.lit(True).alias("there")), [font, "ucs"], "left")
    gone = F.col("there").isNull()
    return marked.groupBy(font).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("missing"), F.sort_array(F.collect_set(F.when(gone, F.col("ucs")))).alias("codes")).orderBy(F.desc("total"), font)


def codes_of(uses: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, gid, codes): distinct codes, sorted. Uses are made distinct by hashing; lists are collected of few rows. (Collected
    as sets, Spark would leave the first step out and sort uses.)"""
    seen = uses.select(font, "gid", "ucs").distinct()
    return seen.groupBy(font, "gid").agg(F.sort_array(F.collect_list("ucs")).alias("codes"))


def ranges(codes: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, first, last, first_gid): runs of consecutive codes whose glyphs follow at a constant distance."""
    w = Window.partitionBy(font).orderBy("code")
    island = codes.withColumn("island", F.col("code") - F.row_number().over(w)).withColumn("delta", F.col("gid") - F.col("code"))
    return island.groupBy(font, "island", "delta").agg(F.min("code").alias("first"), F.max("code").alias("last"), F.min_by("gid", "code").alias("first_gid")).drop("island", "delta")


def numbered(items: DataFrame, keys: list[str], order: str, number: Column, name: Column) -> DataFrame:
    """(keys, order, name, code): a number sets the code and each following name takes it and counts on; names before any
    number drop out, an empty name still counts."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = items.select(*keys, order, number.alias("_number"), name.alias("_name")).withColumn("_part", F.count("_number").over(run))
    base = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    code = F.first("_number", ignorenulls=True).over(base) + F.count(F.when(F.col("_number").isNull(), 1)).over(base) - 1
    return marked.withColumn("code", code).where("_number is null and _part > 0 and _name <> ''").select(*keys, order, F.col("_name").alias("name"), "code")


def first_registration(rows: DataFrame, names: list[str], value: str, order: str) -> DataFrame:
    """(name, value): the first row to register a name under any of the columns, an earlier column going first in a row."""
    each = rows.select(order, value, F.posexplode(F.array(*names)).alias("_p", "name"))
    return each.where("name is not null").groupBy("name").agg(F.min(F.struct(order, "_p", value)).alias("f")).select("name", F.col(f"f.{value}").alias(value))


def named_glyph(uses: DataFrame, glyphs: DataFrame) -> DataFrame:
    """uses (font, name) with the gid of the name's first occurrence in glyphs (font, name, gid)."""
    first = glyphs.groupBy("font", "name").agg(F.min("gid").alias("gid"))
    return uses.join(first, ["font", "name"], "left")


def entry_key(program: Column, name: Column) -> Column:
    """The key of a font's plan: its program, else its name."""
    return F.coalesce(program, F.concat(F.lit("named\x00"), name))


def ligature_rules(rules: DataFrame, font: str = "font_key") -> DataFrame:
    """Distinct rules (font, first, rest, by) in the order a shaper reads them: by first glyph, longest first, then glyph."""
    w = Window.partitionBy(font).orderBy("first", F.desc(F.size("rest")), "by", "rest")
    return rules.distinct().withColumn("ord", F.row_number().over(w) - 1)


def assign(seen: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, gid, code): a code for each glyph of each font.

    seen: font, ord, code, gid, letters (null for most). Pairs in first-seen order take free codes, glyphs with letters
    aside, a later pair replacing a glyph's earlier code; letters take their ligature's code if it is free; the rest, by
    glyph, take private-use codes until they run out. A glyph that has neither a usable code nor letters gets none. What is
    taken depends on all that came before, so a font's distinct (glyph, code, letters) are assigned together in Python;
    glyphs number 65,536 at most."""
    kind = seen.schema[font].dataType.simpleString()

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ord", "code", "gid"], kind="stable")
        spelled = pdf.dropna(subset=["letters"]).drop_duplicates("gid")
        letters_of = dict(zip(spelled["gid"], spelled["letters"], strict=True))
        taken: set[int] = set()
        code_of: dict[int, int] = {}
        for code, gid in pdf[["code", "gid"]].drop_duplicates().itertuples(index=False):
            if gid not in letters_of and code not in taken and 0 < code <= 0x10FFFF and code != 0xFFFD:
                code_of[gid] = code
                taken.add(code)
        for gid, text in letters_of.items():
            code = LIGATURE_CODE.get(text)
            if code is not None and code not in taken:
                code_of[gid] = code
                taken.add(code)
        spare = (c for c in range(PRIVATE_FIRST, PRIVATE_LAST + 1) if c not in taken)
        named = {*letters_of, *(g for c, g in zip(pdf["code"], pdf["gid"], strict=True) if 0 < c <= 0x10FFFF and c != 0xFFFD)}
        for gid in sorted(named - {*code_of}):
            code = next(spare, None)
            if code is None:
                break
            code_of[gid] = code
        return pd.DataFrame({font: pdf[font].iloc[0], "gid": [int(g) for g in code_of], "code": [int(c) for c in code_of.values()]})

    least = seen.groupBy(font, "gid", "code", "letters").agg(F.min("ord").alias("ord"))  # bounds a group by the font, not by its uses
    return least.groupBy(font).applyInPandas(one, f"{font} {kind}, gid int, code int")


def ligatures(cmap: DataFrame, spelled: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, gid, parts): rules for glyphs with letters (font, gid, letters) whose every letter has a glyph in cmap (font,
    code, gid), none twice and none the ligature itself."""
    each = spelled.where(F.length("letters") > 1).select(font, "gid", "letters", F.posexplode(F.filter(F.split("letters", ""), lambda c: c != "")).alias("pos", "ch"))
    found = each.withColumn("code", F.ascii("ch")).join(cmap.select(font, "code", F.col("gid").alias("part")), [font, "code"], "left")
    done = found.groupBy(font, "gid").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"), F.count("part").alias("have"), F.first(F.length("letters")).alias("need"), F.countDistinct("part").alias("kinds"), F.max(F.col("part") == F.col("gid")).alias("own"))
    return done.where("have = need and kinds = need and not own").select(font, "gid", F.col("p.part").alias("parts"))


def outline_bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of outline points (keys, x, y; x and y null for an empty outline), zeros for an empty one."""
    return points.groupBy(*keys).agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))))


def face_metrics(bounds: DataFrame, font: str = "font_key") -> DataFrame:
    """Metrics of a face from its glyphs' bounds and advances: ascender 0.7 at least, descender -0.2 at most."""
    return bounds.groupBy(font).agg(
        F.greatest(F.max("max_y"), F.lit(0.7)).alias("ascender"), F.least(F.min("min_y"), F.lit(-0.2)).alias("descender"), F.floor(F.min("min_x")).alias("left"), F.floor(F.min("min_y")).alias("bottom"),
        F.ceil(F.max("max_x")).alias("right"), F.ceil(F.max("max_y")).alias("top"), F.expr("sum(advance) div count(advance)").alias("advance"),
    )


def deltas(points: DataFrame, keys: list[str], order: str, scale: float) -> DataFrame:
    """Coordinates scaled, rounded, and written as differences to the point before."""
    w = Window.partitionBy(*keys).orderBy(order)
    x, y = (F.round(F.col(c) * scale).cast("long") for c in ("x", "y"))
    return points.select(*keys, order, (x - F.coalesce(F.lag(x).over(w), F.lit(0))).alias("dx"), (y - F.coalesce(F.lag(y).over(w), F.lit(0))).alias("dy"))


#: How deep resources may be nested; a fixed value.
MAX_NESTING = 6


def resource_fonts(roots: DataFrame, inner: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, resource, depth, font): font entries (resource, font) of all resources that pages reach.

    roots: page, resource; inner: resource, child. A resource is read once a page, at its least depth, so circles end; one
    equi-join a level, MAX_NESTING levels at most."""
    level = cut(roots.select("page", "resource").where("resource is not null").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, MAX_NESTING + 1):
        below = level.select("page", "resource").join(inner, "resource").select("page", F.col("child").alias("resource")).where("resource is not null").distinct()
        level = cut(below.join(seen.select("page", "resource"), ["page", "resource"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.join(entries, "resource").select("page", "resource", "depth", "font")


def rule_assets(sheets: DataFrame, key: str) -> DataFrame:
    """(key, n, family, css): a stylesheet (key, css) as one asset per rule; a rule is a line that is not blank, its family
    the quoted name, or the whole rule where there is none."""
    rules = F.filter(F.split("css", "\n", -1), lambda r: ~r.rlike(r"(?U)^\s*$"))
    each = sheets.select(key, F.posexplode(rules).alias("n", "css"))
    family = F.regexp_extract("css", r"font-family:\s*'([^']+)'", 1)
    return each.select(key, "n", F.when(family == "", F.col("css")).otherwise(family).alias("family"), "css")


def served(assets: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """(key, n, family, css, format, bytes, glyphs): assets with their face (key, ord, family, uri, url, format, bytes,
    glyphs) - the last of a name - whose address takes the place of the quoted name in the rule, once; an asset without a
    face stays as it is."""
    columns = ("uri", "url", "format", "bytes", "glyphs")
    last = faces.groupBy(key, "family").agg(F.max_by(F.struct(*columns), "ord").alias("face"))
    both = assets.join(last, [key, "family"], "left")
    quoted = F.concat(F.lit('"'), F.col("face.uri"), F.lit('"'))
    at = F.instr("css", quoted)
    put = F.concat(F.substring("css", F.lit(1), at - 1), F.lit('"'), F.col("face.url"), F.lit('"'), F.substring("css", at + F.length(quoted), F.length("css")))
    return both.select(
        key, "n", "family", F.when(at > 0, put).otherwise(F.col("css")).alias("css"), F.coalesce("face.format", F.lit("woff")).alias("format"),
        F.coalesce("face.bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("face.glyphs", F.lit(0)).cast("long").alias("glyphs"),
    )


def directory(tables: DataFrame, font: str = "font_key") -> DataFrame:
    """(font, tag, ord, offset, length, tables, search_range, selector, shift): a font file's tables (font, tag, length) sorted
    by tag, each behind the header and those before it, padded to four bytes. A font has a few dozen tables."""
    w = Window.partitionBy(font).orderBy("tag")
    n = F.count(F.lit(1)).over(Window.partitionBy(font))
    selector = F.length(F.bin(n)) - 1
    padded = F.ceil(F.col("length") / 4) * 4
    before = F.coalesce(F.sum(padded).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.lit(16) * F.pow(F.lit(2), selector).cast("long")
    return tables.select(
        font, "tag", (F.row_number().over(w) - 1).alias("ord"), (F.lit(12) + n * 16 + before).cast("long").alias("offset"), F.col("length").cast("long").alias("length"), n.alias("tables"),
        span.alias("search_range"), selector.alias("selector"), (n * 16 - span).alias("shift"),
    )

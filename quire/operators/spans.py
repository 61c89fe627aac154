"""Islands: stretches of one style, space marks, and joins between characters, by windows over explicit ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import let


def styled(items: DataFrame, page: list[str], seq: str = "seq", line: str = "line", style: str = "style") -> DataFrame:
    """(page, line, span_no, text, n, x, y, width, height): a new span at each change of style and at each line.

    items: page, line, seq, ch, style, x, y, width, height."""
    w = Window.partitionBy(*page, line).orderBy(seq)
    fresh = (F.row_number().over(w) == 1) | ~F.lag(style).over(w).eqNullSafe(F.col(style))
    each = items.withColumn("fresh", fresh).withColumn("span_no", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return each.groupBy(*page, line, "span_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "ch"))), lambda s: s["ch"]), "").alias("text"), F.count(F.lit(1)).alias("n"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    )


def is_space(ch: Column) -> Column:
    return ch.rlike(f"^{tx.PAGE_BLANK}$")


def space_marks(chars: DataFrame, page: list[str]) -> DataFrame:
    """(page, seq, kind, target): a break where a line changes between two characters that are no spaces, and for each
    space the first later character that is none, on whatever line; spaces with nothing after them leave no mark.

    chars: page, seq, line, ch, seq ascending over the page."""
    w = Window.partitionBy(*page).orderBy("seq")
    space = is_space(F.col("ch"))
    # seen from the end: a frame that begins at the row and has no end is read anew for each row
    back = Window.partitionBy(*page).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(~space, F.col("seq")), ignorenulls=True).over(back)
    marked = chars.select(
        *page, "seq", space.alias("_space"), after.alias("_after"), (F.lag("line").over(w) != F.col("line")).alias("_turn"), F.lag(space).over(w).alias("_before"),
    )
    breaks = marked.where("_turn and not _space and not _before").select(*page, "seq", F.lit("break").alias("kind"), F.col("seq").alias("target"))
    spaces = marked.where("_space and _after is not null").select(*page, "seq", F.lit("space").alias("kind"), F.col("_after").alias("target"))
    return breaks.unionByName(spaces)


#: The characters of PAGE_BLANK, and the line feed.
BLANKS = "\t \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
GAP = BLANKS + "\n"


def mark_sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, n, targets): how many marks of each kind `space_marks` finds in a text, and the sum of their targets, places
    counted without line feeds. All in the text's row, without an exchange, in time linear in the text: the text is cut where a
    stretch begins, and a gap's marks follow from its blanks, its line feeds and the place of the stretch behind it."""
    words = F.split(text, f"(?<=[{GAP}])(?=[^{GAP}])", -1)
    sizes = F.transform(words, lambda w: F.struct(F.length(w).alias("all"), F.length(F.rtrim(w, F.lit(GAP))).alias("stretch"), F.length(F.replace(w, F.lit("\n"), F.lit(""))).alias("chars")))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), zero.alias("blanks"), F.lit(False).alias("turn"), zero.alias("spaces"), zero.alias("ahead"), zero.alias("breaks"), zero.alias("places"))

    def step(s: Column, w: Column) -> Column:
        there = w["stretch"] > 0
        turns = (there & s["turn"] & (s["blanks"] == 0) & (s["at"] > 0)).cast("long")
        spaces = F.when(there, s["blanks"]).otherwise(0)
        return F.struct(
            (s["at"] + w["chars"]).alias("at"), (w["chars"] - w["stretch"]).cast("long").alias("blanks"), (w["all"] > w["chars"]).alias("turn"),
            (s["spaces"] + spaces).alias("spaces"), (s["ahead"] + spaces * s["at"]).alias("ahead"), (s["breaks"] + turns).alias("breaks"), (s["places"] + turns * s["at"]).alias("places"),
        )

    mark = lambda kind, n, targets: F.struct(F.lit(kind).alias("kind"), n.alias("n"), targets.alias("targets"))
    found = F.aggregate(sizes, start, step, lambda s: F.array(mark("break", s["breaks"], s["places"]), mark("space", s["spaces"], s["ahead"])))
    return rows.select(*keys, F.inline(found)).where("n > 0")


def joins(chars: DataFrame, pairs: DataFrame, page: list[str]) -> DataFrame:
    """pairs (page, from, to) with `joins`: both there, to after from, and no space or line change from one to the other.

    Prefix counts turn the range test into two equi-joins."""
    w = Window.partitionBy(*page).orderBy("seq")
    bad = is_space(F.col("ch"))
    turn = F.coalesce(F.lag("line").over(w) != F.col("line"), F.lit(False))
    flags = chars.select(*page, "seq", bad.cast("int").alias("_bad"), turn.cast("int").alias("_turn"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = flags.select(*page, "seq", "_bad", F.sum("_bad").over(run).alias("_bads"), F.sum("_turn").over(run).alias("_turns"))
    a = counted.select(*page, F.col("seq").alias("from"), (F.col("_bads") - F.col("_bad")).alias("b0"), F.col("_turns").alias("t0"))
    b = counted.select(*page, F.col("seq").alias("to"), F.col("_bads").alias("b1"), F.col("_turns").alias("t1"))
    both = pairs.join(a, [*page, "from"], "left").join(b, [*page, "to"], "left")
    return both.select(*page, "from", "to", F.coalesce((F.col("to") > F.col("from")) & (F.col("b1") == F.col("b0")) & (F.col("t1") == F.col("t0")), F.lit(False)).alias("joins"))


#: A stretch without blanks, or one blank or line feed.
PIECE = f"[^\\n{tx.PAGE_BLANK[1:-1]}]+|[\\n{tx.PAGE_BLANK[1:-1]}]"


def stretches(text: Column) -> Column:
    """For each character of a text but its line feeds the number of the stretch that it lies in; null for a space. Stretches end
    at spaces and line feeds."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    none = F.array().cast("array<int>")

    def numbers(piece: Column, n: Column) -> Column:
        one = F.when(piece == "\n", none).when(is_space(piece), F.array(F.lit(None).cast("int"))).otherwise(F.array(n))
        return F.when(F.length(piece) > 1, F.array_repeat(n, F.length(piece))).otherwise(one)

    return F.flatten(F.transform(pieces, numbers))


def text_joins(rows: DataFrame, keys: list[str], text: str, pairs: Column) -> DataFrame:
    """(keys, pairs): an array of (from, to), places in the text counted without line feeds, with `joins`: both there, to after
    from, and no space or line change from one to the other. All in the text's row, without an exchange, in time linear in
    text and pairs; null if the text or its pairs are null."""
    held = let(stretches(F.col(text)), lambda at: F.transform(pairs, lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"), _together(at, p).alias("joins"))))
    return rows.select(*keys, F.when(F.col(text).isNotNull(), held).alias("pairs"))


def _together(at: Column, p: Column) -> Column:
    there = (p["from"] >= 0) & (p["to"] > p["from"])
    return F.coalesce(there & (F.get(at, p["from"].cast("int")) == F.get(at, p["to"].cast("int"))), F.lit(False))


def join_sums(rows: DataFrame, keys: list[str], text: str, ahead: int) -> DataFrame:
    """(keys, n, places): how many characters of a text `text_joins` joins with the one `ahead` places after them, and the sum of
    their places, counted without line feeds. A stretch of L characters has its first L - ahead so joined, so a stretch costs one
    step however long it is, and no pair is made. All in the text's row, without an exchange; null texts have nulls."""
    plain = F.col(text)
    for blank in BLANKS.replace(" ", ""):  # one blank for all: texts are then cut without a pattern
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    zero = F.lit(0).cast("long")
    state = lambda at, n, places: F.struct(at.alias("at"), n.alias("n"), places.alias("places"))

    def stretch(s: Column, size: Column) -> Column:
        more = F.greatest(size - ahead, F.lit(0)).cast("long")
        return state(s["at"] + size + 1, s["n"] + more, s["places"] + more * s["at"] + F.shiftright(more * (more - 1), 1))

    def line(s: Column, own: Column) -> Column:
        sizes = F.transform(F.split(own, " ", -1), lambda w: F.length(w))
        return F.aggregate(sizes, s, stretch, lambda e: state(e["at"] - 1, e["n"], e["places"]))  # no blank after the last one

    found = F.aggregate(F.split(plain, "\n", -1), state(zero, zero, zero), line)
    return rows.select(*keys, found.alias("_found")).select(*keys, "_found.n", "_found.places")


def broken_runs(items: DataFrame, page: list[str]) -> DataFrame:
    """items (page, seq, entry, paint, matrix, markup, letters, faded) with run_no and group_no: a run ends where entry, paint
    or matrix changes or markup came between; in a run, items of several letters stand alone, others group by fading."""
    w = Window.partitionBy(*page).orderBy("seq")
    same = F.lit(True)
    for c in ("entry", "paint", "matrix"):
        same &= F.lag(c).over(w).eqNullSafe(F.col(c))
    fresh = (F.row_number().over(w) == 1) | ~same | F.coalesce(F.col("markup"), F.lit(False))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    first = items.withColumn("fresh", fresh)
    runs = first.withColumn("run_no", F.sum(F.col("fresh").cast("int")).over(run) - 1)
    inner = Window.partitionBy(*page, "run_no").orderBy("seq")
    cut = (F.row_number().over(inner) == 1) | (F.col("letters") > 1) | (F.lag("letters").over(inner) > 1) | ~F.lag("faded").over(inner).eqNullSafe(F.col("faded"))
    marked = runs.withColumn("cut", cut)
    return marked.withColumn("group_no", F.sum(F.col("cut").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("fresh", "cut")


def page_stats(items: DataFrame, page: list[str]) -> DataFrame:
    """Counters of each page from what it draws: items (page, kind, face, run_no, faded), kind being glyph, space, image or
    shade. A glyph with a face is text, one without an outline; faded counts text alone."""
    kind = lambda k: F.col("kind") == k
    text = kind("glyph") & F.col("face").isNotNull()
    return items.groupBy(*page).agg(
        F.count_if(kind("glyph")).alias("glyphs"), F.count_if(text).alias("as_text"), F.count_if(kind("glyph") & F.col("face").isNull()).alias("as_outlines"),
        F.countDistinct(F.when(text, F.col("run_no"))).alias("runs"), F.count_if(kind("space")).alias("spaces"), F.countDistinct(F.when(text, F.col("face"))).alias("fonts"),
        F.count_if(kind("image")).alias("images"), F.count_if(kind("shade")).alias("shades"), F.count_if(text & F.col("faded")).alias("faded"),
    )

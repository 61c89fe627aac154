from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import arrays
from quire.operators import charmaps, crop, fixation, fonts, gradients, layout, links, memory, rules, search, spans, spatial

PAGE = (612.0, 792.0)


def runs(spark, *pages):
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(pages)], "page_id int, runs array<string>")


@pytest.mark.parametrize(
    ("page", "query", "want"),
    [(["Atten", "tion Is All"], "attention is", [0]), (["aXaaXaaa"], "aa", [2, 5]), (["a b"], "ab", []), (["A & B"], "a&b", [0]), (["x"], " ", []), ([], "a", []), (["a\\Eb\\E"], "\\E", [1, 4])],
)
def test_starts(spark, page, query, want):
    assert search.page_hits(runs(spark, page), query).first()["starts"] == want


def test_truncation(spark):
    assert search.state(runs(spark, ["ab" * 1500]), "ab").first().asDict() == {"listed": 1000, "pages": 1, "truncated": False}
    assert search.state(runs(spark, ["ab" * 1000], ["ab"]), "ab").first().asDict() == {"listed": 1000, "pages": 2, "truncated": True}
    assert search.hits(runs(spark, ["th"], ["e"]), "the").count() == 0


def test_hit_runs_and_steps(spark):
    found = search.hit_runs(runs(spark, ["Atten", "tion", "x"]), "ttentio").collect()
    assert sorted(r["run_no"] for r in found) == [0, 1]
    s = spark.range(1).select(search.step(F.lit(-1), 1, F.lit(3)).alias("a"), search.step(F.lit(-1), -1, F.lit(3)).alias("b"), search.step(F.lit(2), 1, F.lit(3)).alias("c"), search.step(F.lit(0), -1, F.lit(3)).alias("d")).first()
    assert list(s) == [0, 2, 0, 2]


def test_bands(spark):
    boxes = [(0.0, 0.0, 10.0, 10.0), (12.0, 1.0, 5.0, 10.0), (0.0, 30.0, 4.0, 10.0)]
    df = spark.createDataFrame([([dict(zip("xywh", b, strict=True)) for b in boxes],)], "b array<struct<x:double,y:double,w:double,h:double>>")
    got = df.select(search.bands(F.col("b")).alias("o")).first()["o"]
    assert [(b["x"], b["y"], b["w"], b["h"]) for b in got] == [(0.0, 0.0, 17.0, 11.0), (0.0, 30.0, 4.0, 10.0)]


@pytest.mark.parametrize(("pattern", "bad"), [("^(", True), ("(?=a)", True), (r"(a)\1", True), ("", True), ("a{1,3}", False), (r"^\d+$", False), (r"\(?=", False)])
def test_validate(pattern, bad):
    assert (rules.validate(pattern) is not None) is bad


@pytest.mark.parametrize(("text", "pattern", "want"), [("see arXiv:1706.03762v7", "arXiv", True), ("See arXiv:x", "^arXiv:", False), ("  42  ", r"^\s*[0-9]+\s*$", True), ("42a", r"^\s*[0-9]+\s*$", False), ("42\n", "^[0-9]+$", False), (" 42", r"^\s42$", True)])
def test_filtered(spark, text, pattern, want):
    assert spark.createDataFrame([(text,)], "t string").select(rules.filtered(F.col("t"), [pattern])).first()[0] is want


def test_rule_lists(spark):
    assert spark.createDataFrame([(" ^a \n\n^a\na{1,3}",)], "t string").select(rules.pattern_list(F.col("t"))).first()[0] == ["^a", "a{1,3}"]
    assert spark.range(1).select(rules.expand(F.lit("^{title}$"), F.lit("A (2+2) study"))).first()[0] == r"^A \(2\+2\) study$"
    got = rules.load_custom([None, "", "^c$", {"id": "custom-1", "pattern": "^d$"}, {"id": "page-number", "pattern": "^e$"}, 7])
    assert [(r["id"], r["pattern"]) for r in got] == [("custom-1", "^c$"), ("custom-2", "^d$"), ("custom-3", "^e$")]
    assert rules.add_custom(got, "^c$")[1] is not None


def test_large_rule_sets_join(spark):
    lines = spark.createDataFrame([("a1",), ("b",), ("",)], "text string")
    many = [f"^x{i}$" for i in range(80)] + ["^a"]
    assert [r["text"] for r in rules.keep(lines, many).collect()] == ["b"]


STAMP, TITLE, NUMBER = ("stamp arXiv", 10.0, 10.0, 80.0, 10.0), ("title", 100.0, 200.0, 300.0, 20.0), ("21", 300.0, 760.0, 10.0, 10.0)


@pytest.mark.parametrize(
    ("boxes", "drawings", "patterns", "want"),
    [
        ([STAMP, TITLE, NUMBER], [], [], None), ([STAMP, TITLE, NUMBER], [], ["arXiv"], (100, 200, 300, 570)), ([STAMP, TITLE, NUMBER], [], ["arXiv", "^[0-9]+$"], (100, 200, 300, 20)),
        ([STAMP, TITLE, NUMBER], [], ["."], None), ([("t", 100.0, 300.0, 50.0, 10.0)], [(50.0, 50.0, 400.0, 100.0)], ["x"], (50, 50, 400, 260)),
        ([("t", 100.0, 300.0, 50.0, 10.0)], [(50.0, 50.0, 400.0, 1.0), (-20.0, 50.0, 100.0, 100.0)], ["x"], (100, 300, 50, 10)), ([("t", -30.0, -40.0, 700.0, 100.0)], [], ["x"], (0, 0, 612, 60)),
        ([("t", 10.0, 10.0, 0.0, 0.0)], [], ["x"], None), ([("t", float("nan"), 1.0, 2.0, 3.0), TITLE], [], ["x"], (100, 200, 300, 20)),
    ],
)
def test_content_box(spark, boxes, drawings, patterns, want):
    s = spark.createDataFrame([(1, *b) for b in boxes], "k int, text string, x double, y double, width double, height double")
    d = spark.createDataFrame([(1, *b) for b in drawings], "k int, x double, y double, width double, height double")
    got = crop.content_box(s, d, patterns, *PAGE, ["k"]).collect()
    assert ([tuple(r)[1:] for r in got] or [None])[0] == want


@pytest.mark.parametrize(("box", "pad", "want"), [((100, 100, 200, 200), 0.0, (100, 100, 200, 200)), ((100, 100, 200, 200), -5.0, (100, 100, 200, 200)), ((100, 100, 200, 200), float("nan"), (100, 100, 200, 200)), ((100, 100, 200, 200), 6.0, (94, 94, 212, 212)), ((2, 2, 608, 788), 6.0, (0, 0, 612, 792))])
def test_padding(spark, box, pad, want):
    df = spark.createDataFrame([tuple(map(float, box))], "x double, y double, width double, height double")
    assert tuple(crop.padded(df, pad, *PAGE).first()) == want


def chars(spark, text):
    out, line = [], 1
    for i, c in enumerate(text.replace("\n", "")):
        out.append((0, i, c))
    breaks = [i - k for k, i in enumerate(i for i, c in enumerate(text) if c == "\n")]
    return spark.createDataFrame([(p, i, 1 + sum(i >= b for b in breaks), c) for p, i, c in out], "p int, seq int, line int, ch string"), line


def test_hit_runs_of_all_hits(spark):
    runs = spark.createDataFrame([(1, ["the "] * 1200)], "page_id long, runs array<string>")
    got = sorted(map(tuple, search.hit_runs(runs, "the").collect()))
    assert got == [(1, 3 * k, k) for k in range(1200)]


def test_space_marks(spark):
    got = spans.space_marks(chars(spark, "a  b\nc d \ne ")[0], ["p"]).collect()
    assert sorted((r["seq"], r["kind"], r["target"]) for r in got) == [(1, "space", 3), (2, "space", 3), (4, "break", 4), (5, "space", 6), (7, "space", 8)]


@pytest.mark.parametrize(("text", "a", "b", "want"), [("Incorporate", 8, 9, True), ("Incorporate", 0, 1, True), ("Incorpora ted", 8, 10, False), ("ab\ncd", 1, 2, False), ("ab", 0, 9, False), ("abcde", 4, 2, False), ("abc", 1, 1, False)])
def test_joins(spark, text, a, b, want):
    pairs = spark.createDataFrame([(0, a, b)], "p int, from int, to int")
    assert spans.joins(chars(spark, text)[0], pairs, ["p"]).first()["joins"] is want


def test_spans_and_runs(spark):
    items = [(0, 1, 0, "a", "x"), (0, 1, 1, "b", "x"), (0, 1, 2, "c", None), (0, 2, 3, "d", None)]
    df = spark.createDataFrame([(p, n, s, c, y, float(s), 0.0, 1.0, 2.0) for p, n, s, c, y in items], "p int, line int, seq int, ch string, style string, x double, y double, width double, height double")
    assert sorted(r["text"] for r in spans.styled(df.repartition(3), ["p"]).collect()) == ["ab", "c", "d"]
    it = spark.createDataFrame([(0, 0, "e", "p", "m", False, 1, True), (0, 1, "e", "p", "m", False, 2, True), (0, 2, "e", "p", "m", False, 1, True), (0, 3, "e", "q", "m", False, 1, True)], "d int, seq int, entry string, paint string, matrix string, markup boolean, letters int, faded boolean")
    assert [(r["run_no"], r["group_no"]) for r in spans.broken_runs(it, ["d"]).orderBy("seq").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_spatial_against_all_pairs(spark):
    rng = random.Random(3)
    a = [(i, round(rng.random(), 3), round(rng.random(), 3), "x") for i in range(120)]
    b = [(i, round(rng.random(), 3), round(rng.random(), 3), rng.choice("xy")) for i in range(150)]
    A, B = spark.createDataFrame(a, "i int, x double, y double, c string"), spark.createDataFrame(b, "j int, x double, y double, c string")
    want = {(p[0], q[0]) for p in a for q in b if abs(p[1] - q[1]) <= 0.05 and abs(p[2] - q[2]) <= 0.05}
    assert {tuple(r) for r in spatial.neighbours(A, B, "i", "j").select("i", "j").collect()} == want
    assert {r["i"] for r in spatial.conflicts(A, B, "i", "j", "c").collect()} == {i for i, j in want if b[j][3] == "y"}


@pytest.mark.parametrize(("text", "want"), [("Hello, world!", "Helwor"), ("Silent Reading is a new method facilitating the reading process.", "SileReadiinemethfacilitatithreadiproce"), ("x <b>hello</b> y", "hel"), ("oﬁce", "oﬁ"), ("2024", "")])
def test_fixation(text, want):
    got = fixation.segments(text)
    assert "".join(s for _, s in got) == text
    assert "".join(s for f, s in got if f) == want


@pytest.mark.parametrize(("n", "want"), [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4), (7, 5), (9, 7), (11, 9), (12, 10), (48, 40), (49, 40), (50, 41), (60, 51), (152, 143)])
def test_fixation_table(n, want):
    assert fixation.kept(n) == want


@pytest.mark.parametrize(("scope", "want"), [("all", "e 2024 x nt"), ("short", " 2024 nt"), ("common", "e nt"), ("prose", "e nt")])
def test_scopes(scope, want):
    words = frozenset("the coefficient incorporate word i min max sin log".split())
    s = fixation.Scope(scope, words, frozenset({"min", "max", "sin", "log"}))
    faded = "".join(t for f, t in fixation.segments("the 2024 dx coefficient", s) if not f)
    assert faded.replace(" ", "") == want.replace(" ", "")


def test_cross_run_words(spark):
    parts = fixation.across(["Incorpora", "te "])
    assert "".join(s for f, s in parts[0] if f) == "Incorpora" and parts[1] == [(False, "te ")]
    df = spark.createDataFrame([(0, 0, "Incorpora", False), (0, 1, "te ", True), (0, 2, "next", False)], "d int, run_no int, text string, joins boolean")
    assert sorted(r["first"] for r in fixation.with_joined_segments(df, ["d"]).collect()) == [0, 2]


def test_simplify_and_character_map():
    line = [(i / 10, (i * 10.0,)) for i in range(11)]
    assert gradients.simplify(line) == [line[0], line[-1]]
    bent = [(0.0, (0.0,)), (0.5, (50.0,)), (1.0, (0.0,))]
    assert gradients.simplify(bent) == bent
    got = charmaps.character_map("% c\n1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0066> <00660069>] endbfrange")
    assert got == {1: "A", 2: "a", 3: "b", 4: "c", 5: "f", 6: "fi"}


def test_glyph_assignment(spark):
    seen = spark.createDataFrame([("f", 0, 0x66, 28, None), ("f", 1, 0x66, 49, "fi"), ("f", 2, 0x66, 50, None)], "font_key string, ord int, code int, gid int, letters string")
    assert {r["gid"]: r["code"] for r in fonts.assign(seen).collect()} == {28: 0x66, 49: 0xFB01, 50: 0xE000}
    cmap = spark.createDataFrame([("f", 0x66, 28), ("f", 0x69, 30), ("f", 0xFB01, 49)], "font_key string, code int, gid int")
    assert fonts.ligatures(cmap, spark.createDataFrame([("f", 49, "fi"), ("f", 51, "ff")], "font_key string, gid int, letters string")).first()["parts"] == [28, 30]


def test_outline_and_active(spark):
    nodes = spark.createDataFrame([("a", None, 0, "A", 5), ("b", "a", 1, "B", 1), ("c", "a", 0, "C", 9), ("d", "c", 0, "D", 0)], "id string, parent string, pos int, title string, page int")
    tree = links.outline(nodes)
    assert [(r["id"], r["depth"]) for r in tree.orderBy("ord").collect()] == [("a", 0), ("c", 1), ("d", 2), ("b", 1)]
    at = spark.createDataFrame([("a", p) for p in (0, 1, 5, 9)], "root string, page int")
    assert {r["page"]: r["ord"] for r in links.active(tree, at, "root").collect()} == {0: None, 1: 3, 5: 3, 9: 3}


def test_layout_against_brute_force(spark):
    n = 101
    pages = spark.createDataFrame([("d", i, 600.0, 200.0 + 397 * i % 1000) for i in range(n)], "doc string, index long, width double, height double")
    boxes = layout.place(pages, "doc", columns=2, first_alone=True).cache()
    held = [(r["index"], r["top"], r["height"]) for r in boxes.orderBy("index").collect()]
    tops = list(range(-500, 60000, 1370))
    views = spark.createDataFrame([("d", t, float(t), 900.0) for t in tops], "doc string, view int, top double, height double")
    got = {r["view"]: (r["first"], r["last"]) for r in layout.visible(boxes, views, "doc").collect()}
    for t in tops:
        inside = [i for i, top, h in held if top + h >= t and top <= t + 900]
        near = min(held, key=lambda b: (max(b[1] - t - 450, t + 450 - b[1] - b[2], 0), b[0]))[0]
        assert got[t] == ((min(inside), max(inside)) if inside else (near, near))


def test_memory(spark):
    rows = [("a", 1, 1, True, None, False), ("b", 2, 2, True, "s", True), ("a", 3, None, False, "t", True), ("b", 4, None, True, None, False)]
    df = spark.createDataFrame(rows, "k string, at int, page int, set_page boolean, s string, set_s boolean")
    got = {r["k"]: (r["page"], r["s"]) for r in memory.latest(df, "k", ["at"], ["page", "s"]).collect()}
    assert got == {"a": (1, "t"), "b": (None, "s")}
    many = spark.createDataFrame([(f"p{i}", i, i, True) for i in range(105)], "k string, at int, page int, set_page boolean")
    kept = [r["k"] for r in memory.latest(many, "k", ["at"], ["page"]).collect()]
    assert (len(kept), kept[0], kept[-1]) == (100, "p104", "p5")


def test_running_offset_is_a_running_sum(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "i int, n int").repartition(5)
    got = {r["i"]: r["offset"] for r in memory.running_offset(df, "i", "n", 16).collect()}
    at = 0
    for i in range(200):
        assert got[i] == at
        at += i % 7


def test_numbered_and_ranges(spark):
    df = spark.createDataFrame([(0, 0, None, "lost"), (0, 1, 5, None), (0, 2, None, "a"), (0, 3, None, ""), (0, 4, None, "b"), (0, 5, 9, None), (0, 6, None, "c")], "k int, o int, n int, s string")
    got = [(r["name"], r["code"]) for r in fonts.numbered(df, ["k"], "o", F.col("n"), F.col("s")).orderBy("o").collect()]
    assert got == [("a", 5), ("b", 7), ("c", 9)]
    codes = spark.createDataFrame([("f", 1, 11), ("f", 2, 12), ("f", 3, 20), ("f", 5, 22)], "font_key string, code int, gid int")
    assert sorted(tuple(r)[1:] for r in fonts.ranges(codes).collect()) == [(1, 2, 11), (3, 3, 20), (5, 5, 22)]


def test_prefix_sums(spark):
    for n in (0, 1, 2, 7, 1300):
        sizes = [(7 * i) % 5 for i in range(n)]
        df = spark.createDataFrame([(sizes,)], "a array<int>")
        for width in (3, 512):
            got = df.select(arrays.prefix_sums(F.col("a"), width).alias("s")).first()["s"]
            assert got == [sum(sizes[:i]) for i in range(n)]
    assert spark.sql("select cast(null as array<int>) a").select(arrays.prefix_sums(F.col("a")).alias("s")).first()["s"] is None


def test_glyphs_without_a_usable_code_get_none(spark):
    seen = spark.createDataFrame([("f", 0, 0xFFFD, 3, None), ("f", 1, 0, 4, None), ("f", 2, 0x41, 5, None), ("f", 3, 0, 6, "xyz"), ("f", 4, 0x41, 7, None)], "font_key string, ord int, code int, gid int, letters string")
    assert {r["gid"]: r["code"] for r in fonts.assign(seen).collect()} == {5: 0x41, 6: 0xE000, 7: 0xE001}


def test_deep_outline_and_circles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, 0, "t", 1) for i in range(40)]
    schema = "id string, parent string, pos int, title string, page int"
    tree = links.outline(spark.createDataFrame(rows, schema))
    assert sorted((r["depth"], r["id"]) for r in tree.collect()) == [(i, f"n{i}") for i in range(40)]
    with pytest.raises(ValueError, match="ancestor"):
        links.outline(spark.createDataFrame([("a", None, 0, "t", 1), ("b", "a", 0, "t", 1), ("a", "b", 0, "t", 1)], schema))


@pytest.mark.parametrize("fold", [64, 1])
def test_rule_counts(spark, monkeypatch, fold):
    monkeypatch.setattr(rules, "FOLD_UP_TO", fold)
    monkeypatch.setattr(rules, "BROADCAST_RULES", 1)
    lines = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "b c"), (3, None)], "d int, text string")
    given = spark.createDataFrame([("r1", "b"), ("r2", "^a"), ("r3", "z"), ("r4", None)], "id string, pattern string")
    got = {r["id"]: (r["n_lines"], r["n_docs"]) for r in rules.matches(lines, given, "d").collect()}
    assert got == {"r1": (3, 2), "r2": (1, 1), "r3": (0, 0), "r4": (0, 0)}


def test_characters_and_their_places(spark):
    from quire.sources import documents as src

    rows = spark.createDataFrame([(1, "ab\n\nc"), (2, ""), (3, None)], "k int, text string")
    got = sorted((r["k"], r["seq"], r["line"], r["ch"]) for r in src.characters(rows, ["k"]).collect())
    assert got == [(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 3, "c")]


def test_memo_measures_once(spark):
    asked = []

    def measure(keys):
        asked.append(sorted(r["k"] for r in keys.collect()))
        return keys.where("k <> 3").withColumn("v", F.col("k") * 10)

    frame = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    empty = spark.createDataFrame([], "k int, v int")
    _, memo = memory.memoised(frame(1, 3, 3), empty, ["k"], measure)
    found, memo = memory.memoised(frame(1, 2, 3), memo, ["k"], measure)
    assert asked == [[1, 3], [2]]
    assert sorted((r["k"], r["v"]) for r in found.collect()) == [(1, 10), (2, 20), (3, None)]
    assert [r["k"] for r in memory.trimmed(memo, frame(2), ["k"]).collect()] == [2]


def test_resources_in_circles(spark):
    roots = spark.createDataFrame([(0, 1), (1, None), (2, 9)], "page int, resource int")
    inner = spark.createDataFrame([(1, 2), (2, 3), (3, 1), *[(i, i + 1) for i in range(9, 20)]], "resource int, child int")
    entries = spark.createDataFrame([(i, f"f{i}") for i in range(1, 21)], "resource int, font string")
    got = sorted((r["page"], r["depth"], r["font"]) for r in fonts.resource_fonts(roots, inner, entries).collect())
    assert got == [(0, 0, "f1"), (0, 1, "f2"), (0, 2, "f3"), *((2, i, f"f{9 + i}") for i in range(7))]


def test_served_faces_replace_once(spark):
    sheet = spark.createDataFrame([(1, "\n a { font-family:  'X'; src: \"u\" \"u\" }\n\t\nplain")], "k int, css string")
    faces = spark.createDataFrame([(1, 0, "X", "u", "old", "woff2", 5, 2), (1, 1, "X", "u", "new", "woff2", 7, 3)], "k int, ord int, family string, uri string, url string, format string, bytes long, glyphs long")
    got = sorted((r["n"], r["family"], r["css"], r["format"], r["bytes"], r["glyphs"]) for r in fonts.served(fonts.rule_assets(sheet, "k"), faces, "k").collect())
    assert got == [(0, "X", " a { font-family:  'X'; src: \"new\" \"u\" }", "woff2", 7, 3), (1, "plain", "plain", "woff", 0, 0)]

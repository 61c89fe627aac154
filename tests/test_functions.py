from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers, urls
from quire.functions import text as tx


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("A &amp; B", "A & B"), ("&#38;amp;", "&amp;"), ("&#x41;&LT;&bogus;", "A<&bogus;"), ("&#x110000;", "&#x110000;"), ("&#128512;", "\U0001f600"), ("", ""), ("&quot;&apos;", "\"'")],
)
def test_entities(spark, raw, want):
    assert one(spark, tx.decode_entities(F.col("t")), t=raw) == want


def test_normalise_keeps_no_break_space(spark):
    assert one(spark, tx.normalise(F.col("t")), t="A B c\n\x0bD") == "a bcd"
    assert one(spark, tx.normalised_offsets(F.col("t")), t="a b\tc") == [0, 2, 4]


def test_escapes(spark):
    assert one(spark, tx.escape_text(F.col("t")), t="<a & b>") == "&lt;a &amp; b&gt;"
    assert one(spark, tx.escape_attribute(F.col("t")), t="\x01\"a'\t") == "&quot;a&#39;\t"
    assert one(spark, tx.quote_json(F.col("t")), t='a" ') == '"a\\"\\u2028"'


@pytest.mark.parametrize(("x", "want"), [(12.345, 12.35), (-12.345, -12.35), (float("nan"), 0.0), (float("inf"), 0.0)])
def test_round2(spark, x, want):
    assert one(spark, tx.round2(F.col("x")), x=x) == want


@pytest.mark.parametrize(("x", "want"), [(1.5, "1.5"), (-0.0, "0"), (2.0, "2"), (float("nan"), "0"), (0.1, "0.1")])
def test_shortest(spark, x, want):
    assert one(spark, tx.shortest(F.col("x")), x=x) == want


@pytest.mark.parametrize(("data", "want"), [(b"", "odlameecjipmbmbejkplpemijjgpljce"), (b"abc", "lkhibglpipabmpokebebeanofnkocccd")])
def test_key_ids(spark, data, want):
    assert one(spark, tx.key_id(F.col("b")), b=bytearray(data)) == want


def test_digests(spark):
    assert one(spark, tx.base36(F.lit(4294967295))) == "1z141z3"
    assert len(one(spark, tx.integrity(F.col("b")), b=bytearray(b"abc"))) == 71
    assert one(spark, tx.word_sum(F.col("b")), b=bytearray(b"\xff\xff\xff\xff\x00\x00\x00\x02\x01")) == (0xFFFFFFFF + 2 + 0x01000000) % 2**32
    names = {one(spark, tx.two_lane_digest(F.col("f")), f=f) for f in (["ab", "c"], ["a", "bc"], ["abc"], ["ab", "d"])}
    assert len(names) == 4
    assert one(spark, tx.two_lane_digest(F.array().cast("array<string>")))
    h = 2166136261
    for c in b"hello":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, tx.fnv1a(F.col("b")), b=bytearray(b"hello")) == h


def test_unicode(spark):
    assert one(spark, tx.utf16be(F.lit("D83DDE00"))) == "\U0001f600"
    assert one(spark, tx.spell_ligatures(F.lit("oﬁce"))) == "ofice".replace("fi", "fi")
    assert one(spark, tx.ligature_of(F.lit("st"))) == 0xFB05
    assert one(spark, tx.unsafe_characters(F.lit("aאกb\U00010900"))) == 3


@pytest.mark.parametrize(("uri", "want"), [("http://example.com", True), ("mailto:a@b.c", True), ("a+b-c.d:x", True), ("a:", False), ("#page=4", False), ("example.com", False), ("", False), ("1http://x", False)])
def test_external(spark, uri, want):
    assert one(spark, urls.external(F.col("u")), u=uri) is want


@pytest.mark.parametrize(("uri", "want"), [("https://example.com/a", True), ("MAILTO:a@b.c", True), ("javascript:alert(1)", False), ("data:text/html,x", False), ("file:///etc/passwd", False), ("/relative", False), ("https://", False)])
def test_openable(spark, uri, want):
    assert one(spark, urls.openable(F.col("u")), u=uri) is want


@pytest.mark.parametrize(("url", "want"), [("HTTP://Example.COM/Path#x", "url:http://example.com/Path"), ("https://a.b", "url:https://a.b/"), ("http://a:80/x", "url:http://a/x"), ("file:///a/B", "file:///a/B"), ("not a url", "url:not a url")])
def test_document_key(spark, url, want):
    assert one(spark, urls.document_key(F.col("u")), u=url) == want


def test_names(spark):
    assert one(spark, urls.file_name(F.lit("https://x/a%20b.pdf?q"))) == "a b.pdf"
    assert one(spark, urls.local_key(F.lit(" A.PDF "), F.lit(7))) == "local:a.pdf:7"
    assert one(spark, urls.pdf_response(F.lit("application/PDF; x"), F.lit("attachment; y"))) is False
    assert one(spark, urls.without_scheme(F.lit("HTTPS://a/b"))) == "a/b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("150", 1.5), (" 75 ", 0.75), ("150%", 1.5), ("1.5", 1.5), ("2x", 2.0), ("1.5%", 0.015), ("12", 0.12), (".5", 0.5), ("fit width", "fit-width"), ("Fit-width", "fit-width"), ("fit page", "fit-page"), ("page", "fit-page"), ("Fit", "fit-page"), ("229% (fit width)", "fit-width")]
    + [(x, None) for x in ("", " ", "abc", "-50", "0", "10 apples", "1.2.3", "%")],
)
def test_zoom(spark, raw, want):
    got = one(spark, numbers.parse_zoom(F.col("t")), t=raw)
    assert (got if got is None else got["value"] if got["mode"] == "custom" else got["mode"]) == (pytest.approx(want) if isinstance(want, float) else want)


def test_numbers(spark):
    assert one(spark, numbers.fade(F.lit(0.7))) == 0.5
    assert one(spark, numbers.valid_box(F.lit("1"), F.lit("x"), F.lit("3"), F.lit("4"))) is None
    assert one(spark, numbers.progress(F.lit(3.0), F.lit(0.0))) == 0.0
    assert one(spark, numbers.first_filled(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, numbers.scope_of_name(F.lit(" Short "))) == "short"
    assert one(spark, numbers.destination_point(F.lit("FitH"), F.lit(1.0), F.lit(2.0))).asDict() == {"x": None, "y": 2.0}

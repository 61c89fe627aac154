"""Joins of characters and fixed letters inside the text's row, against frames of characters and Python."""

from __future__ import annotations

import random
import time
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import fixation, spans
from quire.plans import registry
from quire.sources import documents as src

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(seed):
    draw = random.Random(seed)
    return ["", None, "a", "\n", "  ", "x" * 20_000 + " " + "7" * 20_000] + ["".join(draw.choices("ab1éﬃﬁ \t\n  3.-𝒜日", k=draw.randint(0, 60))) for _ in range(200)]


def test_joins_equal_the_frame_of_characters(spark):
    draw = random.Random(1)
    rows = [(k, t, [(draw.randint(-2, 40), draw.randint(-2, 45)) for _ in range(20)]) for k, t in enumerate(texts(1))]
    df = spark.createDataFrame(rows, "d long, text string, p array<struct<from:int,to:int>>")
    inside = spans.text_joins(df, ["d"], "text", F.col("p"))
    assert "Exchange" not in plan(inside)
    got = {(r["d"], p["from"], p["to"]): p["joins"] for r in inside.collect() if r["pairs"] is not None for p in r["pairs"]}
    pairs = df.where("text is not null").select("d", F.explode("p").alias("p")).select("d", F.col("p.from").cast("long").alias("from"), F.col("p.to").cast("long").alias("to")).distinct()
    want = {(r["d"], r["from"], r["to"]): r["joins"] for r in spans.joins(src.characters(df.select("d", "text"), ["d"]), pairs, ["d"]).collect()}
    assert {k: (v, want.get(k)) for k, v in got.items() if v != want.get(k)} == {} and got == want and sum(want.values()) > 50


@pytest.mark.parametrize("name", ["space_marks", "space_marks_documents"])
def test_space_marks_stay_in_the_row(spark, name):
    found = plan(registry.queries()[name](spark, FOLDER))
    assert "Exchange" not in found and "Python" not in found and "Arrow" not in found


def test_mark_sums_equal_the_frame_of_characters(spark):
    wide = [" \u3000\n\u1680x\n\ny \u2003z\u205f", "\n\nab", "a\n \nb", "a\r\nb", " " * 300_000, "a" + "\n" * 300_000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts(3) + wide)), "d long, text string")
    marks = spans.space_marks(src.characters(df, ["d"]), ["d"]).groupBy("d", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("targets"))
    got = spans.mark_sums(df, ["d"], "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, marks.collect())) and got.schema["targets"].dataType == marks.schema["targets"].dataType


def slow_marks(text, scope, bounds=fixation.BOUNDS):
    """Marks by a loop over letters."""
    spelled = [(letter, i) for i, c in enumerate(text) for letter in tx.LIGATURES.get(c, c)]
    fixed, at = [False] * len(spelled), 0
    runs = []
    for is_word, run in groupby(spelled, key=lambda s: s[0].isalnum()):
        letters = "".join(c for c, _ in run)
        runs.append((is_word, at, at + len(letters), letters))
        at += len(letters)
    fades = {k: scope.may_fade(s[3]) for k, s in enumerate(runs) if s[0]}
    for k, (is_word, a, z, letters) in enumerate(runs):
        if is_word:
            n = fixation.kept(z - a, bounds) if any(c.isalpha() for c in letters) else 0
            n = n if fades[k] else z - a
            fixed[a : a + n] = [True] * n
        elif scope.name != "all" and (not fades or letters.strip() and not (fades.get(k - 1, True) and fades.get(k + 1, True))):
            fixed[a:z] = [True] * (z - a)
    out = [False] * len(text)
    for (_, i), f in zip(spelled, fixed, strict=True):
        out[i] = out[i] or f
    return out


def test_marks_by_words_equal_marks_by_letters():
    draw = random.Random(7)
    words = frozenset({"the", "a", "eﬃcient", "efficient", "sine", "zwei"})
    scopes = [fixation.Scope("all"), fixation.Scope("short"), fixation.Scope("common", words), fixation.Scope("prose", words, frozenset({"sine"}))]
    for _ in range(3000):
        parts = draw.choices([*words, "ﬁ", "_", "½x", "²", "12", "e\u0301", "日本語文字", " ", ", ", "\n", "\x1c", "-", "ﬃﬃ", "x" * 19, "oﬀ"], k=draw.randint(0, 9))
        text, scope = "".join(parts), draw.choice(scopes)
        want = slow_marks(text, scope)
        assert fixation.marks(text, scope) == want
        assert [(f, "".join(c for c, _ in run)) for f, run in ((f, list(r)) for f, r in groupby(zip(text, want), key=lambda p: p[1]))] == fixation.segments(text, scope)
        own = fixation.across(parts, scope)
        assert ["".join(s for _, s in o) for o in own] == parts and [f for o in own for f, s in o for _ in s] == want


def test_marking_is_fast():
    """A letter costs well under a microsecond; the loop over letters took several."""
    text, began = "the quick brown fox, jumped over 12 lazy dogs. " * 20_000, time.process_time()
    assert "".join(s for _, s in fixation.segments(text, fixation.Scope("short"))) == text
    fast, began = time.process_time() - began, time.process_time()
    slow_marks(text, fixation.Scope("short"))
    assert fast * 2 < time.process_time() - began


def test_fixed_letters_equal_the_marks(spark):
    rows = list(enumerate(texts(2) + ["oﬃce ﬁ 12 eﬃﬃcientﬁ ab3ﬂ", "ﬁ" * 30]))
    df = spark.createDataFrame(rows, "d long, text string")
    got = {r["d"]: (r["fixed"], r["chars"]) for r in fixation.counts(df, ["d"]).collect()}
    assert got == {k: (sum(fixation.marks(t or "")), len(t or "")) for k, t in rows}


@pytest.mark.parametrize("name", ["fixation_summary", "fixation_summary_documents", "char_joins", "char_joins_documents"])
def test_no_worker_and_no_exchange(spark, name):
    found = plan(registry.queries()[name](spark, FOLDER))
    assert "Exchange" not in found and "Python" not in found and "Arrow" not in found


def test_document_counts_equal_python(spark):
    got = {r["doc_id"]: r["fixed"] for r in registry.queries()["fixation_summary_documents"](spark, FOLDER).collect()}
    assert got == {r["doc_id"]: sum(fixation.marks(r["text"] or "")) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["first_code_wins_documents", "glyph_codes_documents"])
def test_characters_are_reduced_by_hashing(spark, name):
    """Characters of documents come to few rows before anything sorts or collects them."""
    found = plan(registry.queries()[name](spark, FOLDER))
    steps = [line.strip(" :+-*()0123456789") for line in found.splitlines() if "Aggregate(" in line]
    assert steps[-1].startswith("HashAggregate") and steps[-2].startswith("HashAggregate"), found


def test_codes_of_equal_sets(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 1, 3), ("a", 2, None), (None, 1, 9)], "font_key string, gid int, ucs int")
    from quire.operators import fonts

    got = {(r["font_key"], r["gid"]): r["codes"] for r in fonts.codes_of(df).collect()}
    assert got == {("a", 1): [3, 5], ("a", 2): [], (None, 1): [9]}


def test_words_across_runs_come_back_as_arrow(spark):
    """Segments leave the worker as flat arrays, not as an object for each."""
    found = plan(registry.queries()["run_words"](spark, FOLDER))
    assert "MapInArrow" in found and "ArrowEvalPython" not in found


@pytest.mark.parametrize("ahead", [1, 3, 7])
def test_join_sums_equal_the_joins_of_all_pairs(spark, ahead):
    wide = [" 　\n xyzé𝒜 abcdefgh z ", "\n\nabcdef\n", "a\n \nb", "abcd\r\nbcde", "abcdefghij" * 20]
    df = spark.createDataFrame(list(enumerate(texts(4) + wide)), "d long, text string")
    n = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    pairs = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("from"), (i + ahead).alias("to")))
    each = spans.text_joins(df, ["d"], "text", pairs).select("d", F.filter("pairs", lambda p: p["joins"])["from"].alias("at")).collect()
    want = {r["d"]: (None, None) if r["at"] is None else (len(r["at"]), sum(r["at"])) for r in each}
    assert {r["d"]: (r["n"], r["places"]) for r in spans.join_sums(df, ["d"], "text", ahead).collect()} == want and want[1] == (None, None)


@pytest.mark.parametrize("name", ["char_joins", "char_joins_documents"])
def test_joins_are_counted_by_stretches(spark, name):
    """No pair is made for each character of a text."""
    assert "sequence(" not in plan(registry.queries()[name](spark, FOLDER))

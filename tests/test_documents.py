"""Queries over whole documents against brute force."""

from __future__ import annotations

import pytest

from quire.operators import fixation
from quire.plans import registry

TEXTS = [(0, "en", "fib fi\u00e9 the end"), (1, "de", "\u00fcber \U0001f600 caf\u00e9\nzwei"), (2, "en", ""), (3, "fr", None), (4, "de", "ab " * 40_000 + "\u4e2d"), (5, "es", "ni\u00f1o\t \nab  c\u00a0d")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(TEXTS, "doc_id long, lang string, text string").write.parquet(f"{d}/documents.parquet")
    return d


def uses():
    return [(lang, i * (1 << 31) + k, ord(c), ord(c) * 7 % 211) for i, lang, t in TEXTS for k, c in enumerate(t or "")]


def collected(spark, folder, name):
    return sorted(map(tuple, registry.queries()[name](spark, folder).collect()))


def test_font_queries(spark, folder):
    first, pair, total, gone, codes = {}, {}, {}, {}, {}
    english = {u[2] for u in uses() if u[0] == "en"}
    for f, seq, c, g in uses():
        first.setdefault((f, g), (c, seq))
        pair.setdefault((f, c, g), seq)
        codes.setdefault((f, g), set()).add(c)
        total[f] = total.get(f, 0) + 1
        gone.setdefault(f, []).extend([c] if f == "en" or c not in english else [])
    text = lambda cs: ",".join(map(str, sorted(set(cs))))
    assert collected(spark, folder, "first_code_wins_documents") == sorted((*k, *v) for k, v in first.items())
    assert collected(spark, folder, "font_pairs_documents") == sorted((*k, v) for k, v in pair.items())
    assert collected(spark, folder, "glyph_codes_documents") == sorted((*k, text(v)) for k, v in codes.items())
    assert collected(spark, folder, "font_coverage_documents") == sorted((f, n, len(gone[f]), text(gone[f])) for f, n in total.items())
    inside = {(f, c) for f, a, z, _ in collected(spark, folder, "code_ranges_documents") for c in range(a, z + 1)}
    assert inside == {(u[0], u[2]) for u in uses()}
    assert {(f, g) for f, g, _ in collected(spark, folder, "glyph_assign")} == {(u[0], u[3]) for u in uses()}


def chars(text):
    return [(line, c) for line, t in enumerate((text or "").split("\n")) for c in t]


def test_fixation_queries(spark, folder):
    scope = fixation.Scope("short")
    want = [(i, n, f, s, len(s)) for i, _, t in TEXTS for n, (f, s) in enumerate(fixation.segments(t or "", scope))]
    assert collected(spark, folder, "fixation_segments") == sorted(want)
    assert collected(spark, folder, "fixation_summary_documents") == [(i, sum(fixation.marks(t or "")), len(t or "")) for i, _, t in TEXTS]


def test_space_marks_and_joins(spark, folder):
    marks, joins = {}, []
    for i, _, t in TEXTS:
        found, blank, after = chars(t), " \t\u00a0", None
        hits = []
        for k in range(len(found) - 1, -1, -1):
            line, c = found[k]
            if c in blank:
                hits += [("space", after)] * (after is not None)
            else:
                if k and found[k - 1][0] != line and found[k - 1][1] not in blank:
                    hits.append(("break", k))
                after = k
        for kind, at in hits:
            n, total = marks.get((i, kind), (0, 0))
            marks[i, kind] = n + 1, total + at
        ok = [k for k in range(len(found) - 3) if found[k][0] == found[k + 3][0] and not any(c in blank for _, c in found[k : k + 4])]
        if found:
            joins.append((i, len(ok), sum(ok)))
    assert collected(spark, folder, "space_marks_documents") == sorted((*k, *v) for k, v in marks.items())
    assert collected(spark, folder, "char_joins_documents") == joins


def test_named_glyphs_of_all_parts(spark):
    d = "/root/testdata/sf0.001"
    parts = [(r["p_partkey"], r["p_brand"], r["p_type"]) for r in spark.read.parquet(f"{d}/part.parquet").collect()]
    first = {}
    for key, brand, kind in parts:
        first[brand, kind] = min(first.get((brand, kind), key), key)
    assert collected(spark, d, "named_glyphs") == sorted((k, first[b, t], b if k % 2 == 0 else f"named\0{t}") for k, b, t in parts)

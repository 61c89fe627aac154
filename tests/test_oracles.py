"""Queries without an SQL twin against plain loops that share no code with them."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import fixation, fonts
from quire.plans import registry

from .test_documents import TEXTS, collected, folder, uses  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
#: Presentation forms that letters spell; fixed by Unicode.
FORMS = {"ff": 0xFB00, "fi": 0xFB01, "fl": 0xFB02, "ffi": 0xFB03, "ffl": 0xFB04, "st": 0xFB05}


def assigned(seen):
    """(gid, code) of one font by the rules, from (order, code, gid, letters) in a list."""
    seen = sorted(seen, key=lambda u: u[:3])
    usable = lambda c: 0 < c <= 0x10FFFF and c != 0xFFFD
    letters = {}
    for _, _, g, text in seen:
        if text is not None:
            letters.setdefault(g, text)
    by_code, code_of = {}, {}
    for _, c, g, _ in seen:
        if usable(c) and g not in letters and c not in by_code:
            by_code[c] = g
            code_of[g] = c  # a later pair replaces the glyph's earlier code, which stays taken
    for g, text in letters.items():
        c = FORMS.get(text)
        if c and c not in by_code:
            by_code[c] = code_of[g] = c
    free = iter([c for c in range(0xE000, 0xF900) if c not in by_code])
    for g in sorted({u[2] for u in seen if usable(u[1]) or u[2] in letters}):
        if g not in code_of:
            c = next(free, None)
            if c is not None:
                code_of[g] = c
    return set(code_of.items())


def test_glyph_codes_of_documents(spark, folder):  # noqa: F811
    by_font = {}
    for f, seq, c, g in uses():
        by_font.setdefault(f, []).append((seq, c, g, "fi" if g == 5 else None))
    assert {tuple(r) for r in collected(spark, folder, "glyph_assign")} == {(f, *x) for f, own in by_font.items() for x in assigned(own)}


def test_glyph_codes_of_random_fonts(spark):
    draw = random.Random(2)
    rows = [(f, k, draw.choice([0, 0xFFFD, 0xE000, 0xFB01, 65, 66, 67, draw.randrange(40, 200), 0x110000]), draw.randrange(60), None) for f in ("a", "b") for k in range(400)]
    text = {(f, g): draw.choice(["fi", "ff", "xy", None]) for f in ("a", "b") for g in range(60)}
    rows = [(*r[:4], text[r[0], r[3]]) for r in rows]
    df = spark.createDataFrame(rows, "font_key string, ord long, code int, gid int, letters string").repartition(4)
    got = {tuple(r) for r in fonts.assign(df).collect()}
    assert got == {(f, *x) for f in ("a", "b") for x in assigned([r[1:] for r in rows if r[0] == f])}


def test_code_ranges_of_documents(spark, folder):  # noqa: F811
    want = []
    for f in {u[0] for u in uses()}:
        codes = sorted({u[2] for u in uses() if u[0] == f})
        glyph = {c: c + (k + 1) // 20 for k, c in enumerate(codes)}
        run = []
        for c in codes:
            if run and (c != run[-1] + 1 or glyph[c] - c != glyph[run[-1]] - run[-1]):
                want.append((f, run[0], run[-1], glyph[run[0]]))
                run = []
            run.append(c)
        want.append((f, run[0], run[-1], glyph[run[0]]))
    assert [tuple(r) for r in collected(spark, folder, "code_ranges_documents")] == sorted(want)


def lanes(fields):
    """A digest of two lanes in Python's integers."""
    a, b = 2166136261, 0x9E3779B9
    for field in fields:
        for c in field:
            a = (a ^ ord(c)) * 16777619 % 2**32
            b = (b ^ ord(c)) * 0x85EBCA6B % 2**32
        a = (a ^ 0x100) * 16777619 % 2**32

    def base36(n):
        out = ""
        while n:
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out or "0"

    return f"{base36(a)}-{base36(b)}"


def test_integrity_names(spark):
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        data = r["url"].encode()
        digest = base64.b64encode(hashlib.sha384(data).digest()).decode()
        want[r["page_id"]] = (f"sha384-{digest}", zlib.crc32(data), lanes([r["url"], str(r["page_id"])]))
    got = {r["page_id"]: (r["integrity"], r["crc"], r["digest"]) for r in registry.queries()["integrity_names"](spark, FOLDER).collect()}
    assert got == want and len(want) > 10


def test_words_across_runs(spark):
    """The words of runs that carry on are marked as in one text, and cut where the runs are."""
    draw = random.Random(4)
    runs = [(p, n, "".join(draw.choices("ab cd,ﬁ", k=draw.randint(0, 9))), draw.random() < 0.6) for p in range(30) for n in range(draw.randint(1, 8))]
    df = spark.createDataFrame(runs, "p int, run_no int, text string, joins boolean").repartition(4)
    got = {(r["p"], r["first"]): [[(s["fixation"], s["text"]) for s in own] for own in r["parts"]] for r in fixation.with_joined_segments(df, ["p"]).collect()}
    want = {}
    for p in range(30):
        islands = []
        for _, n, text, joins in (r for r in runs if r[0] == p):
            if joins and islands:
                islands[-1][1].append(text)
            elif joins:
                islands.append((n, [text]))
            else:
                islands.append((n, [text]))
        for first, texts in islands:
            fixed = fixation.marks("".join(texts))
            at, parts = 0, []
            for t in texts:
                own = []
                for c, f in zip(t, fixed[at : at + len(t)], strict=True):
                    if own and own[-1][0] == f:
                        own[-1] = (f, own[-1][1] + c)
                    else:
                        own.append((f, c))
                parts.append(own)
                at += len(t)
            want[p, first] = parts
    assert got == want


def test_run_words_query(spark):
    got = {(r["page_id"], r["first"]): (r["runs"], r["fixed"]) for r in registry.queries()["run_words"](spark, FOLDER).collect()}
    pages = {}
    for r in registry.queries()["page_run_rows"](spark, FOLDER).collect():
        pages.setdefault(r["page_id"], []).append((r["run_no"], r["text"]))
    want = {}
    for page, own in pages.items():
        first = None
        for n, text in sorted(own):
            if first is None or not text[:1].islower() or not ("a" <= text[0] <= "z"):
                first = n
            want.setdefault((page, first), []).append(text)
    assert got == {k: (len(v), sum(fixation.marks("".join(v)))) for k, v in want.items()}


def test_custom_rules_with_removals(spark):
    from quire.operators import rules

    draw = random.Random(6)
    rows = [(k, n, draw.choice(["add", "add", "add", "remove", None]), draw.choice(["a", "b", "(", "c+", None, *(f"p{i}" for i in range(70))]), f"custom-{draw.randint(1, 60)}") for k in (None, 1, 2) for n in range(300)]
    df = spark.createDataFrame(rows, "k int, n0 int, action string, pattern string, id string").repartition(3)
    got = {(r["k"], r["n"]): (r["id"], r["reason"] is not None) for r in rules.custom_rules(df, "k", ["n0"]).collect()}
    want = {}
    for k in (None, 1, 2):
        held = {}
        for _, n, action, pattern, own in (r for r in rows if r[0] == k):
            want[k, n] = (None, False)
            if action == "add" and (pattern in (None, "(") or pattern in held.values() or len(held) == 50):
                want[k, n] = (None, True)
            elif action == "add":
                free = min(set(range(1, 52)) - {int(i[7:]) for i in held})
                held[f"custom-{free}"] = pattern
                want[k, n] = (f"custom-{free}", False)
            elif action == "remove" and held.pop(own, None) is not None:
                want[k, n] = (own, False)
    assert got == want

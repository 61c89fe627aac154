"""Glyph names of font programs: fixtures of every form, broken bytes, and the frame operator."""

from __future__ import annotations

import random
import unicodedata

import pytest

from quire.operators import programs as P

NAMES = ["A", "fi", "fl", "my.glyph", "Aacute", "zcaron", "A", "uni20AC", "space", "germandbls", "é"]
CODES = {65: 1, 2: 2, 3: 3, 200: 4, 66: 5, 67: 6, 68: 7, 69: 8, 255: 2}


def test_fixed_strings():
    s = P.standard_strings()
    assert len(s) == 229 and len(set(s)) == 229
    assert (s[1], s[17], s[34], s[66], s[95], s[109], s[110], s[137], s[149], s[171], s[199], s[200], s[228]) == (
        "space", "zero", "A", "a", "asciitilde", "fi", "fl", "emdash", "germandbls", "Aacute", "Zcaron", "aacute", "zcaron")
    for name in s[171:]:  # composed letters are letters with these accents
        base, accent = name[0], name[1:]
        assert unicodedata.lookup(f"LATIN {'CAPITAL' if base.isupper() else 'SMALL'} LETTER {base.upper()} WITH {({'dieresis': 'DIAERESIS', 'ring': 'RING ABOVE'}).get(accent, accent.upper())}")


@pytest.mark.parametrize("form", [0, 1, 2])
def test_cff(form):
    held = P.cff_program(NAMES, CODES, form)
    assert P.glyphs(held) == ([".notdef", *NAMES], CODES)
    assert P.glyphs(P.cff_program(NAMES, None, form)) == ([".notdef", *NAMES], {})
    table = b"OTTO" + (1).to_bytes(2, "big") + bytes(6) + b"CFF " + bytes(4) + (28).to_bytes(4, "big") + len(held).to_bytes(4, "big")
    assert P.glyphs(table + held) == ([".notdef", *NAMES], CODES)


def test_cff_ranges_and_expert_strings():
    many = P.standard_strings()[1:] + [f"g{k}" for k in range(700)]
    assert P.glyphs(P.cff_program(many, None, 2))[0][1:] == many == P.glyphs(P.cff_program(many, None, 1))[0][1:]
    data = P._Bytes(b"\0" * 4 + b"\1" + (229).to_bytes(2, "big") + b"\2")
    assert P._charset(data, 4, 4) == [229, 230, 231]
    assert P._charset(data, 0, 4) == [1, 2, 3] and len(P._charset(data, 2, 4)) == 3


@pytest.mark.parametrize("form", ["binary", "hex", "segments"])
def test_type1(form):
    by_name = {code: NAMES.index(NAMES[gid - 1]) + 1 for code, gid in CODES.items()}  # a code names its glyph there
    assert P.glyphs(P.type1_program(NAMES, CODES, form)) == ([".notdef", *NAMES], by_name)
    assert P.encrypted(P.decrypted(b"any bytes")) == b"any bytes"


def test_broken_bytes_raise_one_error_alone():
    draw = random.Random(1)
    good = [P.cff_program(NAMES, CODES, f) for f in (0, 1, 2)] + [P.type1_program(NAMES, CODES, f) for f in ("binary", "hex", "segments")]
    broken = 0
    for held in good:
        cases = [held[:n] for n in range(0, len(held), 3)]
        for _ in range(300):
            other = bytearray(held)
            for _ in range(draw.randint(1, 6)):
                other[draw.randrange(len(other))] = draw.randrange(256)
            cases.append(bytes(other))
        for case in [*cases, b"", b"OTTO", bytes(100), b"\1\0\4\4" + b"\xff" * 40, draw.randbytes(200)]:
            try:
                P.glyphs(case)
            except P.BrokenProgram:
                broken += 1
    assert broken > 500


def test_frame(spark):
    rows = [(1, P.cff_program(["x", "fi"], {65: 1})), (2, P.type1_program(["x", "fi"], {65: 2})), (3, b"broken"), (4, None), (4, b""), (None, P.cff_program(["n"]))]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc long, content binary, name string")
    got = sorted((r["doc"] or 0, r["gid"], r["name"], r["codes"]) for r in P.glyph_names(df, "doc").collect())
    assert got == [(0, 0, ".notdef", []), (0, 1, "n", []), (1, 0, ".notdef", []), (1, 1, "x", [65]), (1, 2, "fi", []), (2, 0, ".notdef", []), (2, 1, "x", []), (2, 2, "fi", [65])]
    assert P.glyph_names(df.limit(0), "doc").count() == 0


def test_names_of_many_programs_share_batches(spark):
    """The fixed names are made once, and the glyphs of a batch of programs go out together."""
    found = P.glyph_names(P.made_programs(spark.range(300).selectExpr("id", "array('a', concat('g', id)) AS names").coalesce(1), "id", "names").coalesce(1), "id")
    assert sorted(map(tuple, found.select("id", "gid", "name").collect())) == sorted((k, n, name) for k in range(300) for n, name in enumerate([".notdef", "a", f"g{k}"]))
    assert P._standard_names() is P._standard_names() and list(P._standard_names()) == P.standard_strings()
    plan = P.made_programs(spark.range(3).selectExpr("id", "array('a') AS names"), "id", "names")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan

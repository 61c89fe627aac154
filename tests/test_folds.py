"""Folds over sorted rows: place histories, gradient stops, nested transforms and rasters, against plain loops."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quire.operators import folds, gradients, matrices, places, rasters


def walked(moves, limit):
    """A history by the rules, entry by entry."""
    entries, at, doc, out = [[0, None]], 0, 0, []
    for n, (kind, place, left) in enumerate(moves):
        shown = None
        if kind == "jump":
            entries[at] = [doc, left]
            del entries[at + 1 :]
            entries.append([doc, place])
            if len(entries) > limit:
                entries.pop(0)
            at, shown = len(entries) - 1, place
        elif kind == "back" and at > 0:
            at -= 1
            shown = entries[at][1] if entries[at][0] == doc else None
        elif kind == "forward" and at + 1 < len(entries):
            at += 1
            shown = entries[at][1] if entries[at][0] == doc else None
        elif kind == "open":
            doc += 1
        out.append((n, shown, at, len(entries)))
    return out


@pytest.mark.parametrize("limit", [3, 50])
def test_history(spark, limit):
    draw = random.Random(limit)
    kinds = ["jump", "jump", "back", "back", "forward", "open", None, "other"]
    moves = {k: [(draw.choice(kinds), draw.randrange(99), draw.choice([None, draw.randrange(99)])) for _ in range(draw.randint(1, 80))] for k in [None, *range(20)]}
    rows = [(k, n, *m) for k, own in moves.items() for n, m in enumerate(own)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, o int, kind string, place int, left int").repartition(5)
    got = {}
    for r in places.history(df, "k", ["o"], limit).collect():
        got.setdefault(r["k"], []).append((r["n"], r["shown"], r["at"], r["size"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: walked(own, limit) for k, own in moves.items()}
    assert places.history(df.limit(0), "k", ["o"]).count() == 0


def thinned(samples, tolerance):
    """The greedy rule in fractions, all samples at hand."""
    out, begin = samples[:1], 0
    while begin < len(samples) - 1:
        end = begin + 1
        while end + 1 < len(samples):
            (x0, *a), (x1, *b) = samples[begin], samples[end + 1]
            at = lambda x: Fraction(x - x0, x1 - x0) if x1 != x0 else 0  # noqa: B023, E731
            if any(abs(p + (q - p) * at(s[0]) - s[1 + k]) > tolerance for s in samples[begin + 1 : end + 1] for k, (p, q) in enumerate(zip(a, b, strict=True))):
                break
            end += 1
        out.append(samples[end])
        begin = end
    return out


def test_stops(spark):
    draw = random.Random(3)
    rows = []
    for k in range(60):
        x, c = 0, [draw.randrange(256) for _ in range(3)]
        for _ in range(draw.choice([1, 2, 3, 40, 120])):
            rows.append((k, x, *c))
            x += draw.choice([1, 1, 1, 2, 5] if k % 4 else [0, 1])
            step = draw.choice([0, 1, 2])
            c = [v + draw.choice([step, step, step + 1]) * (1 if k % 2 else -1) for v in c]
    df = spark.createDataFrame([*rows, (1, None, 0, 0, 0), (None, 3, 1, 1, 1)], "k int, x int, r int, g int, b int").repartition(6)
    got = {}
    for r in gradients.stops(df, "k", "x", ["r", "g", "b"]).collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    want = {None: [(3, 1, 1, 1)]}
    for k in range(60):
        own = sorted(r[1:] for r in rows if r[0] == k)
        want[k] = thinned(own, 1)
        assert gradients.simplify([(s[0], s[1:]) for s in own])[0] == (own[0][0], own[0][1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(map(len, want.values())) < 0.6 * len(rows)


@pytest.mark.parametrize(("width", "blocks"), [(1, 10_000), (7, 10_000), (4096, 10_000), (1, 3)])
def test_nested_transforms(spark, monkeypatch, width, blocks):
    monkeypatch.setattr(matrices, "BLOCKS", blocks)
    draw = random.Random(width)
    rows, want = [], {}
    for k in (0, 1, None):
        stack = []
        for n in range(200):
            kind = draw.choice(["open", "open", "close", "draw", "draw", "close" if k == 1 else "draw"])
            m = [float(draw.choice([-1, 0, 1, 2])) for _ in range(6)] if kind == "open" else None
            if kind == "open" and len(stack) < 30:
                top = np.array(stack[-1]) if stack else np.eye(3)
                stack.append(top @ np.array([[m[0], m[2], m[4]], [m[1], m[3], m[5]], [0, 0, 1]]))
            elif kind == "open":
                m = draw.choice([None, [1.0, None, 0.0, 1.0, 0.0, 0.0], [1.0]])
            elif kind == "close" and stack:
                stack.pop()
            elif kind == "draw":
                t = stack[-1] if stack else None
                want[k, n * 3] = None if t is None else [t[0, 0], t[1, 0], t[0, 1], t[1, 1], t[0, 2], t[1, 2]]
            rows.append((k, n * 3, kind, m))
    df = spark.createDataFrame([*rows, (0, None, "draw", None), (0, 1, "else", None)], "k int, n int, kind string, matrix array<double>").repartition(4)
    got = {(r["k"], r["n"]): r["total"] for r in matrices.composed(df, "k", "n", width=width).collect()}
    assert got == want
    assert matrices.composed(df.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("side", [1, 3, 8, 64])
def test_coverage_is_the_whole_rasters(spark, side):
    draw = random.Random(5)
    rows, want = [], {}
    for page in (1, 2, None):
        raster = np.zeros((120, 120), bool)
        for _ in range(12):
            x, y, w, h = (draw.choice([0.5, 1.0, 0.25]) * draw.randint(-20, 40), draw.randint(-20, 40) * 0.5, draw.choice([0, 0.5, 1, 3.25, 20]), draw.choice([0, 1, 2.5, 9]))
            rows.append((page, x, y, float(w), float(h)))
            if w and h:
                raster[int(np.floor(y)) + 50 : int(np.ceil(y + h)) + 50, int(np.floor(x)) + 50 : int(np.ceil(x + w)) + 50] = True
        want[page] = (int(raster.sum()), int(sum((np.roll(np.roll(raster, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)), np.zeros_like(raster, int)).astype(bool).sum()))
    odd = [(3, float("nan"), 0.0, 1.0, 1.0), (3, None, 0.0, 1.0, 1.0), (3, 0.0, 0.0, float("inf"), 1.0)]
    df = spark.createDataFrame([*rows, *rows[:5], *odd], "page int, x double, y double, width double, height double")
    assert {r["page"]: (r["covered"], r["dilated"]) for r in rasters.coverage(df, ["page"], side=side).collect()} == want


def test_blocks_hold_rows_enough(spark, monkeypatch):
    """Keys whose rows lie far apart are not cut into a block for each row."""
    df = spark.range(20_000).selectExpr("id % 100 AS k", "id AS n", "CASE WHEN id % 3 = 0 THEN 'open' WHEN id % 7 = 0 THEN 'close' ELSE 'draw' END AS kind", "array(1D, 0D, 0D, 1D, 1D, 0D) AS matrix")
    blocks, folded = [], matrices.folded
    monkeypatch.setattr(matrices, "folded", lambda rows, key, *a: blocks.append(rows.select(key).distinct().count()) or folded(rows, key, *a))
    assert matrices.composed(df, "k", "n", width=64).count() > 0
    assert blocks[0] <= 100 * (200 // 64 + 1)


def test_keys_are_compared_in_arrow():
    made = [({"a": {"b": 1}, "c": None}, True), ({"a": {"b": 1}, "c": None}, False), ({"a": {"b": None}, "c": None}, True), ({"a": None, "c": None}, True), (None, True), (None, False), ({"a": {"b": 1}, "c": "x"}, True), ({"a": {"b": 1}, "c": "y"}, True)]
    column = pa.array([k for k, _ in made], pa.struct([("a", pa.struct([("b", pa.int64())])), ("c", pa.string())]))
    assert folds._begins(column) == [b for _, b in made]


def test_coverage_is_hashed(spark):
    """Boxes are united by hashing in Spark: no worker paints, no rows are sorted; many equal boxes come to one strip before the exchange."""
    df = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 3.0)] * 50 + [(2, -70.0, -1.0, 1.0, 300.0), (2, 1e12, 5.0, 1.0, 1.0)], "page int, x double, y double, width double, height double")
    found = rasters.coverage(df, ["page"])
    made = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in made and "Sort" not in made and made.count("Exchange") == 2
    assert {r["page"]: (r["covered"], r["dilated"]) for r in found.collect()} == {1: (600, 202 * 5), 2: (301, 3 * 302 + 9)}

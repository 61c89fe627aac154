"""Running aggregates in buckets against a loop, and layouts over them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, running


@pytest.mark.parametrize(("buckets", "width", "inclusive"), [(3, None, True), (1024, None, False), (1, 2.5, True), (1, 1e9, False)])
def test_running(spark, monkeypatch, buckets, width, inclusive):
    monkeypatch.setattr(running, "BUCKETS", buckets)
    draw = random.Random(buckets)
    rows = [(draw.choice([None, "a", "a", "a", "b"]), draw.choice([None, float("nan"), *map(float, range(-5, 30))]), k, draw.choice([None, 1, 2, 7])) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, o double, n long, v long").repartition(5)
    number = running.numbered(df, ["k"], "o", "i", ("n",), width)
    made = running.running(df, ["k"], "o", {"s": ("sum", F.col("v")), "lo": ("min", F.struct("v", "n")), "hi": ("max", F.col("v"))}, ("n",), inclusive, {"top": ("max", F.col("n"))}, width)
    got = {r["n"]: (r["s"], r["lo"] and tuple(r["lo"]), r["hi"], r["top"]) for r in made.collect()}
    where = {r["n"]: r["i"] for r in number.collect()}
    # a null order comes first; NaN shares its bucket and comes behind it
    place = lambda r: (0, 0.0, r[2]) if r[1] is None else (1, 0.0, r[2]) if r[1] != r[1] else (2, r[1], r[2])
    for key in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == key), key=place)
        for i, r in enumerate(own):
            before = own[: i + inclusive]
            vs = [x[3] for x in before if x[3] is not None]
            lo = min(((x[3] is not None, x[3] or 0, x[2]) for x in before), default=None)
            assert where[r[2]] == i
            assert got[r[2]] == (sum(vs) if vs else None, lo and ((lo[1] if lo[0] else None), lo[2]), max(vs, default=None), max(x[2] for x in own))
    assert len(got) == 200 and running.numbered(df.limit(0), ["k"], "o", "i").count() == 0


def test_work_order_and_places_of_few(spark):
    pages = spark.createDataFrame([("a", i) for i in (0, 1, 2, 5, 9)] + [("b", 3), (None, 5), (None, 1)], "d string, index long")
    got = sorted((r["d"] or "", r["ord"], r["index"]) for r in layout.work_order(pages, "d", F.lit(5)).collect())
    assert got == [("", 0, 5), ("", 1, 1), ("a", 0, 5), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 9), ("b", 0, 3)]

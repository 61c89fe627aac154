"""Nulls, circles and empty streams: what once lost rows without a sign."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import links, memory
from quire.plans import registry
from quire.streaming import streams


@pytest.mark.parametrize("rows", [[(None, 5), (1, 2), (3, 4)], [(None, 5)], [(None, 5), (None, 6), (2, None), (9, 1)], []])
def test_running_offset_keeps_rows_without_order(spark, rows):
    df = spark.createDataFrame(rows, "i long, n long")
    got = sorted((tuple(r) for r in memory.running_offset(df, "i", "n", 2).collect()), key=str)
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    want = [(i, n, sum(m or 0 for _, m in ordered[:k])) for k, (i, n) in enumerate(ordered)] + [(None, n, None) for i, n in rows if i is None]
    assert got == sorted(want, key=str)


def test_memoised_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, 3)], "k long, j long")
    asked = []

    def measure(keys):
        asked.append(keys.count())
        return keys.withColumn("n", F.coalesce("k", F.lit(-1)) * 10 + F.coalesce("j", F.lit(0)))

    memo = spark.createDataFrame([], "k long, j long, n long")
    for _ in range(3):
        found, memo = memory.memoised(df, memo, ["k", "j"], measure)
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 1, -9), (2, None, 20), (2, 3, 23)], key=str)
        assert memo.count() == 3
    assert asked == [3, 0, 0]
    assert memory.trimmed(memo, df.where("k is null"), ["k", "j"]).count() == 1


NODES = "id string, parent string, pos int, title string, page int"


@pytest.mark.parametrize(("rows", "named"), [
    ([("r", None, 0), ("a", "b", 0), ("b", "a", 0)], "'a', 'b'"), ([("r", None, 0), ("x", "x", 0), ("y", "x", 0)], "'x', 'y'"),
    ([("r", None, 0), ("lost", "gone", 0), ("under", "lost", 0)], "'lost'"), ([("r", None, 0), ("r", None, 1)], "'r'"), ([(None, None, 0)], "None"),
])
def test_outline_names_what_is_no_tree(spark, rows, named):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], NODES)
    with pytest.raises(ValueError, match=named):
        links.outline(df)


def test_outline_against_recursion(spark):
    draw = random.Random(6)
    rows = [(f"n{k}", None if k < 3 else f"n{draw.randrange(max(0, k - 4), k)}", draw.randrange(3), "t", k) for k in range(300)]
    below = {}
    for r in rows:
        below.setdefault(r[1], []).append(r)
    want = []

    def go(node, root, depth):
        want.append((root, node[0], sum(w[0] == root for w in want), depth))
        for child in sorted(below.get(node[0], []), key=lambda r: (r[2], r[0])):
            go(child, root, depth + 1)

    for r in below[None]:
        go(r, r[0], 0)
    got = links.outline(spark.createDataFrame(rows, NODES))
    assert max(w[3] for w in want) > 40
    assert {(r["root"], r["id"], r["ord"], r["depth"]) for r in got.collect()} == set(want) and got.count() == 300
    assert links.outline(spark.createDataFrame([], NODES)).count() == 0


def test_outline_rounds_grow_with_the_logarithm(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(links, "cut", lambda df: seen.append(1) or memory.cut(df))
    rows = [(f"n{k:02}", f"n{k - 1:02}" if k else None, 0, "t", k) for k in range(41)]
    assert links.outline(spark.createDataFrame(rows, NODES)).agg(F.max("depth")).first()[0] == 40
    assert len(seen) <= 7  # the start and six rounds


@pytest.mark.parametrize("files", [False, True])
def test_remember_of_an_empty_stream(spark, tmp_path, files):
    schema = "k long, o long, v string"
    (tmp_path / "in").mkdir()
    if files:
        spark.createDataFrame([], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.remember(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "o", "v")
    assert got.columns == ["k", "o", "v"] and got.count() == 0


def test_normal_offsets_of_null_and_empty_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "a b\x0bc"), (5, "\n\U0001f468\u200d\U0001f469\x00"), (6, "\u00a0e\u0301\u0085")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.queries()["normal_offsets"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(registry.oracle_sql()["normal_offsets"]).fetchall())
    assert got[:3] == [(1, None, -1, 0), (2, 1, 0, 0), (3, 0, -1, 0)]

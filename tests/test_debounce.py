"""Typed queries against a loop over the events, in one run, in many batches and across a restart."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest

from quire.streaming import debounce

SCHEMA = "key string, at timestamp, n long, kind string, text string"
START = datetime(2024, 3, 1)


def looped(events, wait):
    sent, waiting = [], {}
    for key, at, _, kind, text in sorted(events, key=lambda e: (e[1], e[2])):
        us = round((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        if key in waiting and waiting[key][1] <= us:
            sent.append((key, *waiting.pop(key), "wait"))
        if kind == "type":
            waiting[key] = (text, us + wait * 1000)
        elif kind == "enter":
            sent.append((key, text, us, "enter"))
            waiting.pop(key, None)
        elif kind == "escape":
            waiting.pop(key, None)
    return sent, [(k, *v, "wait") for k, v in waiting.items()]


def events(seed, n=400):
    draw = random.Random(seed)
    at, out = 0, []
    for k in range(n):
        at += draw.choice([0, 1, 40, 159, 160, 161, 900])
        out.append((draw.choice("abcd"), START + timedelta(milliseconds=at, microseconds=draw.choice([0, 0, 7])), k, draw.choice(["type", "type", "type", "enter", "escape", None, "other"]), f"q{k}"))
    return sorted(out, key=lambda e: (e[1], e[2]))


def put(spark, folder, part, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={part}")


def rows(df):
    return sorted(map(tuple, df.select("key", "text", "sent", "cause").collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_equal_to_a_loop_also_across_restarts(spark, tmp_path, parts):
    every, folder, root = events(parts), str(tmp_path / "in"), str(tmp_path / "root")
    step = -(-len(every) // parts)
    for k in range(parts):
        put(spark, folder, k, every[k * step : (k + 1) * step])
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/part=*")
        found, _ = debounce.sent_queries(spark, stream, 160, root)
    sent, waiting = looped(every, 160)
    assert rows(found.unionByName(debounce.pending(spark, root))) == sorted(sent + waiting)
    assert len(sent) > 100 and {c for *_, c in sent} == {"wait", "enter"}


def test_nothing_and_rows_without_key_or_time(spark, tmp_path):
    put(spark, str(tmp_path / "in"), 0, [(None, START, 1, "type", "x"), ("a", None, 1, "type", "x"), ("a", START, 1, None, "x")])
    found, root = debounce.sent_queries(spark, spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*"), 160, str(tmp_path / "r"))
    assert found.count() == 0 and debounce.pending(spark, root).count() == 0


def test_no_worker_is_asked_for_a_key(spark, tmp_path):
    """Queries come from a window of Spark's, in few seconds however many keys there are; a worker's answers for each key took many."""
    events = spark.range(200_000).selectExpr("cast(id % 100000 AS string) AS key", "timestamp_seconds(id) AS at", "id AS n", "CASE WHEN id < 100000 THEN 'type' ELSE 'enter' END AS kind", "cast(id AS string) AS text")
    events.write.parquet(str(tmp_path / "in/part=0"))
    began = time.time()
    found, root = debounce.sent_queries(spark, spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*"), 200_000_000, str(tmp_path / "r"))
    assert {(r["cause"], r["count"]) for r in found.groupBy("cause").count().collect()} == {("enter", 100_000)} and debounce.pending(spark, root).count() == 0
    assert time.time() - began < 20


def test_rows_of_the_watermarks_own_time_are_not_late(spark, tmp_path):
    """A row as old as the latest one of an earlier batch counts, an older one does not; what waits outlives batches that don't touch it."""
    second = lambda s: START + timedelta(seconds=s)
    parts = [[("a", second(10), 0, "type", "x"), ("b", second(10), 1, "type", "w")], [("a", second(10), 2, "enter", "y"), ("a", second(9), 3, "enter", "late")], [(None, second(11), 4, "type", "z")], [("c", second(15), 5, None, "z")]]
    for k, part in enumerate(parts):
        put(spark, str(tmp_path / "in"), k, part)
        found, root = debounce.sent_queries(spark, spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*"), 4000, str(tmp_path / "r"))
        assert [r["text"] for r in debounce.pending(spark, root).orderBy("text").collect()] == [["w", "x"], ["w"], ["w"], []][k]
    assert sorted((r["text"], r["cause"]) for r in found.collect()) == [("w", "wait"), ("y", "enter")]

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, links, memory, rules
from quire.sources import documents as src
from quire.streaming import streams


def test_binary_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"", "c.pdf": b"\x00" * 4096, "d.pdf": b"plain"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].split("/")[-1]: r["is_document"] for r in src.binary(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "c.pdf": False, "d.pdf": False}  # Spark lists no empty files
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.binary(spark, str(tmp_path / "none")).count()


def test_page_runs(spark):
    pages = spark.createDataFrame([(1, "<p>A &amp; <b>B</b></p><div>no</div><li>x</li>"), (2, None), (3, "")], "page_id int, html string")
    got = {r["page_id"]: r["runs"] for r in src.page_runs(pages).collect()}
    assert got == {1: ["A & B", "x"], 2: None, 3: []}


def test_metadata_falls_back(spark):
    docs = spark.createDataFrame([(0, "T\nx", " ", None), (1, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in src.metadata(docs).orderBy("doc_id").collect()] == [(0, "T", "", "1"), (1, "", "s", "en")]


def test_write_runs(spark, tmp_path):
    src.write_runs(spark.createDataFrame([(1, 1, "b"), (1, 0, "a<")], "page_id int, run_no int, text string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a&lt;", "b"]


@pytest.mark.parametrize(
    ("tag", "want"),
    [('<a href="https://x" data-page="3" data-y="1.5">', ("https://x", 3, 1.5, True)), ('<a data-page="x">', None), ('<a data-page="2" data-y="q">', (None, 2, None, False))],
)
def test_anchor(spark, tag, want):
    got = spark.createDataFrame([(tag,)], "t string").select(links.anchor_target(F.col("t")).alias("a")).first()["a"]
    assert (None if got is None else tuple(got)) == want


def test_hit_areas(spark):
    rows = [("internal", 1, 0.0, 5.0), ("internal", -1, 0.0, 5.0), ("external", -1, 0.0, 5.0), ("external", -1, 5.0, 5.0), ("external", -1, float("nan"), 5.0)]
    df = spark.createDataFrame([(k, p, a, 0.0, b, 1.0) for k, p, a, b in rows], "kind string, target_page int, x0 double, y0 double, x1 double, y1 double")
    assert links.hit_areas(df).count() == 2


def test_adoption_and_order(spark):
    stored = spark.createDataFrame([(0, "^a"), (1, "^z")], "ord int, pattern string")
    explained, own = rules.adopt(stored, spark.createDataFrame([("r", "^a")], "id string, pattern string"))
    assert [tuple(r) for r in explained.collect()] == [(0, "r", "^a")] and [r["pattern"] for r in own.collect()] == ["^z"]


def events(spark, n=40):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(milliseconds=100 * i), i % 3, float(i)) for i in range(n)], "event_id long, ts timestamp, user_id long, value double")


def test_walk_resumes(spark, tmp_path):
    events(spark).repartition(20).write.parquet(str(tmp_path / "events.parquet"))
    schema, root = spark.read.parquet(str(tmp_path / "events.parquet")).schema, str(tmp_path / "state")
    seen = streams.Progress()
    spark.streams.addListener(seen)
    out = streams.walk(spark, str(tmp_path), "events", schema, lambda s: s.select("event_id"), checkpoint=root)
    assert spark.read.parquet(out).count() == 40
    spark.createDataFrame([(100, dt.datetime(2024, 1, 2), 0, 1.0)], schema).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    streams.walk(spark, str(tmp_path), "events", schema, lambda s: s.select("event_id"), checkpoint=root)
    spark.streams.removeListener(seen)
    ids = [r["event_id"] for r in spark.read.parquet(out).collect()]
    assert len(ids) == len(set(ids)) == 41


def test_throttle_against_a_loop(spark):
    df = events(spark, 60).where("event_id % 7 <> 0").repartition(4)
    got = sorted((r["user_id"], r["n"], r["opened"]) for r in streams.throttle(df, "user_id", "ts", 400).collect())
    want = []
    for u in range(3):
        opened, n = None, 0
        for t in sorted(r["ts"] for r in df.where(F.col("user_id") == u).collect()):
            if opened is None or t > opened + dt.timedelta(milliseconds=400):
                if opened is not None:
                    want.append((u, n, opened))
                opened, n = t, 0
            n += 1
        want.append((u, n, opened))
    assert got == sorted(want)


def test_settle_and_generations(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 0, 1000 * m)) for m in (0, 100, 400)], "k int, ts timestamp")
    assert sorted(r["n"] for r in memory.settle(df, "k", "ts", "150 milliseconds").collect()) == [1, 2]
    late = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "own")], "k int, generation int, v string")
    assert sorted(r["v"] for r in memory.current_generation(late, "k").collect()) == ["new", "own"]


def test_tolerant_load(spark):
    rows = [("", '{"pos":{"page":1}}'), ("url:ok", '{"pos":{"page":0.2,"y":"x"}}'), ("url:bad", "{"), ("url:none", "{}"), ("url:text", '"x"'), ("url:second", '{"pos":{"page":3,"y":10},"settings":{"a":1}}'), ("url:null", "null")]
    df = spark.createDataFrame([(i, k, j) for i, (k, j) in enumerate(rows)], "ord int, key string, json string")
    got = [(r["key"], r["page"], r["y"], r["settings"]) for r in memory.tolerant(df, "key", "json").collect()]
    assert got == [("url:ok", 1, None, None), ("url:second", 3, 10.0, '{"a":1}')]


def test_layout_rows(spark):
    pages = spark.createDataFrame([("d", i, 100.0, 50.0) for i in range(4)], "doc string, index long, width double, height double")
    assert layout.retain_nearest(pages, "doc", F.lit(1), 2).select("index").distinct().count() == 2
    ahead = layout.lookahead(pages, F.lit(1), F.lit(1), F.lit(-1), 2)
    assert [r["index"] for r in ahead.collect()] == [0]


def test_walk_goes_past_a_bad_file(spark, tmp_path):
    for i, value in enumerate(["1", "2", "bad", "4"]):
        spark.createDataFrame([(i, value)], "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows.parquet"))
    step = lambda s: s.select("id", F.col("text").cast("int").alias("n"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    out = streams.walk(spark, str(tmp_path), "rows", "id long, text string", step, checkpoint=str(tmp_path / "state"))
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    warned = streams.warnings(spark, out).collect()
    assert len(warned) == 1 and "rows.parquet" in warned[0]["file"] and warned[0]["reason"]


def test_walk_without_warnings(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "events.parquet"))
    out = streams.walk(spark, str(tmp_path), "events", spark.read.parquet(str(tmp_path / "events.parquet")).schema, lambda s: s, checkpoint=str(tmp_path / "state"))
    assert streams.warnings(spark, out).count() == 0

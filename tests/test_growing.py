"""The growing index against a search of everything, across searches, sessions and interruptions."""

from __future__ import annotations

import random

import pytest

from quire.functions import files
from quire.operators import search
from quire.streaming.growing import GrowingIndex


def pages(spark, n=400):
    draw = random.Random(9)
    rows = [(k // 2 * 2, [draw.choice(["the cat", "a The", "do", "", None, "t h e"]) for _ in range(draw.randint(0, 6))]) for k in range(n)]
    rows[7] = (7, ["needle in the hay"])
    return spark.createDataFrame([*rows, (None, ["the"]), (None, None)], "page_id long, runs array<string>").repartition(5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def built(monkeypatch):
    """The slices that were read from the source."""
    seen = []
    original = GrowingIndex.build

    def build(self, number):
        if not self.built(number):
            seen.append(number)
        original(self, number)

    monkeypatch.setattr(GrowingIndex, "build", build)
    return seen


def test_grows_only_as_far_as_needed(spark, tmp_path, built):
    runs = pages(spark)
    index = GrowingIndex(runs, str(tmp_path / "i"), slices=5)
    few, more = index.search("The", 10)
    assert more and rows(few) == rows(search.hits(runs, "The", most=10)) and few.first()["page_id"] is None
    assert len(built) < index.slices
    before = list(built)
    again, _ = index.search("the", 10)
    assert rows(again) == rows(few) and built == before  # nothing more is read
    all_, cut = index.search("needle", 10)
    assert not cut and rows(all_) == rows(search.hits(runs, "needle", most=10)) and sorted(built) == list(range(index.slices))
    whole, cut = index.search("the", 100_000)
    assert not cut and rows(whole) == rows(search.hits(runs, "the", most=100_000)) and len(built) == index.slices


def test_taken_up_by_another_session_and_after_an_interruption(spark, tmp_path, built):
    runs, folder = pages(spark), str(tmp_path / "i")
    GrowingIndex(runs, folder, slices=4).search("the", 3)
    first = list(built)
    broken = first[-1] + 1
    GrowingIndex(runs, folder, slices=4).pages(0, 1).limit(1).write.parquet(f"{folder}/pages/slice={broken}")  # as a write that was stopped leaves it
    files.delete(spark, f"{folder}/pages/slice={broken}/_SUCCESS")
    index = GrowingIndex(runs, folder, slices=9)  # the cuts are the index's own
    assert index.slices <= 4
    found, _ = index.search("needle")
    assert rows(found) == rows(search.hits(runs, "needle"))
    assert sorted(built) == list(range(index.slices))  # each slice once
    assert sorted(r["page_id"] or -1 for r in index.pages(0, index.slices).collect()) == sorted(r["page_id"] or -1 for r in runs.collect())


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, runs array<string>")
    hits, more = GrowingIndex(empty, str(tmp_path / "e")).search("x")
    assert hits.count() == 0 and not more
    hits, more = GrowingIndex(pages(spark), str(tmp_path / "q")).search("  ")
    assert hits.count() == 0 and not more
    one = spark.createDataFrame([(None, ["x x"])], empty.schema)
    hits, more = GrowingIndex(one, str(tmp_path / "o")).search("x", 1)
    assert hits.count() == 1 and more


def test_marker_files(spark, tmp_path):
    path = str(tmp_path / "m" / "one")
    assert files.put_new(spark, path, "first") and not files.put_new(spark, path, "second")
    assert files.text(spark, path) == "first" and [n for n in files.names(spark, str(tmp_path / "m")) if not n.endswith(".crc")] == ["one"]
    files.delete(spark, path)
    assert not files.exists(spark, path) and files.names(spark, str(tmp_path / "nowhere")) == []

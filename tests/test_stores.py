"""The sink of a file per page, and the corpus that is fetched once."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.sources import corpus, page_files
from quire.sources.stores import file_name, located, put_whole


def held(folder):
    return sorted((p.name, p.read_bytes().decode()) for p in Path(folder).rglob("*.txt"))


def others(folder):
    return [p.name for p in Path(folder).rglob("*") if p.is_file() and p.suffix != ".txt"]


def test_a_file_for_each_page(spark, tmp_path):
    rows = [(k, f"page {k}\nü") for k in range(50)] + [(None, "no key"), (7, "again"), (99, None), (98, "")]
    df = spark.createDataFrame(rows, "page long, text string").coalesce(1).unionByName(spark.createDataFrame([(1000, "other")], "page long, text string"))
    page_files.write_pages(df, "page", "text", str(tmp_path / "out"))
    want = sorted([(f"{k}.txt", f"page {k}\nü") for k in range(50)] + [("_.txt", "no key"), ("7-2.txt", "again"), ("99.txt", ""), ("98.txt", ""), ("1000.txt", "other")])
    assert held(tmp_path / "out") == want and others(tmp_path / "out") == ["_SUCCESS"]
    page_files.write_pages(df.where("page = 98"), "page", "text", f"file://{tmp_path}/out")
    assert len(held(tmp_path / "out")) == len(want) + 1
    page_files.write_pages(df.where("page = 98"), "page", "text", str(tmp_path / "out"), "overwrite")
    assert held(tmp_path / "out") == [("98.txt", "")]
    page_files.write_pages(df.where("page < 0"), "page", "text", str(tmp_path / "none"))
    assert others(tmp_path / "none") == ["_SUCCESS"] and held(tmp_path / "none") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def broken(k):
        if k == 35:
            raise ValueError("lost")
        return "x"

    df = spark.range(0, 40, 1, 4).select(F.col("id").alias("page"), broken("id").alias("text"))
    page_files.write_pages(df.where("page < 30"), "page", "text", str(tmp_path / "out"))
    with pytest.raises(Exception, match="lost"):
        page_files.write_pages(df, "page", "text", str(tmp_path / "out"), "overwrite")
    assert len(held(tmp_path / "out")) == 30 and others(tmp_path / "out") == ["_SUCCESS"]
    assert not (tmp_path / "out" / "_temporary").exists()


def test_names():
    keys = [None, "", "_", "a/b", "a b", "..", ".", "x" * 500, "x" * 501, "%5F", "ü"]
    names = [file_name(k) for k in keys]
    assert len({n for k, n in zip(keys, names, strict=True) if k is not None}) == len(keys) - 1 and all("/" not in n and n not in (".", "..") and len(n) < 200 for n in names)
    assert located("file:/tmp/x")[1] == located("file:///tmp/x")[1] == located("/tmp/x")[1] == "/tmp/x"


@pytest.fixture
def listed(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "list").mkdir()
    lines = []
    for k in range(200):
        (tmp_path / "src" / f"{k}.pdf").write_bytes((b"%PDF" if k % 10 else b"HTML") + str(k).encode() * (k + 1))
        lines.append(f"n{k}\tfile://{tmp_path}/src/{k}.pdf")
    lines += ["", f"gone\t{tmp_path}/src/none.pdf", f"twice\tfile://{tmp_path}/src/1.pdf", f"{tmp_path}/src/2.pdf", "odd\tnowhere://x"]
    (tmp_path / "list" / "a.txt").write_text("\n".join(lines[:120]))
    (tmp_path / "list" / "b.txt").write_text("\n".join(lines[120:]) + "\n")
    return tmp_path


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_ranges_of_a_list_give_each_line_once(listed, size):
    reader = corpus.CorpusReader({"list": str(listed / "list"), "cache": "x", "range": str(size)})
    parts = reader.partitions()
    names = [name for p in parts for name, _ in p.entries(located(p.path)[0])]
    assert sorted(names) == sorted([f"n{k}" for k in range(200)] + ["gone", "twice", f"{listed}/src/2.pdf", "odd"])


def test_fetched_once(spark, listed):
    read = lambda: {r["name"]: r for r in corpus.read_corpus(spark, str(listed / "list"), f"file://{listed}/cache", size=900).collect()}
    first = read()
    assert len(first) == 204 and not any(r["cached"] for n, r in first.items() if n not in ("twice",))
    good = {n for n, r in first.items() if r["problem"] is None}
    assert good == {f"n{k}" for k in range(200) if k % 10} | {"twice", f"{listed}/src/2.pdf"}
    assert first["n0"]["problem"] == "another beginning" and "FileNotFound" in first["gone"]["problem"] and first["odd"]["content"] is None
    for k in range(200):  # the sources are gone or changed, which a second read of cached files does not see
        (listed / "src" / f"{k}.pdf").unlink()
    second = read()
    assert {n: bytes(second[n]["content"]) for n in good} == {n: bytes(first[n]["content"]) for n in good} and all(second[n]["cached"] for n in good)
    assert not [p for p in (listed / "cache").iterdir() if p.suffix == ".part"]


def test_racing_readers_leave_one_whole_file(tmp_path):
    store = located(str(tmp_path))[0]
    place = f"{tmp_path}/one"
    contents = [bytes([65 + k]) * 200_000 for k in range(8)]
    threads = [threading.Thread(target=put_whole, args=(store, place, c)) for c in contents]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert Path(place).read_bytes() in contents and [p.name for p in tmp_path.iterdir()] == ["one"]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_pages_are_listed_in_tasks(spark, tmp_path, scheme):
    """Written pages come back under their names in as many parts as the sink's tasks at most; empty ones can be told by their size."""
    df = spark.range(0, 3000, 1, 3).select(F.col("id").alias("page"), F.when(F.col("id") % 100 != 7, F.concat(F.lit("page "), "id")).alias("text"))
    page_files.write_pages(df, "page", "text", f"{scheme}{tmp_path}/out")
    found = page_files.listed_pages(spark, f"{scheme}{tmp_path}/out")
    assert found.rdd.getNumPartitions() <= 3
    got = {r["name"]: r for r in found.collect()}
    assert len(got) == 3000 and {n for n, r in got.items() if not r["size"]} == {str(k) for k in range(7, 3000, 100)}
    assert all(Path(located(r["uri"])[1]).stat().st_size == r["size"] for r in got.values())
    page_files.write_pages(df.limit(0), "page", "text", f"{scheme}{tmp_path}/none")
    assert page_files.listed_pages(spark, f"{scheme}{tmp_path}/none").count() == 0

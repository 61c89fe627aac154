from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from quire.llm import bpe_model, pii  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, in_text int"


def corpus():
    rng = random.Random(12)
    words = [a + b for a in ("the", "re", "in", "on", "was", "er") for b in ("", "ing", "tion", "ly", "ed", "ble", "est")]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) + "." for _ in range(90)]
    clean[3] += " Write to jo.doe@mail.example.com or +1 (743) 555-3824."
    copy = clean[5].split(" ")
    copy[7] = "another"
    junk = [" ".join(rng.choice(words).upper() + "!!" for _ in range(80)) for _ in range(30)]
    texts = [*clean, " ".join(copy), clean[6], *junk, None, "", "too short", "again and again " * 40]
    rows = [(i, t, "en", "s", len(t or ""), "own", 1) for i, t in enumerate(texts)]
    labels = [(i, 1) for i in range(0, 90, 2)] + [(i, 0) for i in range(92, 122)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    spark.createDataFrame([*rows, rows[10]], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def stages(spark, folder, out):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        seen.append((name, docs))
    return seen


def test_stages_against_brute_force(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "personal data", "packing"]
    rows, _ = corpus()
    text = {r[0]: r[1] for r in rows}
    found = stages(spark, folder, str(tmp_path))
    names = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert all(d.columns == names for _, d in found[:-1])
    kept = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for _, d in found[:4]]
    clean = [*range(92)]
    assert kept[0] == kept[1] == sorted([*clean, 10])  # what is clean stays, junk, short and empty texts go
    sets = {}
    for i in clean:
        w = text[i].lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    gone = {j for j in clean for i in clean if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert gone == {90, 91} and kept[2] == kept[3] == [i for i in clean if i not in gone]
    for r in found[3][1].collect():
        assert r["text"] == pii.masked(text[r["doc_id"]]) and r["n_chars"] == len(r["text"]) and (r["kept"], r["in_text"]) == ("own", 1)
    assert not any(re.search("@|555", r["text"]) for r in found[3][1].collect())
    library = bpe_model.load(bpe_model.default_path()).library
    for p in found[4][1].collect():
        ids = [*library.encode(pii.masked(text[p["doc_id"]]), add_special_tokens=False).ids, 1]
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) and p["doc_tokens"] == len(ids)
    last = sorted(map(tuple, found[4][1].collect()))
    done = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert sum(r[2] for r in last) == sum(r[2] for r in done) and {r[0] for r in last} == {r[0] for r in done}


def test_empty_tables(spark, folder, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_null_ids_survive(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    unnamed = spark.createDataFrame([(None, "w " * 60, "en", "s", 120, "own", 1)], SCHEMA)
    out = corpus_pipeline.near_dup_stage(spark, docs.where("doc_id < 20").unionByName(unnamed), folder)
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [*range(20)]
    assert out.where("doc_id is null").count() == 1


def test_near_duplicates_of_shared_and_missing_ids(spark):
    rng = random.Random(9)
    a, b, c, e = (" ".join(f"{name}{rng.randrange(90)}" for _ in range(40)) for name in "abce")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, a), (None, c), (None, c), (None, e), (4, e), (None, ""), (None, ""), (3, " "), (3, c + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dup_stage(spark, docs, "").collect()
    want = [(1, a), (1, b), (4, e), (None, ""), (None, ""), (3, " "), (3, c + " more")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_columns_of_any_name(spark, folder):
    rows, _ = corpus()
    more = "doc_id long, text string, lang string, source string, n_chars long, __key_of int, __id int, __quire int, `a.b` string, in1 int, kept int"
    docs = spark.createDataFrame([(r[0], r[1], "en", "s", r[4], 77, 78, 79, "dot", 80, 81) for r in rows], more)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(tuple(r)[5:] == (77, 78, 79, "dot", 80, 81) for r in kept)


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "string", "int"])
def test_packing_ids_of_any_type(spark, kind):
    from quire.llm import packing

    docs = spark.createDataFrame([(i, "a few words " * (i * 40)) for i in range(9)], "doc_id long, text string").repartition(3).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "doc_id as id")
    got = packing.pieces(packing.pack(docs, window=64)).collect()
    assert {str(r["doc_id"]).split(".")[0] for r in got} == {str(i) for i in range(9)}
    at, spans = {}, {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert sorted(at) == list(range(len(at)))
    for k, own in [*at.items(), *((None, [(s, n) for s, n, _ in v]) for v in spans.values())]:  # sequences without gaps, pieces disjoint
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert k is None or k == len(at) - 1 or sum(n for _, n in own) == 64
    assert all(sum(n for _, n, _ in v) == v[0][2] for v in spans.values())

"""Every registered opN_ query as it is registered: columns, types and rows on the smallest tables."""

from __future__ import annotations

import pytest

pytest.importorskip("quire.llm")

from quire.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
L, I, S, B, D = "bigint", "int", "string", "boolean", "double"

#: The contracts' columns; others may follow.
COLUMNS = {
    "op1": {"doc_id": L, "size": L, "text_crc32": L, "law": S, "shard": I, "slot": L, "grown_shard": I},
    "op2": {"conv_id": L, "n_turns": L, "turns_sha256": S, "loss_chars": L, "loss_sha256": S, "formatted_chars": L},
    "op3": {"doc_id": L, "start": L, "length": L, "ids_crc32": L, "doc_tokens": L, "sequence_id": L, "offset": L},
    "op4": {"doc_id": L, "n_bytes": L, "n_tokens": L, "over_limit": B},
    "op5": {"doc_id": L, "n_email": L, "n_ip": L, "n_card": L, "n_phone": L, "base_sha256": S, "spans": S},
    "op6": {"doc_id": L, "n_shingles": L, "component_id": L, "kept": B},
    "op7": {"query_id": L, "rank": I, "doc_id": L, "score": D},
    "op8": {"doc_id": L, "held_out": B, "score": D, "predicted": I},
    "op9": {"doc_id": L, "n_tokens": L, "ids_sha256": S, "decoded_sha256": S},
    "op10": {"doc_id": L, "n_words": L, "word_chars": L, "n_symbols": L, "n_dup_lines": L, "n_repeat_words": L, "base_failed": B, "kept": B},
    "op11": {"pattern": S, "length": I, "support": L, "clients_crc": L, "n_wider": L, "closed": B},
    "op12": {"doc_id": L, "n_assign": L, "n_access": L, "n_hex": L, "base_sha256": S, "spans": S},
    "op13": {"lang": S, "source": S, "part": S, "item": S, "value": L, "rank": I},
}
#: A row for each document.
BY_DOCUMENT = ("op1", "op4", "op5", "op6", "op8", "op9", "op10", "op12")


@pytest.mark.parametrize("name", sorted({*queries.queries()} - {"pipeline"}))
def test_columns_types_and_rows(spark, name):
    op = name.partition("_")[0]
    found = queries.queries()[name](spark, FOLDER).cache()
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in COLUMNS[op]} == COLUMNS[op]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = found.count()
    if op in BY_DOCUMENT:
        assert rows == docs.count() and found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    elif op == "op2":
        assert rows == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1
        assert found.where("conv_id = -7").first()["n_turns"] == 2
    elif op == "op3":
        assert found.select("doc_id").distinct().count() == docs.count()
        assert found.groupBy().sum("length").first()[0] == found.select("doc_id", "doc_tokens").distinct().groupBy().sum("doc_tokens").first()[0]
    else:
        assert rows > 0
    if op == "op1":
        assert {r["law"] for r in found.select("law").distinct().collect()} == {"bytes"} and found.where("shard not between 0 and 15 or grown_shard is not null").count() == 0
    found.unpersist()


def test_all_are_there():
    assert {n.partition("_")[0] for n in queries.queries()} - {"pipeline"} == {*COLUMNS}


def test_equal_texts_share_a_shard(spark):
    """On the small tables no group is so large that it must be split, and sizes stay near equal."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.queries()["op1_shard"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "text"), "doc_id").collect()
    by_text, sizes = {}, {}
    for r in found:
        by_text.setdefault(r["text"], set()).add(r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(by_text) < len(found) and all(len(s) == 1 for s in by_text.values())
    assert max(sizes.values()) < 1.05 * min(sizes.values())

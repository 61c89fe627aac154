from __future__ import annotations

import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from quire.llm import bpe_codec, bpe_model, packing, token_count  # noqa: E402

HARD = [
    None, "", "   \n", "Hello, World's 123 ½²", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "!" * 3000, "ab" * 2000 + " İstanbul ΑΣ ς", "éá x", "aaaa" * 40, "x\x1cy \x85z w",
    "日本語 テスト 😀😀 ಕನ್ನಡ", "a" * 20000, "Straße ÀÉÎ œuvre Ⱥb",
]


@pytest.fixture(scope="module")
def model():
    return bpe_model.load(bpe_model.default_path())


def library(model, text):
    return model.library.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts=HARD, **more):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:2]], "doc_id long, text string, n_tokens string")


def test_single_characters(model):
    e = bpe_model.Encoder(model)
    for k in [*range(1, 0x400), 0x1E9E, 0x2028, 0xFB01, 0xAC00, 0x1F600]:
        s = f"a{chr(k)}b {chr(k)} 1{chr(k)}'s"
        assert np.frombuffer(e.encode([s])[0], "<u4").tolist() == library(model, s), hex(k)


def test_counts(spark, model):
    got = token_count.token_counts(frame(spark)).collect()
    assert len(got) == len(HARD) + 2
    for r in got:
        text = HARD[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len((text or "").encode()), len(library(model, text)))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert token_count.token_counts(frame(spark).limit(0)).count() == 0


def test_codec_round_trip(spark, model):
    for r in bpe_codec.decode(bpe_codec.encode(frame(spark))).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library(model, HARD[r["doc_id"]])
        assert r["decoded"] == model.library.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode(frame(spark).limit(0)).count() == 0


def test_speculation_needs_verification(model):
    c = bpe_codec.Codec(model)
    words = [w.encode() for w in "thinking unhappiness internationalisation rererere ththth onononer".split()]
    c.encode_words(words)
    assert c.proposed == len(words) and 0 < c.exact <= len(words)


def test_packing_keeps_every_token_once(spark, model):
    docs = frame(spark)
    made = packing.pack(docs, window=64)
    seqs = sorted(made.collect(), key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in seqs] == list(range(len(seqs)))
    assert all(r["n_tokens"] == 64 for r in seqs[:-1]) and 0 < seqs[-1]["n_tokens"] <= 64
    parts: dict[tuple, list] = {}
    for r in packing.pieces(made).collect():
        parts.setdefault(r["doc_id"], []).append(r)
    for d, own in parts.items():
        ids = [*library(model, HARD[d]), 1]
        times = 2 if d < 2 else 1
        assert sum(p["length"] for p in own) == times * len(ids)
        for p in own:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    assert packing.pieces(packing.pack(docs.limit(0))).count() == 0
    last = packing.padded(made, 64).orderBy("sequence_id").tail(1)[0]
    assert len(last["input_ids"]) == 64 * 4

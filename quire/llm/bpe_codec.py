"""BPE encoding and decoding by speculation and verification.

Greedy longest-match proposes the tokens of each new pre-token; every adjacent pair of a proposal is tested for
compatibility (merging the two tokens' own symbols gives back exactly these two tokens), all unseen pairs of a batch in
one vectorised call; only words with a failing pair, or with a token that merging would not build, are merged exactly.

Defined results: a null or empty text encodes to no ids and decodes to the empty text; special strings become their
ids, as the library does by default; decoding joins the tokens' strings by single blanks, as the library does for a
vocabulary without a decoder. Repeated rows are encoded each; other columns are not read; an empty table gives an
empty result. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_model
from .common import forgets, mapped, slices, string_list

#: Entries of a worker's memo of token pairs, which is emptied when full; the memos of pieces and words have bounds of their own.
PAIRS = 200_000


class Codec(bpe_model.Encoder):
    """An encoder whose new words are proposed, verified, and merged only where a check fails."""

    def __init__(self, model: bpe_model.BpeModel):
        super().__init__(model)
        self.exact = self.proposed = 0
        # a token may only be proposed if merging its own symbols builds it
        own = [(i, b, end) for i, (b, end) in model.spell.items()]
        flat, sizes = self._symbols([(b, end) for _, b, end in own])
        merged, counts = model.merge(flat, sizes)
        at = np.cumsum(counts) - counts
        self.built = {i for (i, _, _), n, first in zip(own, counts.tolist(), merged[at].tolist(), strict=True) if n == 1 and first == i}

    def forget(self) -> None:
        super().forget()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _symbols(self, spelled: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        flat, sizes = m.symbols([b for b, _ in spelled])
        ends = np.cumsum(sizes) - 1
        raw = np.array([b[-1] for b, _ in spelled])
        closed = np.array([end for _, end in spelled])
        flat[ends] = np.where(closed, flat[ends], m.first[raw])
        return flat, sizes

    def propose(self, word: bytes) -> list[int]:
        m, out, at, n = self.model, [], 0, len(word)
        inner, final, longest = m.inner, m.final, m.longest
        while at < n:
            rest = n - at
            if rest <= longest and (t := final.get(word[at:])) is not None:
                out.append(t)
                break
            for size in range(min(longest, rest - 1), 0, -1):
                if (t := inner.get(word[at : at + size])) is not None:
                    break
            out.append(t)
            at += size
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        m = self.model
        proposals = {w: self.propose(w) for w in words}
        self.proposed += len(proposals)
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        new = list({p for ts in proposals.values() for p in zip(ts, ts[1:], strict=False) if p not in self.pairs})
        if new:
            spelled = [(m.spell[a][0] + m.spell[b][0], m.spell[b][1]) for a, b in new]
            merged, counts = m.merge(*self._symbols(spelled))
            at = np.cumsum(counts) - counts
            want = np.array(new, dtype=np.int64)
            two = counts == 2
            second = merged[np.minimum(at + 1, len(merged) - 1)]
            fits = two & (merged[at] == want[:, 0]) & (second == want[:, 1])
            self.pairs.update(zip(new, fits.tolist(), strict=True))
        pairs, built = self.pairs, self.built
        failing = [w for w, ts in proposals.items() if not all(t in built for t in ts) or not all(pairs[p] for p in zip(ts, ts[1:], strict=False))]
        self.exact += len(failing)
        if failing:
            merged, counts = m.merge_words(failing)
            ends = np.cumsum(counts)
            for w, a, b in zip(failing, (ends - counts).tolist(), ends.tolist(), strict=True):
                proposals[w] = merged[a:b].tolist()
        return [np.array(proposals[w], dtype="<u4").tobytes() for w in words]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(bpe_model.load(path))
    return _CODECS[path]


@forgets
def _forget() -> None:
    for c in _CODECS.values():
        c.forget()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    path = path or bpe_model.default_path()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = c.encode(string_list(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array(ids, type=pa.binary())], names=["id", "n_tokens", "ids"])

    return mapped(source, run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded`, the text of the binary column `ids`; null ids decode to the empty text."""
    path = path or bpe_model.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = bpe_model.tokens(path).__getitem__
        for whole in batches:
            for batch in slices(whole, "ids"):
                texts = [" ".join(map(token, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return mapped(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))

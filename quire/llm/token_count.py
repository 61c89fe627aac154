"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker has not met are held as one ragged numpy array; each round applies every sequence's
lowest-ranked pair at once, and the symbols that survive are counted. A bounded memo keeps the counts of pieces
already seen, so a common word is merged once per worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; blank texts have bytes
but no tokens; special strings inside a text are one token, as the library does by default; other columns, whatever
their names, are not read. An empty table gives an empty result. No shuffle: one pass over the texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_model
from .common import MEMO_KEY, forgets, mapped, slices, string_list

#: Entries of a worker's memo; when full, it keeps what the current batch uses; this bounds memory and changes no result.
MEMO = 400_000

_memo: dict[str, dict[str, int]] = {}
forgets(_memo.clear)


def count_texts(model: bpe_model.BpeModel, texts: list[str]) -> list[int]:
    special = dict.fromkeys(model.special, 1)
    memo = _memo.setdefault(model.path, dict(special))
    cut = [model.pieces(t) for t in texts]
    used = set(itertools.chain.from_iterable(cut))
    new = list(used.difference(memo))
    if new:
        if len(memo) + len(new) > MEMO:
            memo = _memo[model.path] = {p: memo[p] for p in used if p in memo} | special
        new, flat, ends = model.words(new)
        words = list(set(flat))
        size: dict[str, int] = {}
        if words:
            _, sizes = model.merge_words([w.encode() for w in words])
            size = dict(zip(words, sizes.tolist(), strict=True))
        total = [0, *itertools.accumulate(map(size.__getitem__, flat))]
        memo.update(zip(new, [total[b] - total[a] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
    out = [sum(map(memo.__getitem__, ps)) for ps in cut]
    if max(map(len, new), default=0) > MEMO_KEY:
        for p in new:
            if len(p) > MEMO_KEY:
                memo.pop(p, None)
    return out


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = path or bpe_model.default_path()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe_model.load(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = string_list(batch.column("text"))
                n = np.array(count_texts(model, texts), dtype=np.int64)
                sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(source, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

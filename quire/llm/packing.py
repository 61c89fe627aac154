"""Packing by concatenating and cutting.

Pass one encodes every document, closes it with the end token, and keeps for each its offset inside its partition;
the partitions' token totals (one number each) give every partition's global offset by a prefix sum. Pass two cuts the
token stream at multiples of the window: windows that lie inside one stream of rows are emitted whole, the pieces of
windows that cross a border between partitions are emitted as boundary records, from the rows at the borders alone, and
joined afterwards, two per partition at most. Only the last sequence is padded.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; sequences follow the order
of the scan, which is fixed by the checkpoint between the passes; other columns are not read; an empty table gives no
sequence. Encoding merges each new pre-token as token_count does.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_model
from .common import arrow_type, cut, mapped, slices, string_list

WINDOW = 2048
END = 1


def id_bytes(path: str, end: int) -> int:
    """Bytes that hold any id."""
    return 2 if max(len(bpe_model.tokens(path)), end + 1) <= 1 << 16 else 4


def tokenise(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: part, local (the document's offset in its partition), the id, tokens (binary, 16 bits each where ids allow), n."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = id_bytes(path, end)
        c, close = bpe_model.encoder(path, width), end.to_bytes(width, "little")
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [x + close for x in c.encode(string_list(batch.column("text")))]
                n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int64)), pa.array(local), batch.column("id"), pa.array(ids, type=pa.binary()), pa.array(n)], names=["part", "local", "id", "tokens", "n"])

    return mapped(source, run, f"part long, local long, id {kind}, tokens binary, n long")


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences: sequence_id, n_tokens, input_ids (binary, little-endian unsigned 32-bit, without padding), and pieces,
    an array of (id, start, length, doc_tokens, offset) in order. padded() pads the last sequence."""
    path = path or bpe_model.default_path()
    rows = cut(tokenise(docs, path, end, id_col, text_col))
    kind = rows.schema["id"].dataType.simpleString()
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number per partition
    parts = sorted(totals)
    base = dict(zip(parts, itertools.accumulate([0, *(totals[p] for p in parts)]), strict=False))
    total = sum(totals.values())
    width = id_bytes(path, end)
    piece = f"struct<id:{kind},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>"

    def windows(borders: bool):
        """Records of windows: those that cross a border of their partition, or the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_seq, begun, crosses, chunks, pieces = -1, 0, False, [], []
            out: list[tuple] = []
            doc_type = pa.int64()

            def close() -> None:
                nonlocal chunks, pieces
                if pieces and crosses == borders:
                    ids = np.concatenate(chunks).astype("<u4")
                    out.append((open_seq, begun, len(ids), ids.tobytes(), pieces))
                chunks, pieces = [], []

            def flush() -> pa.RecordBatch:
                cols = list(zip(*out, strict=True))
                listed = pa.list_(pa.struct([("id", doc_type), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "offset"))]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), listed]
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["sequence_id", "begun", "n_tokens", "input_ids", "pieces"])
                out.clear()
                return batch

            reach = -1
            for whole in batches:
                doc_type = arrow_type(whole, "id")
                for batch in slices(whole, "tokens"):
                    for part, local, doc, raw, n in zip(*(batch.column(c).to_pylist() for c in ("part", "local", "id", "tokens", "n")), strict=True):
                        ids = np.frombuffer(raw, dtype=f"<u{width}")
                        at = base[part] + local
                        if at != reach:  # rows between were left out
                            close()
                        reach = at + n
                        start = 0
                        while start < n:
                            seq, offset = divmod(at + start, window)
                            if not pieces or seq != open_seq:
                                close()
                                open_seq, begun = seq, offset
                                crosses = seq * window < base[part] or min((seq + 1) * window, total) > base[part] + totals[part]
                            take = min(n - start, window - offset)
                            if crosses == borders:
                                chunks.append(ids[start : start + take])
                                pieces.append({"id": doc, "start": start, "length": take, "doc_tokens": n, "offset": offset})
                            start += take
                        if len(out) >= 256:
                            yield flush()
            close()
            if out:
                yield flush()

        return run

    schema = f"sequence_id long, begun long, n_tokens long, input_ids binary, pieces array<{piece}>"
    whole = mapped(rows, windows(False), schema).select("sequence_id", "n_tokens", "input_ids", "pieces")
    ends = docs.sparkSession.createDataFrame([(p, totals[p]) for p in parts], "of long, tokens_of long")  # a row per partition
    border = rows.join(F.broadcast(ends), F.col("part") == F.col("of")).where(f"local < {window} or local + n > tokens_of - {window}").select(*rows.columns)
    bound = mapped(border, windows(True), schema)  # at most `window` records make a sequence
    joined = (
        bound.groupBy("sequence_id")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("begun", "input_ids", "pieces"))).alias("r"))
        .select("sequence_id", "n_tokens", F.expr("aggregate(r, cast('' as binary), (a, x) -> concat(a, x.input_ids))").alias("input_ids"), F.flatten(F.col("r.pieces")).alias("pieces"))
    )
    return whole.unionByName(joined)


def padded(sequences: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """input_ids padded to the window with `pad`, and attention (the count of real tokens)."""
    fill = int(pad).to_bytes(4, "little")
    filled = F.expr(f"concat(input_ids, unhex(repeat('{fill.hex()}', cast({window} - n_tokens as int))))")
    return sequences.withColumn("attention", F.col("n_tokens")).withColumn("input_ids", filled)


def pieces(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32 of the piece's ids, doc_tokens, sequence_id, offset."""
    each = sequences.select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    ids = F.expr("substring(input_ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    return each.select(
        F.col("p.id").alias(id_col), F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.crc32(ids).alias("ids_crc32"),
        F.col("p.doc_tokens").alias("doc_tokens"), "sequence_id", F.col("p.offset").alias("offset"),
    )


def crc(ids: list[int]) -> int:
    """For tests: what ids_crc32 should hold."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn, as

    ### <role>
    <text>
    </turn>

and encoded once, with offsets, by a byte-level BPE tokenizer: its tokens tile the text's bytes, so running sums of their
lengths are their byte offsets, and a running count of characters turns these into code points. The spans of the texts of the trained role (assistant)
are sorted; for every span a binary search over the tokens' offsets finds the tokens that touch it. A token is under the
mask if it touches a span; `loss_spans` holds the exact code points, for a token may reach over the border of a span.

Escaping is reversible: inside texts a control string (`###` or `</turn>`) with the backslashes right before it gets
one backslash more, so an unescaped control string always belongs to the template; roles escape backslash and line feed.

Defined results: turns are ordered by turn, nulls first, then role and text; repeated rows are turns of their own; a
null text or role reads as empty; a null conv_id is a conversation like any other; an empty table gives no row; other
columns are not read; very long texts are whole tokens and spans like others, with conversations encoded about CHUNK_CHARS
bytes at a time, one at least. One shuffle, by conversation, of pre-aggregated turns; a conversation is one training
record, so its turns meet in one row, and memory grows with the longest conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, mapped, slices

OPEN, CLOSE = "### ", "\n</turn>\n"
CONTROL = re.compile(r"(\\*)(###|</turn>)")
ESCAPED = re.compile(r"\\(\\*)(###|</turn>)")
TRAINED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at = spans[-1][1] + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        role = unescape_role(formatted[at + len(OPEN) : line])
        end = next((m.start() for m in CONTROL.finditer(formatted, line + 1) if m[2] == "</turn>" and not m[1]), None)
        if end is None or formatted[end - 1] != "\n":
            raise ValueError(f"the turn at {at} has no end")
        turns.append((role, unescape(formatted[line + 1 : end - 1])))
        at = end - 1 + len(CLOSE)
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Whether each token touches a span, and the code points of spans that tokens cover, merged.

    offsets: begin and end of each token, both ascending; spans: sorted, disjoint.
    """
    under, covered = np.zeros(len(offsets), dtype=bool), []
    spans = [s for s in spans if s[0] < s[1]]
    if len(offsets) == 0 or not spans:
        return under, covered
    begins, ends = offsets[:, 0], offsets[:, 1]
    sides = np.array(spans, dtype=np.int64)
    firsts, lasts = np.searchsorted(ends, sides[:, 0], side="right"), np.searchsorted(begins, sides[:, 1], side="left")
    for (a, b), first, last in zip(spans, firsts.tolist(), lasts.tolist(), strict=True):
        under[first:last] = True
        x, y = np.maximum(begins[first:last], a), np.minimum(ends[first:last], b)
        some = y > x
        x, y = x[some], y[some]
        if len(x):  # stretches of tokens without a gap
            fresh = np.flatnonzero(np.r_[True, x[1:] > np.maximum.accumulate(y)[:-1]])
            covered += zip(x[fresh].tolist(), np.maximum.reduceat(y, fresh).tolist(), strict=True)
    return under, covered


def token_offsets(text: str, sizes: np.ndarray) -> np.ndarray:
    """Begin and end, in code points, of tokens that tile the text's bytes; a token inside a character reaches over it."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if not text.isascii():
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        place = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte's character
        begins, ends = place[begins], place[ends - 1] + 1
    return np.stack([begins, ends], axis=1)


_TOKENIZERS: dict[str, tuple[object, np.ndarray]] = {}


def tokenizer(path: str):
    """One tokenizer per Python worker, and the bytes of each of its tokens; control strings and special strings inside texts
    are ordinary text to it."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        vocab = t.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():  # each character of a token stands for one byte
            sizes[i] = len(token)
        _TOKENIZERS[path] = t, sizes
    return _TOKENIZERS[path]


def bounded(batch: pa.RecordBatch, texts: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes in a column of lists of texts (one row at least)."""
    import pyarrow.compute as pc

    column = batch.column(texts)
    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column.flatten()), 0), dtype=np.int64)
    total = np.r_[0, np.cumsum(sizes)][np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))]
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def format_chats(conversations: DataFrame, path: str | None = None, trained: str = TRAINED) -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids, loss_mask (by token), loss_spans (by code point)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = grouped.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sizes = tokenizer(path)
        for whole in batches:
            for batch in bounded(whole, "texts"):
                every = batch.column("roles").to_pylist()
                made = [render(list(zip(r, x, strict=True))) for r, x in zip(every, batch.column("texts").to_pylist(), strict=True)]
                ids, masks, covers = [], [], []
                for (text, spans), roles, e in zip(made, every, t.encode_batch_fast([m[0] for m in made], add_special_tokens=False), strict=True):
                    own = np.array(e.ids, dtype=np.int32)
                    under, covered = mask(token_offsets(text, sizes[own]), [s for s, r in zip(spans, roles, strict=True) if r == trained])
                    ids.append(own)
                    masks.append(under)
                    covers.append([{"start": a, "end": b} for a, b in covered])
                ends = pa.array(np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id"), pa.array([m[0] for m in made], pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(masks))), pa.array(covers, span),
                    ],
                    names=["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"],
                )

    return mapped(grouped, run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output: turns, the text under the mask, and their digests."""
    import hashlib

    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in (x for whole in batches for x in slices(whole, "formatted")):
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return mapped(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters, WIDTH bytes wide, slide by STRIDE over the whole document; their rectified answers
are max-pooled in chunks of CHUNK bytes, whose windows reach over into the next chunk, so chunks overlap and no byte is
left out; the pooled vectors, averaged by their windows, are combined into one probability by a logistic layer.

The network is fitted on the driver by Adam on a bounded sample: the whole texts of at most PER_CLASS labelled documents
of each class, chosen by a hash of the id (of a repeated id, the least text); a step takes a text whole or, more
often, some chunks from anywhere in it, drawn anew each time, and looks at SLICE chunks at a time, so long texts cost time,
not memory. The labels weigh the same in training; their shares among all labelled rows then shift the last layer. Scoring reads every byte of every document. Scores depend on the text's bytes alone.

Defined results: a null text scores as the empty text, which is one window of padding; equal texts get equal scores;
repeated rows are scored each; where a label has only one class or none, every score is the share of label 1 (0.5 without
labels); an empty table gives an empty result; of other columns only the id is read. Two passes over the texts, no
shuffle of them; the sample's ids are broadcast, 2 * PER_CLASS of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, rewritten, slices

WIDTH, STRIDE, DEPTH, FILTERS, CHUNK = 8, 2, 8, 32, 256
PER_CLASS = 700
#: Chunks that a training step looks at together.
SLICE = 1024
#: How often a step takes a sampled text whole; else DRAWN chunks from anywhere in it, so that short texts are learned too.
WHOLE, DRAWN = 0.25, 2
PAD = 256
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.02, 7
#: Bytes that are scored together.
BLOCK = 1 << 14


@dataclass
class Network:
    embed: np.ndarray  # 257 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: float


def fresh() -> Network:
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.5, (257, DEPTH)).astype(np.float32)
    embed[PAD] = 0
    return Network(embed, rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)


def chunks_of(text: bytes) -> list[bytes]:
    """All chunks of a text, each with the bytes its last window reaches."""
    return [text[s : s + CHUNK + WIDTH - STRIDE] for s in range(0, max(1, len(text)), CHUNK)]


def windows_in(text: bytes) -> np.ndarray:
    """How many windows begin in each chunk of a text; one at least."""
    n = max(1, -(-len(text) // STRIDE))
    per = CHUNK // STRIDE
    return np.array([min(per, n - a) for a in range(0, n, per)])


def cut_up(text: bytes) -> list[tuple[bytes, int]]:
    """The chunks of a text, each with the number of its windows."""
    return list(zip(chunks_of(text), windows_in(text).tolist(), strict=True))


def drawn(text: bytes, rng: np.random.Generator) -> list[tuple[bytes, int]]:
    """DRAWN chunks that begin anywhere in a text; all of a text that has fewer."""
    if len(text) <= DRAWN * CHUNK:
        return cut_up(text)
    starts = rng.integers(0, (len(text) - CHUNK) // STRIDE + 1, DRAWN) * STRIDE
    return [(text[s : s + CHUNK + WIDTH - STRIDE], CHUNK // STRIDE) for s in starts.tolist()]


def windows(chunk: bytes, n: int) -> np.ndarray:
    """Byte numbers under each of a chunk's n windows, padded, and the first window again in the place of those it lacks."""
    per = CHUNK // STRIDE
    row = np.full((per - 1) * STRIDE + WIDTH, PAD, dtype=np.int16)
    row[: len(chunk)] = np.frombuffer(chunk, dtype=np.uint8)[: len(row)]
    out = np.lib.stride_tricks.sliding_window_view(row, WIDTH)[::STRIDE]
    return out if n == per else np.concatenate([out[:n], np.repeat(out[:1], per - n, axis=0)])


def fit(samples: list[tuple[bytes, int]], odds: float = 0.0) -> Network:
    """samples: text, label. A text's chunks are pooled one by one and averaged by their windows, as score does. Both labels
    weigh the same; odds: the logarithm of how much likelier label 1 is among all rows."""
    net = fresh()
    share = np.mean([y for _, y in samples]) if samples else 0.5
    if not samples or share in (0, 1):
        share = float(np.clip(share, 1e-6, 1 - 1e-6))
        net.offset = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(SEED)
    whole = [cut_up(t) for t, _ in samples]
    label = np.array([y for _, y in samples], np.float32)
    weigh = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    params = [net.embed, net.filters, net.bias, net.weight, np.zeros(1, np.float32)]
    moment, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    f_of = np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for begin in range(0, len(order), BATCH):
            own = order[begin : begin + BATCH]
            chunks = [whole[d] if rng.random() < WHOLE else drawn(samples[d][0], rng) for d in own]
            held = [c for cs in chunks for c in cs]
            doc_of = np.repeat(np.arange(len(own)), [len(cs) for cs in chunks])
            part = np.array([n for _, n in held], np.float32)
            part /= np.bincount(doc_of, part).astype(np.float32)[doc_of]  # of its text's windows
            # forward: of each chunk and filter, the bytes under its best window, and the answer there
            best, tops = [], []
            for a in range(0, len(held), SLICE):
                idx = np.stack([windows(c, n) for c, n in held[a : a + SLICE]])  # chunks x windows x WIDTH
                k, n, _ = idx.shape
                answer = (params[0][idx].reshape(k * n, WIDTH * DEPTH) @ params[1]).reshape(k, n, FILTERS)
                at = answer.argmax(axis=1)  # chunks x FILTERS
                best.append(idx[np.arange(k)[:, None], at])  # chunks x FILTERS x WIDTH
                tops.append(np.take_along_axis(answer, at[:, None, :], 1)[:, 0] + params[2])
            top = np.concatenate(tops)
            vec = np.zeros((len(own), FILTERS), np.float32)
            np.add.at(vec, doc_of, np.maximum(top, 0) * part[:, None])
            p = 1 / (1 + np.exp(-np.clip(vec @ params[3] + params[4], -30, 30)))
            err = (p - label[own]) * weigh[own] / len(own)
            d_pooled = (err[:, None] * params[3])[doc_of] * part[:, None] * (top > 0)
            d_filters, d_embed = np.zeros_like(params[1]), np.zeros_like(params[0])
            for a, rows in zip(range(0, len(held), SLICE), best, strict=True):
                d = d_pooled[a : a + SLICE]
                x = params[0][rows].reshape(len(rows), FILTERS, WIDTH * DEPTH)
                d_filters += np.einsum("kfw,kf->wf", x, d)
                back = (params[1].T[f_of][None] * d[:, :, None]).reshape(-1, DEPTH)
                flat = rows.ravel()
                for j in range(DEPTH):
                    d_embed[:, j] += np.bincount(flat, back[:, j], minlength=PAD + 1).astype(np.float32)
            d_embed[PAD] = 0
            grads = [d_embed + 1e-4 * params[0], d_filters + 1e-4 * params[1], d_pooled.sum(0), vec.T @ err + 1e-3 * params[3], err.sum(keepdims=True)]
            step += 1
            for q, g, m, s in zip(params, grads, moment, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(params[0], params[1], params[2], params[3], float(params[4][0]) + odds)


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of label 1; every window of every text is looked at."""
    per = CHUNK // STRIDE
    out = np.empty(len(texts))
    # windows of all texts, one text after another, each padded so that its last byte is in a window
    counts = [max(1, -(-len(t) // STRIDE)) for t in texts]
    pooled = [np.zeros((-(-n // per), FILTERS), np.float32) for n in counts]
    held: list[tuple[int, int, np.ndarray]] = []  # text, first window, bytes

    def run() -> None:
        rows = np.concatenate([b for _, _, b in held])
        x = net.embed[rows]
        starts, at = [], 0
        for _, _, b in held:
            n = (len(b) - WIDTH) // STRIDE + 1
            starts.append(at + STRIDE * np.arange(n))
            at += len(b)
        begin = np.concatenate(starts)
        view = np.lib.stride_tricks.as_strided(x, (len(rows) - WIDTH + 1, WIDTH * DEPTH), (x.strides[0], x.strides[1]))
        answer = view[begin] @ net.filters
        sizes = [len(s) for s in starts]
        tops = np.maximum(np.maximum.reduceat(answer, np.cumsum([0, *sizes[:-1]]), axis=0) + net.bias, 0)
        for (t, first, _), top in zip(held, tops, strict=True):
            pooled[t][first // per] = top
        held.clear()

    size = 0
    for t, text in enumerate(texts):
        n = counts[t]
        raw = np.full((n - 1) * STRIDE + WIDTH, PAD, dtype=np.int16)
        raw[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        for first in range(0, n, per):
            last = min(n, first + per) - 1
            held.append((t, first, raw[first * STRIDE : last * STRIDE + WIDTH]))
            size += len(held[-1][2])
            if size >= BLOCK:
                run()
                size = 0
    if held:
        run()
    for t, n in enumerate(counts):
        share = np.full(len(pooled[t]), per, np.float32)
        share[-1] = n - per * (len(share) - 1)
        vec = (pooled[t] * share[:, None]).sum(0) / n
        out[t] = 1 / (1 + np.exp(-np.clip(float(vec @ net.weight) + net.offset, -30, 30)))
    return out


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on the bounded sample; held-out rows are left aside."""
    known = labels.select(F.col("doc_id").alias("lid"), "quality").where("lid is not null and quality in (0, 1)").where(~held_out("lid"))
    known = known.groupBy("lid").agg(F.min("quality").alias("quality"))
    chosen = None
    for y in (0, 1):
        own = known.where(F.col("quality") == y).orderBy(F.xxhash64("lid"), "lid").limit(PER_CLASS)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "lid")  # 2 * PER_CLASS rows

    got = rows.groupBy("lid").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality")).collect()  # 2 * PER_CLASS texts
    of = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = float(np.log(of[1] / of[0])) if len(of) == 2 else 0.0
    return fit([(r["text"].encode(), r["quality"]) for r in sorted(got, key=lambda r: r["lid"])], odds)


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, score."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score(net, texts))], names=["id", "score"])

    return mapped(source, run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more."""

    at = docs.columns.index(text_col)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score(net, [(t or "").encode() for t in batch.column(at).to_pylist()]) >= least))

    return rewritten(docs, at, change)

"""Secrets by character Markov models.

Base kinds are fixed patterns, leftmost and non-overlapping per kind, a failing match dropped: `assign` (a name such as
password or api_key, a sign, a value of 12 characters or more), `access` (AKIA..., 18 or more) and `hex` (16 lower-case
hexadecimal digits or more). The method adds `random`: a run of LEAST characters or more of the alphabet of keys that two
Markov models of characters tell from ordinary identifiers. Each model gives a character's probability by the one before it,
with a start and an end sign, smoothed by SMOOTH; a run is a secret if the log-likelihood ratio of random strings to
identifiers is over BAR per character. Scores of all runs of a slice are looked up at once in numpy.

Models are trained from labelled samples: the values that base patterns find are random; the other runs of the corpus with
letters, one a document, are identifiers; both from PER_LABEL documents at most, chosen by hash, those with a value first.
MADE strings a public alphabet (hexadecimal in both cases, base32, base62, base64 in both forms), drawn by a seeded generator,
are labelled random too, so the models are there whatever a corpus holds.

Defined results: a null or empty text has no spans; repeated rows are read each; offsets are code points, end exclusive; ties
of start are in the order of KINDS, then by end; a random run that lies inside a base span is not repeated, others may
overlap base spans, and no base span goes; an empty table gives an empty result and models of the made strings alone; other
columns are kept by `mask` and not read. Texts of any length are read whole in time linear in them; a worker holds about
CHUNK_CHARS of text or one row at a time. One pass over the text for samples, one to find; no shuffle of texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, rewritten, slices, string_list

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

#: The base patterns; fixed values. Letters of names are ASCII in either case.
ASSIGN = re.compile(r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
VALUE_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Characters that keys are made of, and the length of a run that is judged.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
#: Log-likelihood ratio per character, in nats, over which a run is random.
BAR = 0.2
#: Documents that labelled samples come from, characters of a sample, made strings of each alphabet, smoothing of counts.
PER_LABEL, SAMPLE_CHARS, MADE, SMOOTH = 20_000, 128, 1000, 0.1
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")

Span = tuple[int, int, str]

_HEX = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_KEY = bytes(120 if chr(c) in ALPHABET else 32 for c in range(256))
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
EDGE = len(ALPHABET)


def _spans_of(text: bytes, table: bytes, least: int) -> list[tuple[int, int]]:
    """Byte ranges of the longest runs of at least `least` bytes that the table marks."""
    marks, run, found, at = text.translate(table), b"x" * least, [], 0
    while (at := marks.find(run, at)) >= 0:
        end = marks.find(b" ", at)
        end = len(marks) if end < 0 else end
        found.append((at, end))
        at = end
    return found


def base_spans(text: str, raw: bytes) -> list[Span]:
    """The spans of the base kinds; raw: the text in UTF-8."""
    spans: list[Span] = []
    low = raw.lower()
    if any(name in low for name in NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return spans + [(a, b, "hex") for a, b in _points(raw, _spans_of(raw, _HEX, HEX_LEAST))]


def _points(raw: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of ASCII as ranges of code points."""
    if not found or raw.isascii():
        return found
    out, at, points = [], 0, 0
    for a, b in found:
        points += len(raw[at:a].decode("utf-8", "surrogatepass"))
        out.append((points, points + b - a))
        points, at = points + b - a, b
    return out


class Models:
    """Log-probabilities of pairs of characters in random strings less those in identifiers."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    @classmethod
    def fitted(cls, strings: list[str], labels: list[int]) -> Models:
        logs = []
        for label in (0, 1):
            own = [s for s, x in zip(strings, labels, strict=True) if x == label]
            counts = np.full((EDGE + 1, EDGE + 1), SMOOTH)
            before, after, _ = _pairs([s.encode("ascii", "replace") for s in own])
            np.add.at(counts, (before, after), 1)
            logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        return cls(logs[1] - logs[0])

    def scores(self, strings: list[bytes]) -> np.ndarray:
        """The mean log-likelihood ratio of each string's characters, the end sign included."""
        if not strings:
            return np.zeros(0)
        before, after, first = _pairs(strings)
        sizes = np.diff(np.r_[first, len(before)])
        return np.add.reduceat(self.ratio[before, after], first) / sizes


def _pairs(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring characters' codes of all strings, edges included, and where each string begins."""
    codes = _CODE[np.frombuffer(b"\n".join([b"", *strings, b""]), np.uint8)]
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
    return codes[:-1], codes[1:], first


def made_strings(seed: int = 7) -> list[str]:
    """Random strings of the public alphabets, the same on every machine."""
    draw = random.Random(seed)
    return ["".join(draw.choices(a, k=draw.randint(LEAST, 64))) for a in ALPHABETS for _ in range(MADE)]


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sample, label) from the corpus: 1 for values of base patterns, 0 for other runs of the keys' alphabet with letters. One
    of each a document at most, PER_LABEL documents at most."""
    text, order = F.col(text_col), F.xxhash64(F.col(id_col).cast("string"), text_col)
    low = F.lower(text)
    named = low.contains("token") | low.contains("secret") | low.contains("passw") | low.contains("api")
    value = F.when(named, F.nullif(F.regexp_extract(text, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", 1), F.lit("")))
    value = F.coalesce(value, F.when(text.contains("AKIA"), F.nullif(F.regexp_extract(text, "AKIA[A-Z0-9]{14,}", 0), F.lit(""))))
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{8,}"), F.lit(0))
    rows = docs.select(order.alias("order"), value.alias("value"), runs.alias("runs"))
    one = F.when(F.size("runs") > 0, F.element_at("runs", (F.pmod("order", F.size("runs")) + 1).cast("int")))
    plain = ~one.rlike("^[0-9a-f]{16,}$|^AKIA[A-Z0-9]{14,}$") & ~F.coalesce(one == F.col("value"), F.lit(False)) & one.rlike("[A-Za-z]")
    rows = rows.select("order", F.substring("value", 1, SAMPLE_CHARS).alias("value"), F.substring(F.when(plain, one), 1, SAMPLE_CHARS).alias("run"))
    chosen = rows.orderBy(F.col("value").isNull(), "order").limit(PER_LABEL)
    pair = lambda c, label: F.struct(F.col(c).alias("sample"), F.lit(label).alias("label"))
    return chosen.select(F.explode(F.array(pair("value", 1), pair("run", 0))).alias("x")).select("x.sample", "x.label").where("sample is not null")


def train(labelled: DataFrame) -> Models:
    """Models from (sample, label) rows, whose number is bounded by what samples takes, and the made strings."""
    rows = labelled.dropDuplicates().select("sample", "label").collect()
    made = made_strings()
    return Models.fitted([*(r["sample"] for r in rows), *made], [*(r["label"] for r in rows), *(1 for _ in made)])


def find(texts: list[str], models: Models) -> list[list[Span]]:
    """All spans of each text, by start and then kind."""
    found, runs, where = [], [], []
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        base = base_spans(text, raw)
        found.append(base)
        own = _spans_of(raw, _KEY, LEAST)
        for (a, b), (first, last) in zip(own, _points(raw, own), strict=True):
            if not any(x <= first and last <= y for x, y, _ in base):
                runs.append(raw[a:b])
                where.append((k, first, last))
    for (k, first, last), score in zip(where, models.scores(runs).tolist(), strict=True):
        if score > BAR:
            found[k].append((first, last, "random"))
    order = {k: i for i, k in enumerate(KINDS)}
    return [sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])) for spans in found]


def detect(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, and spans, an array of (start, end, kind) in order."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in own] for own in find(string_list(batch.column("text")), models)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, type=span)], names=["id", "spans"])

    return mapped(source, run, f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("id", id_col)


def mask(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs with spans in the text column replaced by their kind in brackets, overlapping ones as one, named by the first; null
    stays null, other columns stay."""
    at = docs.columns.index(text_col)

    def masked(text: str, spans: list[Span]) -> str:
        out, here = [], 0
        for begin, end, kind in spans:
            if begin >= here:
                out += [text[here:begin], f"[{kind.upper()}]"]
            here = max(here, end)
        return "".join([*out, text[here:]])

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        spans = find([t or "" for t in texts], models)
        made = pa.array([None if t is None else masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 :]], names=batch.schema.names)

    return rewritten(docs, at, change)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, base_sha256 over kind:start:end of the base spans, and spans as text over all."""
    line = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.expr(f"sha2({line.format(base)}, 256)").alias("base_sha256"), F.expr(line.format("spans")).alias("spans"))

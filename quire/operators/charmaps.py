"""Character maps: codes and their texts from the maps' own language.

The maps are small programs; a parser of their tokens has no form in SQL, so a text is read by Python, many rows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.workers import ship

#: Codes of one character map at most, and codes of one range; fixed values.
MAX_CODES, MAX_RANGE = 65_536, 65_535


def character_map(text: str) -> dict[int, str]:
    """Codes and their texts from the bfchar and bfrange sections of a character map; comments are skipped, a range ends at
    its section's end, the last unit of a range's text counts up."""
    out: dict[int, str] = {}
    tokens = re.findall(r"%[^\r\n]*|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]<>()%]+", text)
    tokens = [t for t in tokens if t[0] not in "%("]
    hexed = lambda t: re.sub(r"\s", "", t[1:-1])
    spell = lambda h: bytes.fromhex(h if len(h) % 4 == 0 else h.zfill(-(-len(h) // 4) * 4)).decode("utf-16-be", "replace")

    def put(code: int, value: str) -> None:
        if value and len(out) < MAX_CODES:
            out.setdefault(code, value)

    at = 0
    while at < len(tokens):
        if tokens[at] == "beginbfchar":
            at += 1
            while at + 1 < len(tokens) and tokens[at].startswith("<") and tokens[at + 1].startswith("<"):
                put(int(hexed(tokens[at]) or "0", 16), spell(hexed(tokens[at + 1])))
                at += 2
        elif tokens[at] == "beginbfrange":
            at += 1
            while at + 2 < len(tokens) and tokens[at].startswith("<") and tokens[at + 1].startswith("<"):
                low, high = (int(hexed(t) or "0", 16) for t in tokens[at : at + 2])
                high = min(high, low + MAX_RANGE)
                if tokens[at + 2] == "[":
                    end = tokens.index("]", at) if "]" in tokens[at:] else len(tokens)
                    for code, t in zip(range(low, high + 1), tokens[at + 3 : end], strict=False):
                        put(code, spell(hexed(t)))
                    at = end + 1
                else:
                    first = spell(hexed(tokens[at + 2]))
                    for code in range(low, high + 1):
                        if first and ord(first[-1]) + code - low <= 0x10FFFF:
                            put(code, first[:-1] + chr(ord(first[-1]) + code - low))
                    at += 3
        else:
            at += 1
    return out


def character_maps(rows: DataFrame, key: str, text: str = "text", slice_rows: int = 64) -> DataFrame:
    """(key, code, value) of every code in each row's map; a null or empty map has none. Rows leave in slices."""
    source = rows.select(key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(begin, slice_rows)
                at, codes, values = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    found = character_map(t or "")
                    at += [i] * len(found)
                    codes += found.keys()
                    values += found.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(codes, pa.int64()), pa.array(values, pa.string())], names=[key, "code", "value"])

    return ship(source).mapInArrow(run, f"{key} {kind}, code long, value string")

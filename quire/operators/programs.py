"""Names and codes of the glyphs of embedded font programs: bare CFF, CFF inside an OpenType wrapper, and Type 1.

A program is one binary value of a row, as `binaryFile` or a column gives it. Programs are read in Arrow batches, one at a time;
every place in one is checked against its length and every count is bounded by it, so broken bytes raise BrokenProgram inside,
never anything else, and give no row. Nothing is interpreted beyond what names need: charstrings are stepped over.

The strings that the CFF specification fixes are made from their rule: printable ASCII in order, the signs and composed letters
of the standard Latin set (228 in all). The rest of them, expert sets and weights, are a parameter (`more_strings`); without it
such glyphs have the empty name, as those of the predefined expert charsets have."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship

#: Names of ASCII's signs, and of the signs behind ASCII, in the specification's order; fixed values.
SIGNS = (
    "space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at"
).split()
BRACKETS, BRACES = "bracketleft backslash bracketright asciicircum underscore quoteleft".split(), "braceleft bar braceright asciitilde".split()
LATIN = (
    "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet "
    "quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron "
    "emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree "
    "thorn threequarters twosuperior registered minus eth multiply threesuperior copyright"
).split()
#: Accents of each letter that has some.
ACCENTS = {"A": "acute circumflex dieresis grave ring tilde", "C": "cedilla", "E": "acute circumflex dieresis grave", "I": "acute circumflex dieresis grave", "N": "tilde", "O": "acute circumflex dieresis grave tilde", "S": "caron", "U": "acute circumflex dieresis grave", "Y": "acute dieresis", "Z": "caron"}
#: How many strings the specification fixes; a program's own are numbered behind them.
FIXED = 391

CHARSET, ENCODING, CHARSTRINGS = 15, 16, 17
EEXEC_KEY, EEXEC_SKIP = 55665, 4

Glyphs = tuple[list[str], dict[int, int]]


class BrokenProgram(ValueError):
    """Bytes that are no font program, or end too early."""


def standard_strings() -> list[str]:
    """The first of the fixed strings, by number."""
    capitals = [chr(c) for c in range(65, 91)]
    composed = [letter + accent for letter, accents in ACCENTS.items() for accent in accents.split()]
    small = [c[0].lower() + c[1:] for c in composed]
    return [".notdef", *SIGNS, *capitals, *BRACKETS, *(c.lower() for c in capitals), *BRACES, *LATIN, *composed, *small]


@cache
def _standard_names() -> tuple[str, ...]:
    return tuple(standard_strings())


@cache
def _standard_numbers() -> dict[str, int]:
    return {name: n for n, name in enumerate(standard_strings())}


class _Bytes:
    """Bytes that are read within their bounds alone."""

    def __init__(self, held: bytes):
        self.held = held

    def part(self, begin: int, end: int) -> bytes:
        if not 0 <= begin <= end <= len(self.held):
            raise BrokenProgram(f"bytes {begin} to {end} of {len(self.held)}")
        return self.held[begin:end]

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.part(at, at + size), "big")

    def index(self, at: int) -> tuple[list[bytes], int]:
        """The items of an INDEX, and where it ends."""
        count = self.number(at, 2)
        if not count:
            return [], at + 2
        size = self.number(at + 2, 1)
        if not 1 <= size <= 4:
            raise BrokenProgram("the size of an offset")
        raw = self.part(at + 3, at + 3 + (count + 1) * size)
        places = [int.from_bytes(raw[i : i + size], "big") for i in range(0, len(raw), size)]
        base = at + 2 + len(raw)
        return [self.part(base + a, base + b) for a, b in zip(places, places[1:], strict=False)], base + places[-1]


def top_entries(held: bytes) -> dict[int, list[float]]:
    """A DICT's operators with their operands; two-byte operators are 1200 and more."""
    found: dict[int, list[float]] = {}
    data, at, stack = _Bytes(held), 0, []
    while at < len(held):
        b = held[at]
        at += 1
        if b <= 21:
            if b == 12:
                b, at = 1200 + data.number(at, 1), at + 1
            found[b], stack = stack, []
        elif b == 28:
            stack.append(struct.unpack(">h", data.part(at, at + 2))[0])
            at += 2
        elif b == 29:
            stack.append(struct.unpack(">i", data.part(at, at + 4))[0])
            at += 4
        elif b == 30:  # a decimal number in half bytes, whose value no name needs
            while (last := data.number(at, 1)) & 15 != 15 and last >> 4 != 15:
                at += 1
            at += 1
            stack.append(float("nan"))
        elif 32 <= b <= 246:
            stack.append(b - 139)
        elif b <= 254 and b >= 247:
            more = data.number(at, 1)
            stack.append((b - 247) * 256 + more + 108 if b <= 250 else -(b - 251) * 256 - more - 108)
            at += 1
        else:
            raise BrokenProgram("a reserved byte in a DICT")
    return found


def _wrapped(held: bytes) -> bytes:
    """The CFF table of an OpenType file, or the bytes as they are."""
    if held[:4] not in (b"OTTO", b"\x00\x01\x00\x00", b"true"):
        return held
    data = _Bytes(held)
    for n in range(data.number(4, 2)):
        at = 12 + 16 * n
        if data.part(at, at + 4) == b"CFF ":
            begin = data.number(at + 8, 4)
            return data.part(begin, begin + data.number(at + 12, 4))
    raise BrokenProgram("no CFF table")


def cff_glyphs(held: bytes, more_strings: Sequence[str] = ()) -> Glyphs:
    """Names by glyph, and the glyph of each code of the program's own encoding."""
    data = _Bytes(_wrapped(held))
    if data.number(0, 1) != 1:
        raise BrokenProgram("not version 1")
    _, at = data.index(data.number(2, 1))
    tops, at = data.index(at)
    own, _ = data.index(at)
    if not tops:
        raise BrokenProgram("no font")
    top = top_entries(tops[0])
    place = {op: int(top[op][0]) if top.get(op) and top[op][0] == top[op][0] else 0 for op in (CHARSET, ENCODING, CHARSTRINGS)}
    count = len(data.index(place[CHARSTRINGS])[0]) if place[CHARSTRINGS] else 0
    if not count:
        raise BrokenProgram("no glyphs")
    known = [*_standard_names(), *more_strings][:FIXED] if more_strings else _standard_names()

    def string(number: int) -> str:
        if number < FIXED:
            return known[number] if number < len(known) else ""
        return own[number - FIXED].decode("latin-1") if number - FIXED < len(own) else ""

    names = [".notdef", *map(string, _charset(data, place[CHARSET], count))]
    return names, _encoding(data, place[ENCODING], names, string) if place[ENCODING] > 1 else {}


def _charset(data: _Bytes, at: int, count: int) -> list[int]:
    """The string numbers of all glyphs but the first. Predefined expert sets have numbers that no string has."""
    if at == 0:
        return list(range(1, count))
    if at <= 2:
        return [FIXED + 0xFFFF] * (count - 1)
    form, at = data.number(at, 1), at + 1
    if form == 0:
        return [data.number(at + 2 * n, 2) for n in range(count - 1)]
    if form not in (1, 2):
        raise BrokenProgram("the form of a charset")
    found: list[int] = []
    while len(found) < count - 1:
        first, more = data.number(at, 2), data.number(at + 2, form)
        found += range(first, first + min(more + 1, count - 1 - len(found)))
        at += 2 + form
    return found


def _encoding(data: _Bytes, at: int, names: list[str], string) -> dict[int, int]:
    form, n, at = data.number(at, 1), data.number(at + 1, 1), at + 2
    codes: dict[int, int] = {}
    if form & 127 == 0:
        codes = {code: gid for gid, code in enumerate(data.part(at, at + n), 1) if gid < len(names)}
        at += n
    elif form & 127 == 1:
        gid = 1
        for _ in range(n):
            first, more = data.number(at, 1), data.number(at + 1, 1)
            codes |= {first + k: gid + k for k in range(more + 1) if gid + k < len(names)}
            gid, at = gid + more + 1, at + 2
    else:
        raise BrokenProgram("the form of an encoding")
    if form & 128:
        where = {name: gid for gid, name in reversed(list(enumerate(names)))}
        for k in range(data.number(at, 1)):
            gid = where.get(string(data.number(at + 2 + 3 * k, 2)), 0)
            if gid:
                codes[data.number(at + 1 + 3 * k, 1)] = gid
    return codes


def decrypted(cipher: bytes, key: int = EEXEC_KEY) -> bytes:
    """Type 1's cipher undone, the random bytes before the text included."""
    out = bytearray()
    for c in cipher:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


def encrypted(plain: bytes, key: int = EEXEC_KEY) -> bytes:
    out = bytearray()
    for p in plain:
        c = p ^ key >> 8
        out.append(c)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


def _flat(held: bytes) -> bytes:
    """A program without the marks of its segments."""
    data, at, parts = _Bytes(held), 0, []
    while held[at : at + 1] == b"\x80" and data.number(at + 1, 1) in (1, 2):
        size = int.from_bytes(data.part(at + 2, at + 6), "little")
        parts.append(data.part(at + 6, at + 6 + size))
        at += 6 + size
    return b"".join(parts) if parts else held


_CODE = re.compile(rb"\bdup\s+(\d{1,9})\s*/([^\s/\[\]{}()<>%]*)\s+put\b")
_GLYPH = re.compile(rb"/([^\s/\[\]{}()<>%]*)\s+(\d{1,9})\s+(?:RD|-\|)[ ]|\bend\b")


def type1_glyphs(held: bytes) -> Glyphs:
    """Names in the order of the program's charstrings, and the glyph of each code of its own encoding."""
    flat = _flat(held)
    mark = re.search(rb"\beexec\s", flat)
    if not flat.startswith(b"%!") or not mark:
        raise BrokenProgram("not a Type 1 program")
    head, rest = flat[: mark.start()], flat[mark.end() :].lstrip(b" \t\r\n")
    if re.match(rb"[0-9A-Fa-f\s]{8}", rest):
        digits = re.sub(rb"\s", b"", re.match(rb"[0-9A-Fa-f\s]*", rest)[0])
        rest = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    plain = decrypted(rest)[EEXEC_SKIP:]
    at = plain.find(b"/CharStrings")
    names: list[str] = []
    at = at + len(b"/CharStrings") if at >= 0 else len(plain)
    while (m := _GLYPH.search(plain, at)) and m[1] is not None:
        names.append(m[1].decode("latin-1"))
        at = m.end() + int(m[2])  # a charstring is stepped over by its length
    if not names or at > len(plain):
        raise BrokenProgram("no charstrings")
    where = {name: gid for gid, name in reversed(list(enumerate(names)))}
    found = ((int(code), where.get(name.decode("latin-1"))) for code, name in _CODE.findall(head))
    return names, {code: gid for code, gid in found if gid is not None}


def glyphs(held: bytes, more_strings: Sequence[str] = ()) -> Glyphs:
    """The glyphs of a program of either kind."""
    return type1_glyphs(held) if held[:2] in (b"%!", b"\x80\x01") else cff_glyphs(held, more_strings)


#: Glyphs of one batch from a worker, beyond which only the program at hand is finished.
SLICE = 1 << 15


def _found(batch: pa.RecordBatch, at: list[int], gids: list[int], names: list[str], codes: list[list[int]]) -> pa.RecordBatch:
    columns = [batch.column("key").take(pa.array(at, pa.int64())), pa.array(gids, pa.int32()), pa.array(names, pa.string()), pa.array(codes, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "gid", "name", "codes"])


def glyph_names(programs: DataFrame, key: str, content: str = "content", more_strings: Sequence[str] = ()) -> DataFrame:
    """(key, gid, name, codes): every glyph of every program, codes in order. A null or broken program has no row; a program that
    is in several rows is read in each."""
    rows = programs.select(F.col(key).alias("key"), F.col(content).alias("content"))
    kind = rows.schema["key"].dataType.simpleString()
    more = list(more_strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, (at, gids, every, own) = batch.column("content"), ([], [], [], [])
            for n in range(batch.num_rows):
                try:
                    names, codes = glyphs(held[n].as_py() or b"", more)
                except BrokenProgram:
                    continue
                listed: list[list[int]] = [[] for _ in names]
                for code in sorted(codes):
                    listed[codes[code]].append(code)
                at += [n] * len(names)
                gids += range(len(names))
                every += names
                own += listed
                if len(at) >= SLICE:
                    yield _found(batch, at, gids, every, own)
                    at, gids, every, own = [], [], [], []
            if at:
                yield _found(batch, at, gids, every, own)

    return ship(rows).mapInArrow(run, f"key {kind}, gid int, name string, codes array<int>").withColumnRenamed("key", key)


def _index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    places, at = [], 1
    for item in [*items, b""]:
        places.append(at.to_bytes(4, "big"))
        at += len(item)
    return struct.pack(">HB", len(items), 4) + b"".join(places) + b"".join(items)


def cff_program(names: Sequence[str], codes: dict[int, int] | None = None, form: int = 0) -> bytes:
    """A bare CFF with these glyph names behind .notdef, empty outlines, and an encoding if codes (code -> glyph, glyphs in order)
    are given; form: the form of its charset."""
    fixed = _standard_numbers()
    own = [n for n in dict.fromkeys(names) if n not in fixed]
    more = {n: FIXED + k for k, n in enumerate(own)}
    sids = [fixed[n] if n in fixed else more[n] for n in names]
    if form == 0:
        charset = b"\0" + b"".join(s.to_bytes(2, "big") for s in sids)
    else:
        runs: list[list[int]] = []
        for s in sids:
            if runs and s == runs[-1][0] + runs[-1][1] + 1 and runs[-1][1] < 255:
                runs[-1][1] += 1
            else:
                runs.append([s, 0])
        charset = bytes([form]) + b"".join(a.to_bytes(2, "big") + b.to_bytes(form, "big") for a, b in runs)
    encoding = b""
    if codes:
        first = {gid: code for code, gid in sorted(codes.items(), reverse=True)}
        listed = [first[g] for g in range(1, max(first) + 1)]
        extra = [(c, g) for c, g in sorted(codes.items()) if first[g] != c]
        encoding = bytes([128 if extra else 0, len(listed), *listed])
        if extra:
            encoding += bytes([len(extra)]) + b"".join(bytes([c]) + sids[g - 1].to_bytes(2, "big") for c, g in extra)
    integer = lambda v: b"\x1d" + struct.pack(">i", v)
    before = b"\1\0\4\4" + _index([b"Made"])
    strings = _index([n.encode("latin-1") for n in own]) + _index([])
    top = lambda a, b, c: _index([integer(a) + bytes([CHARSET]) + (integer(b) + bytes([ENCODING]) if codes else b"") + integer(c) + bytes([CHARSTRINGS])])
    at = len(before) + len(top(0, 0, 0)) + len(strings)
    return before + top(at, at + len(charset), at + len(charset) + len(encoding)) + strings + charset + encoding + _index([b"\x0e"] * (len(names) + 1))


def type1_program(names: Sequence[str], codes: dict[int, int] | None = None, form: str = "binary") -> bytes:
    """A Type 1 program with .notdef and these glyphs, empty outlines, and an encoding; form: binary, hex or segments."""
    every = [".notdef", *names]
    listed = "".join(f"dup {c} /{every[g]} put\n" for c, g in sorted((codes or {}).items()))
    head = f"%!PS-AdobeFont-1.0: Made\n/Encoding 256 array\n{listed}readonly def\ncurrentfile eexec\n".encode("latin-1")
    body = b"".join(b"/" + n.encode("latin-1") + b" 5 RD " + b"/end " + b" ND\n" for n in every)
    secret = encrypted(b"\xff\xff\xff\xff" + b"/lenIV 4 def /Subrs 0 array\n" + b"2 index /CharStrings %d dict dup begin\n" % len(every) + body + b"end\nend\n")
    if form == "hex":
        secret = secret.hex().encode()
    tail = b"\n" + b"0" * 64 + b"\ncleartomark\n"
    if form == "segments":
        piece = lambda kind, x: b"\x80" + bytes([kind]) + len(x).to_bytes(4, "little") + x
        return piece(1, head) + piece(2, secret) + piece(1, tail) + b"\x80\x03"
    return head + secret + tail


def made_programs(rows: DataFrame, key: str, names: str) -> DataFrame:
    """(key, content): a program for each row with these glyph names, codes from 65 on: a CFF where the key is even, else Type 1.
    For round trips and trials. Rows are dealt out, for a small file of names means much work."""
    plain = rows.select(F.col(key).alias("key"), F.col(names).alias("names")).repartition(F.col("key"))
    kind = plain.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, own in zip(batch.column("key").to_pylist(), batch.column("names").to_pylist(), strict=True):
                codes = {65 + n: n + 1 for n in range(min(len(own), 26))}
                made.append((type1_program if k % 2 else cff_program)(own, codes))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())], names=["key", "content"])

    return ship(plain).mapInArrow(run, f"key {kind}, content binary").withColumnRenamed("key", key)

"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus-signs before a digit, a full stop before a digit,
two digits with at most a blank or hyphen between, a bracket before a digit, colons, URL schemes, prefixes of keys, and
identifier cues. From each anchor a deterministic local parser expands the boundaries to both sides and validates what it holds.

Kinds. The base kinds are those of fixed patterns, leftmost and non-overlapping per kind; a failing match is dropped:
email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits). The method adds, by cue:
`account`: after a cue and `=`, `:`, `#` or `is` a value of 6 characters or more - for secrets (password, passwd, pwd, secret,
token, api, access or private key, each also as a part of a longer name) up to the closing quote or the next blank, with a
digit or, behind a sign, a symbol; a cue inside such a value begins no other; for iban the longest one, blanks included,
whose check digits are right, else as for account; for ssn nine digits, also after a blank alone; for account and passport
one with a digit; without a cue an IBAN in capitals of its country's length whose check digits are right;
`login`: user information in a URL, `scheme://user:secret@`; `key`: keys of a known form (AKIA, ghp_, sk_live_, xoxb-, AIza),
signed web tokens and private-key blocks; `ipv6`: an IPv6 address of three groups or more; `local`: a number written `(ddd) ddd-dddd`.
Added spans may overlap base spans; neither replaces the other.

Defined results: a null or empty text has no spans; repeated rows are read each; offsets are code points, end
exclusive; ties of start are ordered by kind as listed in KINDS; other columns are kept by `mask` and not read; an empty
table gives an empty result. Texts of any length are read whole; the parsers take time linear in them, and a worker holds
about CHUNK_CHARS of text or one row at a time. One pass, no shuffle.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, rewritten, slices, string_list

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login", "key", "ipv6", "local")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
HEX = DIGITS | frozenset("abcdefABCDEF:")
NAME = DIGITS | LETTERS | frozenset("_")
VALUE = DIGITS | LETTERS | frozenset("-_./+")
NUMBERED = ("account", "acct", "passport")
SECRET = ("token", "api_key", "api key", "apikey", "access_key", "private_key", "secret", "password", "passwd", "pwd")
CUES = (*NUMBERED, "iban", "ssn", *SECRET)
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://")
#: Public forms of keys: a prefix, the characters behind it, and how many there are at least.
KEYS = {"AKIA": (DIGITS | LETTERS, 16), "ghp_": (DIGITS | LETTERS, 36), "sk_live_": (DIGITS | LETTERS, 16), "xoxb-": (LABEL, 10), "AIza": (LABEL | {"_"}, 35)}
#: Lengths of international account numbers by country; fixed values.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: A web token: header and payload begin with an encoded brace.
JWT = "eyJ"
TOKEN = LABEL | {"_"}
BLOCK_BEGIN, BLOCK_END = "-----BEGIN ", "-----END "

Span = tuple[int, int, str]

_automaton = None


def automaton():
    """One automaton per Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        digits = sorted(DIGITS)
        a.add_word("@", ("at", 1))
        for d in digits:
            a.add_word("+" + d, ("plus", 2))
            a.add_word("." + d, ("dot", 2))
            for e in digits:
                for sep in ("", " ", "-"):
                    a.add_word(d + sep + e, ("digits", 2 + len(sep)))
            a.add_word("(" + d, ("bracket", 2))
        a.add_word(":", ("colon", 1))
        for s in SCHEMES:
            a.add_word(s, ("scheme", len(s)))
        for c in CUES:
            a.add_word(c, ("cue", len(c)))
        for k in KEYS:
            a.add_word(k.lower(), ("key", len(k)))
        for c in IBAN:
            for d in digits:
                a.add_word(c.lower() + d, ("iban", 3))
        a.add_word(JWT.lower(), ("jwt", len(JWT)))
        a.add_word(BLOCK_BEGIN.lower(), ("block", len(BLOCK_BEGIN)))
        a.make_automaton()
        _automaton = a
    return _automaton


def run_right(text: str, at: int, allowed: frozenset[str], most: int | None = None) -> int:
    """The end of the run of allowed characters at `at`, of which `most` are read."""
    n = len(text) if most is None else min(len(text), at + most)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_left(text: str, at: int, allowed: frozenset[str], floor: int) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def email_at(text: str, at: int, floor: int) -> Span | None:
    """An address around the at-sign at `at` that begins at `floor` or later."""
    begin = run_left(text, at, LOCAL, floor)
    if begin == at:
        return None
    end = run_right(text, at + 1, LABEL)
    if end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (more := run_right(text, end + 1, LABEL)) > end + 1:
        end = more
        labels += 1
    return (begin, end, "email") if labels > 1 else None


def ip_at(text: str, dot: int, floor: int) -> tuple[int, Span | None]:
    """Four dotted numbers whose first full stop is at `dot`; where to go on, and the span if its parts are valid."""
    begin = run_left(text, dot, DIGITS, floor)
    if begin == dot:
        return floor, None
    end, parts = dot, [text[begin:dot]]
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (more := run_right(text, end + 1, DIGITS)) == end + 1:
            return floor, None
        parts.append(text[end + 1 : more])
        end = more
    valid = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    return end, (begin, end, "ip") if valid else None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def card_at(text: str, begin: int) -> tuple[int, Span | None]:
    """The run of digits with single separators that begins at `begin`: its end, and the span if it is a card number."""
    end, n = begin + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end - begin < 14:
        return end, None
    digits = text[begin:end].replace(" ", "").replace("-", "")
    return end, (begin, end, "card") if 14 <= len(digits) <= 19 and luhn(digits) else None


def phone_at(text: str, plus: int) -> tuple[int, Span | None]:
    """A plus-sign, a digit, and the longest stretch of digits and separators that ends in a digit."""
    end = run_right(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return plus + 1, None
    return end, (plus, end, "phone") if 10 <= sum(c in DIGITS for c in text[plus:end]) <= 15 else None


def iban_at(text: str, at: int) -> int:
    """The end of the longest account number with right check digits that begins at `at`, or `at`."""
    end, ends, digits = at, [], ""
    while end < len(text) and len(digits) < 34 and (text[end] in DIGITS or text[end] in LETTERS or text[end] == " "):
        if text[end] == " ":
            ends.append((end, digits))
            if end + 1 >= len(text) or text[end + 1] == " ":
                break
        else:
            digits += text[end].upper()
        end += 1
    ends.append((end, digits))
    for stop, own in reversed(ends):
        if len(own) >= 15 and own[:2].isalpha() and own[2:4].isdigit() and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
            return stop
    return at


def free_iban(text: str, at: int) -> Span | None:
    """An account number in capitals that begins at `at`, of its country's length, its check digits right; groups may be parted
    by one blank each."""
    need = IBAN.get(text[at : at + 2])
    if need is None or (at and (text[at - 1] in LABEL or text[at - 1] == "_")):
        return None
    end, own = at, []
    while end < len(text) and len(own) < need:
        if text[end] in DIGITS or "A" <= text[end] <= "Z":
            own.append(text[end])
        elif text[end] != " " or text[end - 1] == " ":
            return None
        end += 1
    if len(own) < need or (end < len(text) and (text[end] in LABEL or text[end] == "_")) or own[3] not in DIGITS:
        return None
    return (at, end, "account") if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1 else None


def jwt_at(text: str, at: int) -> tuple[int, Span | None]:
    """A signed web token that begins at `at`, three parts between full stops; how far it was read, and the span if it is one."""
    if at and text[at - 1] in TOKEN:
        return at + 1, None
    end = run_right(text, at, TOKEN)
    if not text.startswith("." + JWT, end):
        return end, None
    end = run_right(text, end + 1, TOKEN)
    if end >= len(text) or text[end] != "." or (last := run_right(text, end + 1, TOKEN)) == end + 1:
        return end, None
    return last, (at, last, "key")


#: Characters of a name behind a cue, as in secret_access_key.
NAME_REST = 32


def account_after(text: str, end: int, cue: str) -> tuple[int, Span | None]:
    """The value named by a cue that ends at `end`: how far it was read, and the span if it is one."""
    n, at = len(text), end
    if at < n and text[at] in LETTERS:
        return end, None
    named = end
    if cue in SECRET and at < n and text[at] == "_":
        named = at = run_right(text, at, NAME, NAME_REST)
    while at < n and text[at] in " \t\"'" and at < named + 4:
        at += 1
    sign = at < n and text[at] in "=:#"
    if named > end and not sign:
        return end, None
    if sign:
        at += 1
    elif text.startswith("is ", at):
        at += 3
    elif cue != "ssn":
        return end, None
    stop = at + 4
    while at < min(n, stop) and text[at] in " \t\"'":
        at += 1
    if cue == "iban" and (close := iban_at(text, at)) > at:
        return close, (at, close, "account")
    if cue == "ssn":
        close = run_right(text, at, LABEL, 12)  # one more than the longest form
        own = text[at:close]
        fits = own.replace("-", "").isdigit() and [len(p) for p in own.split("-")] in ([9], [3, 2, 4])
        return end, (at, close, "account") if fits else None
    if cue in SECRET:
        quote = text[at - 1] if sign and text[at - 1] in "\"'" else ""
        close = at
        while close < n and not text[close].isspace() and text[close] != quote:
            close += 1
        read = close
        if not quote:
            while close > at and text[close - 1] in ".,;:!?)]}>\"'/+-":
                close -= 1
        own = text[at:close]
        strong = any(c in DIGITS for c in own) or (sign and any(c not in LETTERS for c in own))
        return read, (at, close, "account") if len(own) >= 6 and strong else None
    close = run_right(text, at, VALUE)
    while close > at and text[close - 1] in "./+-":
        close -= 1
    return end, (at, close, "account") if close - at >= 6 and any(c in DIGITS for c in text[at:close]) else None


def key_at(text: str, at: int, size: int) -> Span | None:
    """A key of a known form that begins at `at` with a prefix of `size` characters."""
    form = KEYS.get(text[at : at + size])
    if form is None or (at and (text[at - 1] in LABEL or text[at - 1] == "_")):
        return None
    end = run_right(text, at + size, form[0])
    return (at, end, "key") if end - at - size >= form[1] else None


def ipv6_at(text: str, colon: int, floor: int) -> tuple[int, Span | None]:
    """The run of hexadecimal digits and colons around a colon: its end, and the span if it is an address."""
    begin, end = run_left(text, colon, HEX, floor), run_right(text, colon, HEX)
    outside = LABEL | {"_", "."}
    while end > begin and text[end - 1] == ":" and not text.endswith("::", begin, end):
        end -= 1
    after = max(end, colon + 1)
    own = text[begin:end]
    groups = [g for g in own.split(":") if g]
    if len(own) > 39 or own.count(":") < 2 or len(groups) < 3 or (begin and text[begin - 1] in outside) or (end < len(text) and text[end] in LABEL):
        return after, None
    try:
        ipaddress.IPv6Address(own)
    except ValueError:
        return after, None
    return after, (begin, end, "ipv6")


LOCAL_NUMBER = re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")


def login_after(text: str, end: int) -> Span | None:
    """The user information of a URL whose scheme ends at `end`."""
    stop = len(text)
    at = end  # every scheme holds a slash, so scans of one text never overlap
    while at < stop and not text[at].isspace() and text[at] not in "/?#@\"'<>":
        at += 1
    return (end, at, "login") if at < stop and text[at] == "@" and ":" in text[end:at] else None


def find(text: str) -> list[Span]:
    """All spans, by start and then kind."""
    spans: list[Span] = []
    floor = dict.fromkeys((*BASE, "account", "ipv6", "block", "jwt"), 0)
    last_end = None
    low = _lower(text)
    for last, (what, size) in automaton().iter(low):
        at = last + 1 - size
        if what == "digits":
            if at >= floor["card"]:
                floor["card"], span = card_at(text, at)
                if span:
                    spans.append(span)
        elif what == "dot":
            if at >= floor["ip"]:
                floor["ip"], span = ip_at(text, at, floor["ip"])
                if span:
                    spans.append(span)
        elif what == "at":
            if span := email_at(text, at, floor["email"]):
                floor["email"] = span[1]
                spans.append(span)
        elif what == "plus":
            if at >= floor["phone"]:
                floor["phone"], span = phone_at(text, at)
                if span:
                    spans.append(span)
        elif what == "cue":
            if at >= floor["account"] and (at == 0 or text[at - 1] not in LETTERS):
                floor["account"], span = account_after(text, last + 1, low[at : last + 1])
                if span:
                    spans.append(span)
        elif what == "colon":
            if at >= floor["ipv6"]:
                floor["ipv6"], span = ipv6_at(text, at, floor["ipv6"])
                if span:
                    spans.append(span)
        elif what == "bracket":
            if m := LOCAL_NUMBER.match(text, at):
                spans.append((at, m.end(), "local"))
        elif what == "key":
            if span := key_at(text, at, size):
                spans.append(span)
        elif what == "iban":
            if span := free_iban(text, at):
                spans.append(span)
        elif what == "jwt":
            if at >= floor["jwt"] and text.startswith(JWT, at):
                floor["jwt"], span = jwt_at(text, at)
                if span:
                    spans.append(span)
        elif what == "block":
            if at < floor["block"] or not text.startswith(BLOCK_BEGIN, at):
                continue
            last_end = text.rfind(BLOCK_END) if last_end is None else last_end
            if at < last_end:  # so a search for the end is never in vain
                close = text.index(BLOCK_END, at)
                tail = text.find("-----", close + len(BLOCK_END), close + 80)
                floor["block"] = close = tail + 5 if tail > 0 else close + len(BLOCK_END)
                if "PRIVATE KEY" in text[at : min(at + 60, close)]:
                    spans.append((at, close, "key"))
        elif span := login_after(text, last + 1):
            spans.append(span)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], order[s[2]], s[1]))


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _lower(text: str) -> str:
    """The text in lower case, for cues in any case, with all offsets as they were."""
    low = text.lower()  # only ever grows
    return low if len(low) == len(text) else text.translate(_LOWER)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, and spans, an array of (start, end, kind) in order."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in find(t)] for t in string_list(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, type=span)], names=["id", "spans"])

    return mapped(source, run, f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go as one, named by the first."""
    out, at = [], 0
    for begin, end, kind in find(text):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans in the text column replaced; null stays null, other columns stay."""

    at = docs.columns.index(text_col)

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 :]], names=batch.schema.names)

    return rewritten(docs, at, change)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and, n_spans, of all spans, base_sha256 over kind:start:end of the base spans, and spans as text over all."""
    line = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.expr(f"sha2({line.format(base)}, 256)").alias("base_sha256"), F.expr(line.format("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

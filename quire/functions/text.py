"""Scalar text functions as column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that search ignores (not the no-break space).
SEARCH_BLANK = r"[ \t\n\r\f\x0B]"
#: Blanks between words on a page (not the line feed); fixed code points.
PAGE_BLANK = r"[\x{09}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
ENTITY = r"(?i)&(?:#[0-9]+|#x[0-9a-f]+|amp|lt|gt|quot|apos);"
#: Presentation-form ligatures and their letters; fixed by Unicode.
LIGATURES = dict(zip(map(chr, range(0xFB00, 0xFB07)), ("ff", "fi", "fl", "ffi", "ffl", "st", "st"), strict=True))


def normalise(text: Column) -> Column:
    """Lower case, without the blanks that search ignores."""
    return F.lower(F.regexp_replace(text, SEARCH_BLANK, ""))


def normalised_offsets(text: Column) -> Column:
    """For each character of normalise(text), its 0-based offset in the text."""
    marks = F.transform(F.split(text, ""), lambda c, i: F.when(~c.rlike(f"^{SEARCH_BLANK}$") & (c != ""), i))
    return F.filter(marks, lambda i: i.isNotNull())


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, "<[^>]*>", "")


def code_point(number: Column) -> Column:
    """The character of a code point, null beyond Unicode."""
    return F.when((number >= 0) & (number <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Numeric references and five named entities, in a single pass; others stay."""

    def one(e: Column) -> Column:
        low = F.lower(e)
        hexed = code_point(F.conv(F.substring(low, F.lit(4), F.length(low) - 4), 16, 10).try_cast("long"))
        number = code_point(F.substring(low, F.lit(3), F.length(low) - 3).try_cast("long"))
        named = F.when(low == "&amp;", "&").when(low == "&lt;", "<").when(low == "&gt;", ">").when(low == "&quot;", '"').when(low == "&apos;", "'")
        return F.coalesce(named.when(low.startswith("&#x"), hexed).when(low.startswith("&#"), number), e)

    parts, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    joined = F.array_join(F.zip_with(parts, F.transform(found, one), lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def escape_text(text: Column) -> Column:
    """Markup text: ampersand first, then the angle brackets."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    """As escape_text, with both quotes, and without control characters other than tab, line feed and carriage return."""
    clean = F.regexp_replace(text, r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{fffe}\x{ffff}]", "")
    return F.replace(F.replace(escape_text(clean), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def round2(x: Column) -> Column:
    """Two decimals, half away from zero; what is not finite is 0."""
    return F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.round(x, 2))


def shortest(x: Column) -> Column:
    """The shortest decimal text of a number without an exponent; -0 and what is not finite print as 0."""
    x = x.cast("double")
    plain = F.regexp_replace(F.format_string("%.6f", F.round(x, 6)), r"\.?0+$", "")
    return F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")) | (F.round(x, 6) == 0), F.lit("0")).otherwise(plain)


def quote_json(text: Column) -> Column:
    """A JSON string literal that is also a script literal: U+2028 and U+2029 are escaped."""
    body = F.regexp_extract(F.to_json(F.struct(text.alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.replace(F.replace(body, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def to_json(*columns: Column) -> Column:
    """An object with every field written, nulls as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def base64_plain(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as integers."""
    text = F.hex(data)
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(text, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a(data: Column) -> Column:
    """32-bit FNV-1a of a binary column; its offset basis and prime are fixed values."""
    step = lambda a, x: a.bitwiseXOR(x).__mul__(F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.octet_length(data) == 0, F.lit(2166136261)).otherwise(F.aggregate(byte_values(data), F.lit(2166136261), step))


def program_id(key: Column, data: Column) -> Column:
    return F.concat_ws("|", key, F.octet_length(data), F.lower(F.hex(fnv1a(data))))


def two_lane_digest(fields: Column) -> Column:
    """A name for a sequence of texts from two 32-bit lanes; the end of a field enters the first lane alone, so moving a
    border between fields changes the name."""
    a_mul, b_mul = 16777619, 0x85EBCA6B

    def times(x: Column, m: int) -> Column:  # modulo 2**32 without overflowing 64 bits
        low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
        return (low * F.lit(m) + (high * F.lit(m)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(0xFFFFFFFF))

    marks = F.flatten(F.transform(fields, lambda f: F.concat(F.transform(F.filter(F.split(f, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.array(F.lit(-1).cast("long")))))

    def step(s: Column, x: Column) -> Column:
        byte = F.when(x < 0, F.lit(0x100)).otherwise(x)
        b = F.when(x < 0, s["b"]).otherwise(times(s["b"].bitwiseXOR(x), b_mul))
        return F.struct(times(s["a"].bitwiseXOR(byte), a_mul).alias("a"), b.alias("b"))

    start = F.struct(F.lit(2166136261).cast("long").alias("a"), F.lit(0x9E3779B9).cast("long").alias("b"))
    return F.aggregate(marks, start, step, lambda s: F.concat(base36(s["a"]), F.lit("-"), base36(s["b"])))


def key_id(data: Column) -> Column:
    """The first 16 bytes of SHA-256 with each hex digit moved to the letters a to p."""
    return F.translate(F.substring(F.sha2(data, 256), 1, 32), "0123456789abcdef", "abcdefghijklmnop")


def integrity(data: Column) -> Column:
    return F.concat(F.lit("sha384-"), base64_plain(F.unhex(F.sha2(data, 384))))


def content_name(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 12)


def word_sum(data: Column) -> Column:
    """The sum of big-endian 32-bit words, the tail padded with zeros, modulo 2**32."""
    padded = F.rpad(F.hex(data), (F.ceil(F.octet_length(data) / 4) * 8).cast("int"), F.lit("0"))
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(data) / 4) - 1), lambda i: F.conv(F.substring(padded, (i * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long"))
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: (a + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.octet_length(data) == 0, F.lit(0).cast("long")).otherwise(total)


def utf16be(hexed: Column) -> Column:
    """Text of hexadecimal UTF-16BE, surrogates included."""
    return F.decode(F.unhex(hexed), "UTF-16BE")


def hex_code(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


def colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of three shares of 1."""
    part = lambda x: F.lpad(F.lower(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def spell_ligatures(text: Column) -> Column:
    for c, letters in LIGATURES.items():
        text = F.replace(text, F.lit(c), F.lit(letters))
    return text


def ligature_of(letters: Column) -> Column:
    """The code of the ligature for two or three letters; where two ligatures spell the same, the lower code."""
    out = F.lit(None).cast("int")
    for c, spelled in reversed(LIGATURES.items()):
        out = F.when(letters == spelled, F.lit(ord(c))).otherwise(out)
    return out


#: Code points of scripts that a renderer may reorder or reshape; fixed values.
JOINING = (
    (0x0590, 0x08FF), (0x0900, 0x0DFF), (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1100, 0x11FF), (0x1780, 0x17FF), (0x1900, 0x19FF),
    (0x1A00, 0x1CFF), (0xA800, 0xABFF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF), (0x10800, 0x11FFF), (0x1E800, 0x1EFFF),
)
JOINING_CLASS = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in JOINING)


def unsafe_characters(text: Column) -> Column:
    """How many characters belong to scripts that can't be split anywhere."""
    return F.length(F.regexp_replace(text, f"[^{JOINING_CLASS}]", "")).cast("long")

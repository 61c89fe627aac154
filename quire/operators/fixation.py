"""Reading fixation: the leading letters of each word are fixed, the rest fades, under a scope.

The length table and the dictionaries are parameters. BOUNDS is the documented default: a word of more than BOUNDS[i] and
at most BOUNDS[i + 1] letters keeps all but i + 1; past the last bound it keeps all but as many as there are bounds. The
bounds from 12 to 42 are a choice; tests pin the others.

Segments are marked in Python, many texts at a time: a ligature counts as its letters, a mark may carry over a run's border and
depends on the words on both sides, and Spark's functions of arrays would copy a text for every character folded in. How many
letters are fixed when all words may fade is an expression of the JVM (`fixed_letters`).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.workers import ship

BOUNDS = (0, 4, 12, 17, 24, 29, 35, 42, 48)
LONG_ENOUGH = 4
SEGMENT = "array<struct<fixation:boolean,text:string,chars:int>>"


@dataclass(frozen=True)
class Scope:
    """Which words may fade: all, short (LONG_ENOUGH letters or more), common (in the dictionary), or prose (in the
    dictionary, not a single letter, not an equation word)."""

    name: str = "all"
    dictionary: frozenset[str] = field(default_factory=frozenset)
    equation: frozenset[str] = field(default_factory=frozenset)

    def may_fade(self, word: str) -> bool:
        if self.name == "all":
            return True
        if self.name == "short":
            return len(word) >= LONG_ENOUGH
        low = word.lower()
        known = word.isalpha() and low in self.dictionary
        return known if self.name == "common" else known and len(word) > 1 and low not in self.equation


def kept(length: int, bounds: tuple[int, ...] = BOUNDS) -> int:
    """How many leading letters of a word are fixed."""
    return max(0, length - bisect.bisect_left(bounds, length))


#: A word: letters and digits of any script, as str.isalnum says; a ligature is a letter.
WORD = re.compile(r"[^\W_]+")
LIGATURE = re.compile(f"[{''.join(tx.LIGATURES)}]")


def _fading(word: str, scope: Scope, bounds: tuple[int, ...]) -> tuple[bool, int]:
    """Whether a word may fade, and how many of its characters are fixed; a ligature is fixed if its first letter is."""
    letters = word if word.isascii() or not LIGATURE.search(word) else "".join(tx.LIGATURES.get(c, c) for c in word)
    if not scope.may_fade(letters):
        return False, len(word)
    n = kept(len(letters), bounds) if letters.isalpha() or any(map(str.isalpha, letters)) else 0
    if letters is not word:
        at = [0, *accumulate(len(tx.LIGATURES.get(c, c)) for c in word)]
        n = bisect.bisect_left(at, n, 0, len(word))
    return True, n


def cuts(text: str, scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> list[tuple[bool, int]]:
    """Stretches of equal marks, each with its end. A word has a fixed beginning, a faded rest; what lies between words is fixed
    if it is no blank and a word beside it may not fade, and without words all is, but under the scope all."""
    narrow, out, at, before, last = scope.name != "all", [], 0, True, None

    def put(fixed: bool, end: int) -> None:
        nonlocal at, last
        if end > at:
            if fixed is last:
                out[-1] = (fixed, end)
            else:
                out.append((fixed, end))
            at, last = end, fixed

    for m in WORD.finditer(text):
        begin, end = m.span()
        fades, n = _fading(m[0], scope, bounds)
        if begin > at:
            put(narrow and not (before and fades) and not text[at:begin].isspace(), begin)
        put(True, begin + n)
        put(False, end)
        before = fades
    if at < len(text):
        put(narrow and (not at or not before and not text[at:].isspace()), len(text))
    return out


def marks(text: str, scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> list[bool]:
    """For each character, whether it is fixed; a ligature is fixed if any of its letters is."""
    out: list[bool] = []
    for f, end in cuts(text, scope, bounds):
        out += [f] * (end - len(out))
    return out


def segments(text: str, scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> list[tuple[bool, str]]:
    """Stretches of equal marks; together they are the text."""
    out, at = [], 0
    for f, end in cuts(text, scope, bounds):
        out.append((f, text[at:end]))
        at = end
    return out


def across(texts: Iterable[str], scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> list[list[tuple[bool, str]]]:
    """Segments of runs that carry one text on, marked as one and cut back into the runs."""
    texts = list(texts)
    whole = "".join(texts)
    stretches, out, at, k = cuts(whole, scope, bounds), [], 0, 0
    for t in texts:
        done, stop = [], at + len(t)
        while at < stop:
            f, end = stretches[k]
            done.append((f, whole[at : min(end, stop)]))
            at, k = min(end, stop), k + (end <= stop)
        out.append(done)
    return out


def with_segments(rows: DataFrame, text: str = "text", scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """rows with `segments`; null texts have none."""

    @F.pandas_udf(SEGMENT)
    def of(texts):
        return texts.map(lambda t: [{"fixation": f, "text": s, "chars": len(s)} for f, s in segments(t or "", scope, bounds)])

    return ship(rows).withColumn("segments", of(F.col(text)))


#: Segments of one batch from a worker, beyond which only the text at hand is finished.
SLICE = 1 << 15


def segment_rows(rows: DataFrame, key: str, text: str = "text", scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(key, n, fixation, text, chars): the segments of each whole text, a row each, n from 0; null texts have none. A batch
    holds few segments besides those of one text, however long the texts are."""
    source = rows.select(key, F.col(text).alias("text"))
    kind = source.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = [key, "n", "fixation", "text", "chars"]
        for batch in batches:
            ids, at, n, fixed, parts = batch.column(0), [], [], [], []

            def made(ids=ids):
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(fixed, pa.bool_()), pa.array(parts, pa.string()), pa.array(list(map(len, parts)), pa.int32())], names=names)

            for own in range(batch.num_rows):
                found = segments(batch.column(1)[own].as_py() or "", scope, bounds)
                at += [own] * len(found)
                n += range(len(found))
                fixed += [f for f, _ in found]
                parts += [part for _, part in found]
                if len(parts) >= SLICE:
                    yield made()
                    at, n, fixed, parts = [], [], [], []
            yield made()

    return ship(source).mapInArrow(run, f"{key} {kind}, n int, fixation boolean, text string, chars int")


def fixed_letters(text: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """How many characters of a text are fixed when all words may fade, as `marks` says for the scope all: an expression of the
    JVM. A word's length counts a ligature's letters, of which one fixed letter fixes the ligature; a word without a letter
    has none."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def kept_of(n: Column) -> Column:
        return F.greatest(F.lit(0), n - sum(((n > b).cast("int") for b in bounds), F.lit(0)))

    def spelled(word: Column) -> Column:
        letters = tx.spell_ligatures(word)
        before = lambda i: F.length(tx.spell_ligatures(F.substring(word, F.lit(1), i)))
        keep = kept_of(F.length(letters))
        return F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), F.lit(0), lambda a, i: a + (before(i) < keep).cast("int"))

    def fixed(word: Column) -> Column:
        plain = F.when(word.rlike(f"[{''.join(tx.LIGATURES)}]"), spelled(word)).otherwise(kept_of(F.length(word)))
        return F.when(word.rlike(r"\p{L}"), plain).otherwise(0)

    return F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + fixed(w)), F.lit(0).cast("long"))


def counts(rows: DataFrame, keys: list[str], text: str = "text", bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(keys, fixed, chars) of each whole text, all words of which may fade; a null text counts as empty."""
    return rows.select(*keys, fixed_letters(F.col(text), bounds).alias("fixed"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))


def with_joined_segments(runs: DataFrame, keys: list[str], scope: Scope = Scope(), bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(keys, first, parts): runs (keys, run_no, text, joins) of which each says whether it carries on the run before; the
    runs of one island are marked together."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w)
    grouped = runs.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("run_no").alias("first"), F.array_sort(F.collect_list(F.struct("run_no", "text"))).alias("r"))

    source = grouped.select(*keys, "first", F.col("r.text").alias("texts"))
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in [*keys, "first"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            begin, islands, cuts_at, fixed, parts = 0, [0], [0], [], []

            def made(stop, batch=batch):
                own = pa.StructArray.from_arrays([pa.array(fixed, pa.bool_()), pa.array(parts, pa.string()), pa.array(list(map(len, parts)), pa.int32())], names=["fixation", "text", "chars"])
                nested = pa.ListArray.from_arrays(pa.array(islands, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts_at, pa.int32()), own))
                plain = batch.slice(begin, stop - begin)
                return pa.RecordBatch.from_arrays([*plain.columns[:-1], nested], names=[*keys, "first", "parts"])

            for n in range(batch.num_rows):
                for own in across(batch.column("texts")[n].as_py(), scope, bounds):
                    fixed += [f for f, _ in own]
                    parts += [part for _, part in own]
                    cuts_at.append(len(parts))
                islands.append(len(cuts_at) - 1)
                if len(parts) >= SLICE:
                    yield made(n + 1)
                    begin, islands, cuts_at, fixed, parts = n + 1, [0], [0], [], []
            yield made(batch.num_rows)

    return ship(source).mapInArrow(run, f"{kinds}, parts array<{SEGMENT}>")

"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted-target and raw multinomials.

Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return. For the n-grams,
runs of ASCII punctuation other than comma, full stop and hyphen are tokens of their own. Token unigrams and bigrams
are hashed into a fixed number of buckets; the raw multinomial counts every document given, the target
multinomial those whose id is trusted, both smoothed by add-one. A document's score is the mean over its n-grams of
log p_target - log p_raw, and a fixed threshold decides on every document.

Only DataFrame operations: a text is read twice (counts, scores); the counts shuffle one row per bucket and task, and
what reaches the driver is the bucket table, whose size is the parameter `buckets`. Repeated 3-word windows are found
by their 64-bit hashes, sorted within the row.

Defined results: a null or empty text has no words, fails the base rules and is not kept, with score 0; documents with
equal texts get equal scores; repeated rows are counted each; null ids are never trusted; without any trusted document
both multinomials are the raw one and every score is 0; an empty table gives an empty result. Columns added by
`judge` replace input columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\\\x20\\\\x09-\\\\x0D]"
SYMBOLS = "[!-+/:-@\\\\[-`{-~]+"
#: Hash buckets of the multinomials.
BUCKETS = 8192
#: A document whose mean log-likelihood ratio per n-gram is lower goes.
THRESHOLD = -0.25
#: Ids of trusted documents are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def _words(text: str) -> str:
    return f"array_remove(split(coalesce({text}, ''), '{BLANK}+'), '')"


def _tokens(text: str) -> str:
    return _words(f"regexp_replace({text}, '{SYMBOLS}', ' $0 ')")


def _bucket(buckets: int, *args: str) -> str:
    return f"cast(pmod(xxhash64({', '.join(args)}), {buckets}) as int)"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that labels mark as of quality 1 (a repeated id counts once, and if any of its rows says 1)."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log p_target - log p_raw by bucket, from all rows of docs; trusted: a column of ids."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("tid")).where("tid is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")).join(ids, F.col("id") == F.col("tid"), "left")
    # a row per token with its follower, then one per unigram and bigram; both are generated code
    tokens = rows.select(F.col("tid").isNotNull().cast("long").alias("t"), F.expr(_tokens("text")).alias("g"))
    paired = tokens.select("t", F.explode(F.arrays_zip(F.col("g").alias("a"), F.expr("slice(g, 2, greatest(size(g), 1))").alias("b"))).alias("p"))
    grams = paired.select("t", F.explode(F.expr(f"array({_bucket(buckets, 'p.a')}, if(p.b is null, null, {_bucket(buckets, 'p.a', 'p.b')}))")).alias("b")).where("b is not null")
    found = {r["b"]: (r["raw"], r["target"]) for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()}  # at most `buckets` rows
    n_raw, n_target = (sum(x[k] for x in found.values()) for k in (0, 1))
    if not n_target:
        return [0.0] * buckets
    out = []
    for b in range(buckets):
        raw, target = found.get(b, (0, 0))
        out.append(math.log((target + 1) / (n_target + buckets)) - math.log((raw + 1) / (n_raw + buckets)))
    return out


def windows_expr(words: str) -> str:
    """Hashes of the 3-word windows of an array of words."""
    return f"case when size({words}) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) end"


def repeat_expr(hashes: str) -> str:
    """Words in windows that occur twice or more, the first occurrence included; hashes: of windows, in order."""
    pairs = f"sort_array(transform({hashes}, (x, i) -> struct(x as x, i as i)))"
    near = "zip_with(p, slice(p, 2, greatest(size(p), 1)), (d, e) -> if(d.x = e.x, array(d.i, e.i), null))"
    cover = f"size(array_distinct(flatten(transform(flatten(filter({near}, e -> e is not null)), i -> array(i, i + 1, i + 2)))))"
    return f"case when size(array_distinct({hashes})) = size({hashes}) then 0L else cast(transform(array({pairs}), p -> {cover})[0] as bigint) end"


def unused(columns: list[str]) -> str:
    """A prefix that begins no name of columns, whatever its case."""
    prefix = "quire_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def named(column: str) -> str:
    """A column's name as a plain reference, dots and backticks included."""
    return "`" + column.replace("`", "``") + "`"


def _held(expression: str) -> str:
    """The expression, marked so that the optimiser computes it once, here: a filter on a column that was pushed below it
    would copy it into lambdas, where a split is read anew for every word."""
    return f"if(monotonically_increasing_id() < 0, null, {expression})"


def judge(docs: DataFrame, llr: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with the columns ADDED."""
    table = f"cast(split('{','.join(map(repr, llr))}', ',') as array<double>)"  # folded to one literal
    docs = docs.drop(*(c for c in ADDED if c != text_col))
    kept = [F.col(named(c)) for c in docs.columns]
    p = unused(docs.columns)
    text, w, g, h = f"coalesce({named(text_col)}, '')", f"{p}w", f"{p}g", f"{p}h"
    split = docs.select(*kept, F.expr(_held(_words(text))).alias(w), F.expr(_held(_tokens(text))).alias(g))
    hashed = split.select(*kept, w, g, F.expr(_held(windows_expr(w))).alias(h))
    n = len(llr)
    ratio = f"zip_with({g}, slice({g}, 2, greatest(size({g}), 1)), (x, y) -> get({table}, {_bucket(n, 'x')}) + if(y is null, 0D, get({table}, {_bucket(n, 'x', 'y')})))"
    mean = f"case when size({g}) = 0 then 0D else aggregate({ratio}, 0D, (a, b) -> a + b) / (2 * size({g}) - 1) end"
    lines = f"filter(split({text}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    made = {
        "n_words": f"cast(size({w}) as bigint)",
        "word_chars": f"cast(length(array_join({w}, '')) as bigint)",
        "n_symbols": f"cast(regexp_count({text}, '[#*$%&|<>]') as bigint)",
        "lines": lines,
        "n_repeat_words": repeat_expr(h),
        "llr": mean,
    }
    out = hashed.select(*kept, *(F.expr(_held(e)).alias(p + c) for c, e in made.items()))
    failed: Column = F.expr(f"{p}n_words < 50 or 100 * {p}n_repeat_words > 50 * {p}n_words")
    dup = F.expr(f"cast(size({p}lines) - size(array_distinct({p}lines)) as bigint)")
    counts = [dup.alias(c) if c == "n_dup_lines" else F.col(p + c).alias(c) for c in ADDED[:5]]
    return out.select(*kept, *counts, failed.alias("base_failed"), F.col(f"{p}llr").alias("llr"), (~failed & (F.col(f"{p}llr") >= threshold)).alias("kept"))

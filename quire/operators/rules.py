"""Rules that drop lines by regular expression: lists, validation, templates, matching.

Patterns search (they need not match the whole text) and come from the caller. A few dozen are folded into one predicate,
which stays in generated code; larger sets are joined as a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship
from .folds import folded

FOLD_UP_TO = 64
#: Rules broadcast at a time; a larger table goes in parts.
BROADCAST_RULES = 1024
#: Rules that a reader may add at most; a fixed value.
MAX_CUSTOM = 50


def pattern_list(text: Column) -> Column:
    """The distinct non-empty lines of a text, trimmed, the first of equals staying in place."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))


def validate(pattern: str) -> str | None:
    """Why a pattern can't be used, in one line, or None. Look-around and back-references are refused."""
    if not pattern.strip():
        return "the pattern is empty"
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!]|>)", pattern):
        return "look-around is not supported"
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        return "back-references are not supported"
    try:
        re.compile(pattern)
    except re.error as e:
        return f"not a regular expression: {e.msg}"
    return None


def reasons(rows: DataFrame, pattern: str) -> DataFrame:
    """rows with `reason`: why a pattern can't be used, null where it can or is null. Patterns are compiled in Python workers, in
    batches, so one that Spark would refuse ends no query."""

    @F.pandas_udf("string")
    def of(patterns):
        return patterns.map(lambda p: None if p is None else validate(p))

    return ship(rows).withColumn("reason", of(F.col(pattern)))


def java(pattern: str) -> str:
    """A pattern whose classes are Unicode's and whose last `$` means the end of the text only."""
    body = re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\z", pattern)
    return f"(?U){body}"


def expand(pattern: Column, title: Column) -> Column:
    """`{title}` replaced by the escaped title; an empty title leaves the placeholder."""
    escaped = F.regexp_replace(title, r"[.*+?^${}()|\[\]\\]", r"\\$0")
    return F.when(F.coalesce(title, F.lit("")) == "", pattern).otherwise(F.replace(pattern, F.lit("{title}"), escaped))


def usable(needs_title: Column, title: Column) -> Column:
    return ~needs_title | (F.coalesce(title, F.lit("")) != "")


def filtered(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found anywhere in the text."""
    out = F.lit(False)
    for p in patterns:
        if reason := validate(p):
            raise ValueError(f"{p!r}: {reason}")
        out |= text.rlike(java(p))
    return out


def keep(lines: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Lines that hold text and match no pattern."""
    some = lines.where(F.col(text) != "")
    if len(patterns) <= FOLD_UP_TO:
        return some.where(~filtered(F.col(text), patterns))
    spark = lines.sparkSession
    for p in patterns:
        if reason := validate(p):
            raise ValueError(f"{p!r}: {reason}")
    rules = spark.createDataFrame([(java(p),) for p in patterns], "pattern string")  # given by the caller, so of bounded size
    return some.join(F.broadcast(rules), F.expr(f"`{text}` rlike pattern"), "left_anti")


def matches(lines: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, n_lines, n_docs) of each rule of a rule table (id, pattern), rules without a match included.

    A few dozen rules are tried together, in one pass over the lines; more are counted first and broadcast in parts of a
    fixed size, a pass each."""
    n = rules.count()
    if n <= FOLD_UP_TO:
        given = [r for r in rules.select("id", "pattern").collect() if r["pattern"] is not None]  # at most FOLD_UP_TO
        kind = rules.schema["id"].dataType
        tried = [F.when(F.col(text).rlike(r["pattern"]), F.lit(r["id"]).cast(kind)) for r in given] or [F.lit(None).cast(kind)]
        found = lines.select(key, F.explode(F.array_compact(F.array(*tried))).alias("id"))
    else:
        parts = -(-n // BROADCAST_RULES)
        found = None
        for part in range(parts):
            own = rules.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
            each = lines.join(F.broadcast(own), F.expr(f"`{text}` rlike pattern")).select(key, "id")  # about BROADCAST_RULES rows
            found = each if found is None else found.unionByName(each)
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct(key).alias("n_docs"))
    return rules.select("id").join(counts, "id", "left").fillna(0, ["n_lines", "n_docs"])


def adopt(stored: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored patterns (ord, pattern) that a known rule (id, pattern) explains, and those that become rules of their own."""
    same = F.col("s.pattern") == F.col("k.pattern")
    s, k = stored.alias("s"), known.alias("k")
    return s.join(k, same, "inner").select("s.ord", "k.id", "s.pattern"), s.join(k, same, "left_anti")


def in_order(built_in: DataFrame, custom: DataFrame, adopted: DataFrame) -> DataFrame:
    """One list of rules (ord, id, pattern) from three, in that order."""
    parts = [p.select(F.lit(i).alias("src"), "ord", "id", "pattern") for i, p in enumerate((built_in, custom, adopted))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def select_all(rules: DataFrame, title: Column, on: bool = True) -> DataFrame:
    """(id) of the rules that are checked after all were switched on - those alone that this title lets be used - or off."""
    return rules.where(usable(F.col("needs_title"), title) & F.lit(on)).select("id")


def all_selected(rules: DataFrame, chosen: DataFrame, title: Column) -> DataFrame:
    """One row: whether every rule (id, needs_title) that can be used is among the chosen ids."""
    left = rules.where(usable(F.col("needs_title"), title)).join(chosen.select("id"), "id", "left_anti")
    return left.agg((F.count(F.lit(1)) == 0).alias("all_selected"))


def add_custom(rules: list[dict], pattern: str, label: str | None = None) -> tuple[list[dict], str | None]:
    """A list with one more custom rule, or the list as it was and the reason; ids are the least free custom-n."""
    text = pattern.strip()
    if reason := validate(text):
        return rules, reason
    if any(r["pattern"] == text for r in rules):
        return rules, "the pattern is there already"
    if len(rules) >= MAX_CUSTOM:
        return rules, "there are too many rules"
    used = {r["id"] for r in rules}
    n = next(i for i in range(1, len(used) + 2) if f"custom-{i}" not in used)
    return [*rules, {"id": f"custom-{n}", "label": label or text, "pattern": text}], None


def custom_rules(actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, n, id, reason) for each action of a key, n from 0: the rule that it added or removed, or why it did nothing.

    actions: key, order, action, pattern, id. `add` takes a pattern, `remove` an id; others and null do nothing. A key has
    MAX_CUSTOM rules at most, which is all that a task holds; ids are the least free custom-n."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[dict] = []
        for n, (action, pattern, own) in enumerate(rows):
            made, reason = None, None
            if action == "add":
                before = {r["id"] for r in held}
                held, reason = add_custom(held, pattern or "")
                made = next((r["id"] for r in held if r["id"] not in before), None)
            elif action == "remove" and any(r["id"] == own for r in held):
                held, made = [r for r in held if r["id"] != own], own
            yield n, made, reason

    return folded(actions, key, order, ["action", "pattern", "id"], fold, "n long, id string, reason string")


def load_custom(items: list) -> list[dict]:
    """Rules from a stored list of unknown quality: strings and objects with a pattern stay, ids are numbered anew where
    they are missing, taken, or not of a custom rule."""
    out: list[dict] = []
    for item in items:
        pattern = item if isinstance(item, str) else item.get("pattern") if isinstance(item, dict) else None
        if isinstance(pattern, str) and pattern.strip() and len(out) < MAX_CUSTOM:
            made, reason = add_custom(out, pattern, item.get("label") if isinstance(item, dict) else None)
            if reason is None:
                out = made
    return out

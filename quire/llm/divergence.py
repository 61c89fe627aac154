"""How far the sources of each language lie apart, by mergeable radix tries.

Every partition counts the terms of its documents in byte tries, one a language, that branch where they have to: paths are
compressed, for a leaf page holds the rests of its terms until it is large. A term's leaf holds the number of documents with it
and a counter for each source. A trie that has grown to LEAVES counters is emptied by a traversal in the order of the bytes,
which is UTF-8's order of the terms. Tries merge by prefix range: their traversals are
dealt out by ranges of (language, term) and read in order, so that a task has all leaves of a term side by side and adds up
their counters without holding more than a batch. What is left, the terms of enough documents with their counters, is written
once; the sums over it give each group's N and each language's V. A second traversal of that table streams the pairs - a sum
for each two sources of a language - and, for each group, the RANKS best terms with all ties; windows rank what the tasks leave.

Arithmetic is exact: p = 1 + floor(10^9 (count + 1) / (N + V)) by long division in steps of three digits, right for N + V below
9 * 10^15, and floor((p - q)^2 / q) in 64 bits. Sums of the latter stay below (10^9 + V)^2.

Defined results: null text, language and source read as the empty text; each row is a document, repeated rows too; a group
without terms, and a language without kept terms, is reported with pairs (value 0 if V = 0); an empty table gives an empty
result; texts of any length are read whole, about CHUNK_CHARS of them or one row at a time; other columns are not read. Work
grows with the kept terms times the square of a language's sources, as the pairs themselves do. The list of groups goes to
the tasks in blocks of languages with about GROUPS groups each, so its size is bounded however many languages there are.
"""

from __future__ import annotations

import gc
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mapped, shared_folder, slices

#: Documents of a language that a kept term is in at least, and ranks of terms reported; fixed values of the report.
DOCUMENTS, RANKS = 3, 200
SCALE = 1_000_000_000
#: Counters of a worker's tries at most, and different words that are counted before they go into them.
LEAVES, WORDS = 800_000, 250_000
#: Groups that one traversal knows, about; cells of one dense array of counts.
GROUPS, CELLS = 50_000, 1 << 20

#: Letters and bytes beyond ASCII stay, capitals become small, all else separates.
FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


#: Bytes by which a root branches, and terms of a leaf that make it branch.
ROOT, BURST = 3, 4096


class Leaf:
    """What a trie knows of a term: the documents with it, and its count in each source."""

    __slots__ = ("counts", "documents")

    def __init__(self):
        self.documents, self.counts = 0, {}


class Branch(dict):
    """A node: what follows, by the next byte; the empty one is a term's end."""


class Trie:
    """A byte trie that branches where it has to: its root by the first ROOT bytes, and below them a leaf page holds the rests of
    its terms, each with its counters, until it has more than BURST and branches by the next byte. size: counters held."""

    def __init__(self):
        self.top: dict[bytes, dict] = {}
        self.size = 0

    def leaf(self, term: bytes) -> Leaf:
        """The term's counters, made if they are not there."""
        first, rest = term[:ROOT], term[ROOT:]
        above, page = self.top, self.top.get(first)
        if page is None:
            page = above[first] = {}
        while type(page) is Branch:
            first, rest = rest[:1], rest[1:]
            above, page = page, page.get(first)
            if page is None:
                page = above[first] = {}
        found = page.get(rest)
        if found is None:
            found = page[rest] = Leaf()
            if len(page) > BURST and rest:
                above[first] = branch = Branch()
                for end, own in page.items():
                    branch.setdefault(end[:1], {})[end[1:]] = own
        return found

    def add(self, term: bytes, source: str, n: int) -> None:
        counts = self.leaf(term).counts
        if source not in counts:
            counts[source] = 0
            self.size += 1
        counts[source] += n

    def leaves(self) -> Iterator[tuple[bytes, Leaf]]:
        """Terms in the order of their bytes."""
        stack = [(first, self.top[first]) for first in sorted(self.top, reverse=True)]
        while stack:
            before, page = stack.pop()
            if type(page) is Branch:
                stack += [(before + byte, page[byte]) for byte in sorted(page, reverse=True)]
            else:
                for rest in sorted(page):
                    yield before + rest, page[rest]

    def merge(self, other: Trie) -> None:
        """Take over what another trie has counted."""
        for term, leaf in other.leaves():
            for source, n in leaf.counts.items():
                self.add(term, source, n)
            self.leaf(term).documents += leaf.documents


class Counting:
    """The tries of a partition, by language. Words of recent documents are counted by group first and go into the tries together."""

    def __init__(self):
        self.tries: dict[str, Trie] = {}
        self.words: dict[tuple[str, str], Counter] = {}
        self.documents: dict[str, Counter] = {}
        self.waiting = 0

    def read(self, lang: str, source: str, text: bytes) -> None:
        words = text.translate(FOLD).split()
        own = self.words.setdefault((lang, source), Counter())
        before = len(own)
        own.update(words)
        self.documents.setdefault(lang, Counter()).update(set(words))
        self.waiting += len(own) - before
        if self.waiting > WORDS:
            self.pour()

    def pour(self) -> None:
        """Each waiting term is looked up in its language's trie once, for all sources."""
        for lang, documents in self.documents.items():
            trie = self.tries.setdefault(lang, Trie())
            places = {}
            for term, n in documents.items():
                places[term] = leaf = trie.leaf(term)
                leaf.documents += n
            for source in [s for x, s in self.words if x == lang]:
                for term, n in self.words[lang, source].items():
                    counts = places[term].counts
                    if source in counts:
                        counts[source] += n
                    else:
                        counts[source] = n
                        trie.size += 1
        self.words, self.documents, self.waiting = {}, {}, 0

    @property
    def full(self) -> bool:
        return sum(t.size for t in self.tries.values()) > LEAVES

    def emptied(self) -> Iterator[pa.RecordBatch]:
        """All leaves as rows, language by language, in the order of the terms."""
        self.pour()
        for lang in sorted(self.tries):
            terms, documents, sizes, sources, counts = [], [], [0], [], []
            for term, leaf in self.tries[lang].leaves():
                terms.append(term)
                documents.append(leaf.documents)
                sources += leaf.counts
                counts += leaf.counts.values()
                sizes.append(len(sources))
                if len(terms) == 20_000:
                    yield _leaves(lang, terms, documents, sizes, sources, counts)
                    terms, documents, sizes, sources, counts = [], [], [0], [], []
            if terms:
                yield _leaves(lang, terms, documents, sizes, sources, counts)
        self.tries = {}


def _leaves(lang: str, terms: list, documents: list, sizes: list, sources: list, counts: list) -> pa.RecordBatch:
    own = lambda values, kind: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, kind))
    columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(documents, pa.int64()), own(sources, pa.string()), own(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "documents", "sources", "counts"])


LEAF = "lang string, term binary, documents long, sources array<string>, counts array<long>"


def counted(docs: DataFrame) -> DataFrame:
    """The leaves of every partition's tries: (lang, term, documents, sources, counts), a term once for each trie it was in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Counting()
        gc.disable()  # tries hold many nodes and no circles
        try:
            for whole in batches:
                for batch in slices(whole, "text"):
                    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                        tries.read(lang, source, text)
                    if tries.full:
                        yield from tries.emptied()
            yield from tries.emptied()
        finally:
            gc.enable()

    return mapped(docs.select("lang", "source", "text"), run, LEAF)


def merged(leaves: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """Leaves of the same term added up, where `least` documents or more have it; dealt out by ranges and in their order."""
    rows = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            fresh = _fresh(table)
            last = int(np.flatnonzero(fresh)[-1])  # the last term may go on in the next batch
            if last:
                yield from _added(table.slice(0, last), fresh[:last], least)
            held = pa.concat_tables([table.slice(last)]) if last or table.num_rows < 20_000 else _one(table)
        if held is not None:
            yield from _added(held, _fresh(held), least)

    return mapped(rows, run, LEAF)


def _fresh(table: pa.Table) -> np.ndarray:
    """Where another term begins."""
    fresh = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        columns = (table.column(c).combine_chunks() for c in ("lang", "term"))
        lang, term = (np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))) for c in columns)
        fresh[1:] = lang | term
    return fresh


def _one(table: pa.Table) -> pa.Table:
    """Many leaves of one term as one, so that a common term never fills a task."""
    return pa.Table.from_batches(list(_added(table, _fresh(table), 0)))


def _added(table: pa.Table, fresh: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    first = np.flatnonzero(fresh)
    documents = np.add.reduceat(np.asarray(table.column("documents")), first)
    sources = pc.list_flatten(table.column("sources")).combine_chunks().dictionary_encode()
    counts = np.asarray(pc.list_flatten(table.column("counts")))
    sizes = np.asarray(pc.list_value_length(table.column("sources")))
    term = np.repeat(np.cumsum(fresh) - 1, sizes)
    names = sources.dictionary
    pair = term * len(names) + np.asarray(sources.indices).astype(np.int64)
    order = np.argsort(pair, kind="stable")
    pair, counts = pair[order], counts[order]
    begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    counts, pair = np.add.reduceat(counts, begin), pair[begin]
    kept = documents >= least
    stays = kept[pair // len(names)]
    counts, pair = counts[stays], pair[stays]
    each = np.bincount(pair // len(names), minlength=len(first))[kept]
    offsets = pa.array(np.r_[0, np.cumsum(each)].astype(np.int32))
    rows = table.take(pa.array(first[kept]))
    columns = [
        rows.column("lang").combine_chunks(), rows.column("term").combine_chunks(), pa.array(documents[kept]),
        pa.ListArray.from_arrays(offsets, names.take(pa.array(pair % len(names)))), pa.ListArray.from_arrays(offsets, pa.array(counts)),
    ]
    yield from pa.Table.from_arrays(columns, names=["lang", "term", "documents", "sources", "counts"]).to_batches()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals below 9 * 10^15."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Language:
    """What a traversal gathers of one language: sums for each two sources and the best terms of each."""

    def __init__(self, sources: list[str], n: list[int], v: int):
        self.sources = pa.array(sources, pa.string())
        self.total, self.all = np.array(n, np.int64) + v, sum(n) + v
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in sources]
        self.bar = [-1] * len(sources)

    def read(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray) -> None:
        s, sizes = len(self.sources), np.asarray(pc.list_value_length(sources))
        where = np.asarray(pc.index_in(sources.flatten(), self.sources)).astype(np.int64)
        count = np.zeros((len(terms), s), np.int64)
        count[np.repeat(np.arange(len(terms)), sizes), where] = np.asarray(counts.flatten())
        p = shares(count, self.total[None])
        q = shares(count.sum(axis=1), np.int64(self.all))
        for i in range(s):
            self.pairs[i] += distance(p[:, i : i + 1], p).sum(axis=0)
            f = distance(p[:, i], q)
            near = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q) & (f >= self.bar[i]))
            self.best[i] += zip(f[near].tolist(), terms.take(pa.array(near)).to_pylist(), strict=True)
            if len(self.best[i]) > 4 * RANKS:
                self._prune(i)

    def _prune(self, i: int) -> None:
        self.best[i] = sorted(self.best[i], key=lambda x: (-x[0], x[1]))[:RANKS]
        self.bar[i] = self.best[i][-1][0] if len(self.best[i]) == RANKS else -1

    def rows(self) -> Iterator[tuple[str, str, bytes, int]]:
        names = self.sources.to_pylist()
        for i, source in enumerate(names):
            for j, item in enumerate(names):
                if i != j:
                    yield source, "pair", item.encode(), int(self.pairs[i, j])
            self._prune(i)
            for value, term in self.best[i]:
                yield source, "term", term, value


FOUND = "lang string, source string, part string, item binary, value long"


def traversed(terms: DataFrame, known: dict[str, tuple[list[str], list[int], int]]) -> DataFrame:
    """(lang, source, part, item, value) of each task: its share of the pairs' sums and its best terms. known: of each
    language its sources, their N, and V."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Language] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = np.asarray(langs.indices)
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                own = seen.get(lang) or seen.setdefault(lang, Language(*known[lang]))
                rows = batch.take(pa.array(np.flatnonzero(code == c)))
                step = max(1, CELLS // len(own.sources))
                for at in range(0, rows.num_rows, step):
                    part = rows.slice(at, step)
                    own.read(part.column("term"), part.column("sources"), part.column("counts"))
        for lang, own in seen.items():
            out: list[tuple] = []
            for row in own.rows():
                out.append(row)
                if len(out) == 50_000:
                    yield _found(lang, out)
                    out = []
            if out:
                yield _found(lang, out)

    return mapped(terms.select("lang", "term", "sources", "counts"), run, FOUND)


def _found(lang: str, rows: list[tuple]) -> pa.RecordBatch:
    source, part, item, value = zip(*rows, strict=True)
    columns = [pa.array([lang] * len(rows), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


def kept_terms(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """(lang, term, documents, sources, counts): the terms of `least` documents of a language or more, from a written table in
    the shared folder. The tries' leaves are written first, for ranges are chosen from a sample of them, and deleted after."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4().hex}"
    counted(docs).write.parquet(f"{folder}/leaves", compression="zstd")
    merged(spark.read.schema(LEAF).parquet(f"{folder}/leaves"), least).write.parquet(f"{folder}/terms", compression="zstd")
    _delete(spark, f"{folder}/leaves")
    return spark.read.schema(LEAF).parquet(f"{folder}/terms")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` holds a group's distance to each other source of its language,
    part `term` its own terms that are more frequent than in the language, RANKS at most; rank 1 is the largest value, ties
    in the order of UTF-8."""
    spark = docs.sparkSession
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))
    terms = kept_terms(docs)
    sums = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = cut(groups.join(sizes, "lang", "left").select("lang", "source", "n", F.coalesce("v", F.lit(0)).alias("v")))
    blocks = 1 + groups.count() // GROUPS
    found = None
    for b in range(blocks):
        mine = lambda df: df.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b) if blocks > 1 else df  # noqa: B023, E731
        known: dict[str, tuple[list[str], list[int], int]] = {}
        for row in mine(groups).orderBy("lang", "source").toLocalIterator():
            own = known.setdefault(row["lang"], ([], [], row["v"]))
            own[0].append(row["source"])
            own[1].append(row["n"])
        part = traversed(mine(terms), known)
        found = part if found is None else found.unionByName(part)
    # a language without kept terms is in no traversal
    silent = groups.where("v = 0")
    other = silent.select("lang", F.col("source").cast("binary").alias("item"))
    zero = silent.join(other, "lang").where(F.col("source").cast("binary") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.unionByName(zero).where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rows = pairs.unionByName(best(found.where("part = 'term'")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= RANKS))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


#: Parts that a group's candidates are thinned in before they are ranked together.
PARTS = 8


def best(terms: DataFrame) -> DataFrame:
    """The tasks' candidates that may be among the RANKS best of their group: those of a part of the group's terms first, so that
    the task that ranks a group reads PARTS * RANKS rows at most, however many tasks there were."""
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS))
    rank = F.row_number().over(Window.partitionBy("lang", "source", part).orderBy(F.desc("value"), "item"))
    return terms.withColumn("_rank", rank).where(F.col("_rank") <= RANKS).drop("_rank")


#: The rows of op13_divergence in DuckDB's SQL.
SQL = """
with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
counts as (select lang, source, term, count(*) as n from words group by all),
kept as (select lang, term from words group by all having count(distinct id) >= 3),
v as (select l.lang, count(k.term) as v from (select distinct lang from docs) l left join kept k using (lang) group by all),
own as (select c.* from counts c join kept k using (lang, term)),
groups as (select g.lang, g.source, coalesce(sum(o.n), 0)::hugeint as total from (select distinct lang, source from docs) g left join own o using (lang, source) group by all),
langs as (select lang, sum(total)::hugeint as total from groups group by all),
p as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 1)) // (g.total + v.v) as p
  from groups g join v using (lang) join kept k using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
q as (select o.lang, o.term, 1 + (1000000000::hugeint * (sum(o.n)::hugeint + 1)) // (any_value(l.total) + any_value(v.v)) as q from own o join langs l using (lang) join v using (lang) group by all),
pair_ as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::hugeint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pair_ x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q) // q.q)::bigint as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""

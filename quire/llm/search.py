"""Exact top-k search: BM25 over an inverted index with block-max WAND dynamic pruning.

Terms are the words between ASCII blanks after lower-casing A-Z, a query is the bag of terms of a whole text. Scores are
sums of integer impacts (BM25 contributions times SCALE, rounded), so they do not depend on the order of additions; ties
go to the lower id.

One pass over the documents inverts shards of SHARD_BYTES of text and writes them, one row each, to the shared folder.
The global statistics (documents, words, document frequencies of the queries' terms) are sums over the shards. Queries
are handled in blocks of BLOCK_TERMS distinct-term entries, so what is collected and broadcast is bounded whatever the
corpus holds; a block is searched first in a few shards, whose k-th best scores are lower bounds everywhere, then in the
rest. In a shard many queries are handled side by side; a query whose terms' greatest contributions there don't reach its k-th best
score so far is passed over. For the others:
1. the postings of the rare terms are scored;
2. to each document's sum the maxima of the common terms (held by one document in COMMON, or more) in its block of RUN documents are
added. A document whose bound reaches the k-th best score is a pivot, and a block without a pivot is skipped whole;
3. what the common terms add is looked up for a few pivots of a block; for more of them it is a product of the block's impacts and the
queries' weights in single precision, whose error is bounded;
4. documents that may reach the k-th best score, whatever that error, are scored exactly.
A shard's documents are laid in the order of their most frequent terms, so that documents of one language or kind share blocks
and a block's maxima say more.
The shards' top k are merged exactly, as all use global statistics.

Defined results: a query without terms, or whose terms no document holds, has no rows; documents without terms are never
found; a document finds itself; fewer than k matching documents give fewer rows; repeated rows are documents of their own,
but rows of one query id are asked once, with the least of their texts; ids are integers of any width (another type is an
error); rows with a null id are counted in the statistics, but neither queries nor results; very long texts make shards of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped, slices, word_hashes

K, K1, B = 10, 1.2, 0.75
SCALE = 1_000_000
BLOCK_TERMS = 1_000_000
#: RUN: documents of a block with maxima of its own.
SHARD_BYTES, RUN = 1 << 25, 256
#: A term that one document in so many of a shard holds is common there; CELLS bounds the matrix of the common terms.
COMMON, CELLS = 32, 1 << 24
#: Share of the shards that a block of queries is searched in first.
SEEDS = 1 / 16
#: Queries are handled together while their postings and sums are about so many.
BATCH = 1 << 21
#: Up to one document in so many of a block are looked up one by one.
FEW = 32

#: Stands for a null id in a shard.
NO_ID = np.iinfo(np.int64).min

INDEX = "shard long, n long, length long, ids binary, lengths binary, terms binary, firsts binary, docs binary, counts binary, wide boolean"


#: A word of up to LETTERS bytes hashes to the sum of a random number for each place and byte; longer ones by word_hashes.
#: So many bytes are hashed at a time.
LETTERS, STEP = 64, 1 << 18
_NUMBERS = np.random.PCG64(7).random_raw(LETTERS * 256)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\f\v"))


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct terms, as sorted 64-bit hashes below 2**63, and their counts; null reads as the empty text."""
    texts = texts.fill_null("").cast(pa.large_binary())
    edge = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    data, blank = _LOWER[data], _BLANK[data]
    apart = np.zeros(len(data) + 1, bool)  # whether a byte and the one before it are of different texts
    apart[edge] = True
    begin = np.flatnonzero(~blank & (apart[:-1] | np.r_[True, blank[:-1]]))
    end = np.flatnonzero(~blank & (apart[1:] | np.r_[blank[1:], True])) + 1
    hashes, i = np.empty(len(begin), np.int64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + STEP)))
        own = slice(begin[i], min(end[j - 1], begin[i] + STEP + LETTERS))  # only words of more than LETTERS bytes can be cut
        place = np.arange(own.start, own.stop) - np.repeat(begin[i:j], np.diff(begin[i:j], append=own.stop))
        number = _NUMBERS[np.minimum(place, LETTERS - 1) * 256 + data[own]]
        number[blank[own]] = 0
        hashes[i:j] = np.add.reduceat(number, begin[i:j] - own.start) >> np.uint64(1)
        i = j
    long = np.flatnonzero(end - begin > LETTERS)
    if len(long):
        hashes[long] = word_hashes([data[b:e].tobytes() for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
    cut = np.searchsorted(begin, edge).tolist()
    return [np.unique(hashes[b:e], return_counts=True) for b, e in zip(cut[:-1], cut[1:], strict=True)]


def ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers in all [begin, end), one after another."""
    sizes = ends - begins
    total = int(sizes.sum())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def invert(shard: int, n: int, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple:
    """An index row of documents (id, terms, counts), in the order of their most frequent terms; n: all documents read for it,
    those without id or terms too."""
    docs = sorted(docs, key=lambda d: int(d[1][np.argmax(d[2])]))
    sizes = np.array([len(t) for _, t, _ in docs], dtype=np.int64)
    term = np.concatenate([t for _, t, _ in docs]) if docs else np.empty(0, np.int64)
    count = np.concatenate([c for _, _, c in docs]) if docs else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(term, kind="stable")
    term, count, doc = term[order], count[order], doc[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    wide = len(docs) > 1 << 16 or (len(count) > 0 and int(count.max()) >= 1 << 16)
    small = np.uint32 if wide else np.uint16
    lengths = np.array([c.sum() for _, _, c in docs], dtype=np.int64)
    ids = np.array([d for d, _, _ in docs], dtype=np.int64)
    arrays = (ids, lengths, term[first], np.r_[first, len(term)].astype(np.int64), doc.astype(small), count.astype(small))
    return (shard, n, *(a.tobytes() for a in arrays), wide)


class Asked:
    """A block of queries side by side: their entries (query, term, weight), terms as places in the vocabulary."""

    def __init__(self, own: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: np.ndarray):
        self.ids = np.array([i for i, _, _ in own], dtype=np.int64)
        self.of = np.repeat(np.arange(len(own)), [len(t) for _, t, _ in own])
        self.term = np.searchsorted(vocabulary, np.concatenate([t for _, t, _ in own]))
        self.weight = np.concatenate([c for _, _, c in own]).astype(np.float64)


class Shard:
    """An index row, as far as the terms of a query block go. Terms that a document in COMMON holds, or more, are common: their
    impacts are a matrix by document, with its maxima by block; the others are rare and keep their postings."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, average: float, row: dict):
        small = np.uint32 if row["wide"] else np.uint16
        self.ids, lengths, term, first = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "lengths", "terms", "firsts"))
        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        own = np.flatnonzero(vocabulary[at] == term)
        self.absent = np.flatnonzero(self.ids == NO_ID)  # counted, never found
        n, self.number = len(self.ids), np.full(len(vocabulary), -1)  # the numbers of the terms held, by place in the vocabulary
        self.number[at[own]] = np.arange(len(own))
        self.sizes = first[own + 1] - first[own]
        posting = ranges(first[own], first[own + 1])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.frombuffer(row["docs"], dtype=small)[posting].astype(np.int32)
        count = np.frombuffer(row["counts"], dtype=small)[posting].astype(np.float64)
        length = K1 * (1 - B + B * lengths.astype(np.float64) / average)
        self.impact = np.rint(np.repeat(idf[at[own]], self.sizes) * (count * (K1 + 1) / (count + length[self.doc])) * SCALE)
        self.most = np.maximum.reduceat(self.impact, self.first) if len(own) else np.empty(0)
        self.blocks = -(-n // RUN)
        self.width = self.blocks * RUN
        common = np.flatnonzero((self.sizes * COMMON >= self.width) & (self.most < 1 << 24))  # exact in single precision
        common = common[np.argsort(-self.sizes[common], kind="stable")[: CELLS // max(self.width, 1)]]
        self.column = np.full(len(own), -1)
        self.column[common] = np.arange(len(common))
        posting = ranges(self.first[common], self.first[common] + self.sizes[common])
        column = np.repeat(np.arange(len(common)), self.sizes[common])
        self.matrix = np.zeros((self.width, len(common)), np.float32)
        self.matrix[self.doc[posting], column] = self.impact[posting]
        self.table = self.matrix.reshape(self.blocks, RUN, len(common)).max(axis=1).T.astype(np.float64)
        self.held = np.bincount(column * self.blocks + self.doc[posting] // RUN, minlength=self.table.size).reshape(self.table.shape).astype(np.float64)
        # a sum of so many products in single precision is off by no more than this share, in any order
        self.slack = (len(common) + 8) * 2.0**-23

    def search(self, asked: Asked, floors: np.ndarray, scores: np.ndarray, found: np.ndarray) -> int:
        """Update the queries' best scores and ids, in place; returns how many postings were scored. No score below a query's
        floor is wanted."""
        floor = np.maximum(floors, scores[:, -1])
        at = self.number[asked.term]
        there = at >= 0
        at, of, weight = at[there], asked.of[there], asked.weight[there]
        # sums of integers below 2**53 are exact; equal scores may still win a tie
        most = np.bincount(of, weight * self.most[at], minlength=len(floor))
        live = (most > 0) & (most >= floor)
        queries = np.flatnonzero(live)
        there = live[of]
        at, of, weight = at[there], (np.cumsum(live) - 1)[of[there]], weight[there]
        rare = self.column[at] < 0
        work = np.cumsum(np.bincount(of[rare], self.sizes[at[rare]], minlength=len(queries)) + self.width)
        entry = np.searchsorted(of, np.arange(len(queries) + 1))
        begin, seen = 0, 0
        while begin < len(queries):
            end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + BATCH, side="right")))
            e = slice(entry[begin], entry[end])
            seen += self._some(queries[begin:end], at[e], of[e] - begin, weight[e], rare[e], floor, scores, found)
            begin = end
        return seen

    def _some(self, queries: np.ndarray, at: np.ndarray, of: np.ndarray, weight: np.ndarray, rare: np.ndarray, floor: np.ndarray, scores: np.ndarray, found: np.ndarray) -> int:
        n, k, least = len(queries), scores.shape[1], floor[queries]
        # the rare terms' postings
        first, sizes = self.first[at[rare]], self.sizes[at[rare]]
        posting = ranges(first, first + sizes)
        cell = np.repeat(of[rare] * self.width, sizes) + self.doc[posting]
        total = np.bincount(cell, np.repeat(weight[rare], sizes) * self.impact[posting], minlength=n * self.width).astype(np.float64, copy=False).reshape(n, self.width)
        total[:, self.absent] = 0
        # pivots are documents whose sum so far and their block's maxima of the common terms reach the floor
        of, column, weight = of[~rare], self.column[at[~rare]], weight[~rare]
        weights = np.zeros((n, self.matrix.shape[1]))
        weights[of, column] = weight
        left = weights @ self.table
        reach = (total.reshape(n, self.blocks, RUN) + left[:, :, None]).reshape(n, self.width)
        pivot = (reach >= least[:, None]) & (reach > 0)
        pivot[:, self.absent] = False
        pivots = np.count_nonzero(pivot.reshape(n, self.blocks, RUN), axis=2)
        # about what the common terms add to pivots: a few in a block are looked up, for more the block is multiplied out
        entry = np.searchsorted(of, np.arange(n + 1))
        about, single = np.zeros(total.shape, np.float32), weights.astype(np.float32)
        many = (pivots > RUN // FEW) & (left > 0)
        few = (pivots > 0) & ~many & (left > 0)
        q, d = np.divmod(np.flatnonzero(pivot.reshape(n, self.blocks, RUN) & few[:, :, None]), max(self.width, 1))
        about[q, d] = self._common(q, d, entry, column, weight)
        seen = len(posting) + int(np.diff(entry)[q].sum()) + int((((weights > 0).astype(np.float64) @ self.held) * many).sum())
        for b in np.flatnonzero(many.any(axis=0)):
            q, docs = np.flatnonzero(many[:, b]), slice(b * RUN, (b + 1) * RUN)
            about[q, docs] = (self.matrix[docs] @ single[q].T).T
        near = total + about
        pivot &= (near > 0) & (near >= (least * (1 - self.slack))[:, None])
        cell = np.flatnonzero(pivot)
        near, (q, d) = near.ravel()[cell], np.divmod(cell, max(self.width, 1))
        edge = np.searchsorted(q, np.arange(n + 1))
        wanted = np.ones(len(q), bool)
        for i in np.flatnonzero(np.diff(edge) > k):
            own = near[edge[i] : edge[i + 1]]
            wanted[edge[i] : edge[i + 1]] = own >= np.partition(own, -k)[-k] * (1 - 2 * self.slack)
        # exactly, for documents that are still in reach
        q, d = q[wanted], d[wanted]
        score = total[q, d] + self._common(q, d, entry, column, weight)
        edge = np.searchsorted(q, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(edge)):
            e = slice(edge[i], edge[i + 1])
            self._keep(d[e], score[e], least[i], scores[queries[i]], found[queries[i]])
        return seen

    def _common(self, q: np.ndarray, d: np.ndarray, entry: np.ndarray, column: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the common terms of the queries q add to the documents d, exactly; a query's terms begin at its entry."""
        sizes = entry[q + 1] - entry[q]
        out, step = np.zeros(len(q)), max(1, BATCH // max(1, int(sizes.max(initial=0))))
        for b in range(0, len(q), step):
            e, own = slice(b, b + step), sizes[b : b + step]
            at, of = ranges(entry[q[e]], entry[q[e] + 1]), np.repeat(np.arange(len(own)), own)
            out[e] = np.bincount(of, weight[at] * self.matrix[d[e][of], column[at]].astype(np.float64), minlength=len(own))
        return out

    def _keep(self, hit: np.ndarray, own: np.ndarray, floor: float, scores: np.ndarray, found: np.ndarray) -> None:
        """Let documents with their scores into the best, in place."""
        k = len(scores)
        if len(own) > k:
            floor = max(floor, np.partition(own, -k)[-k])
        good = own >= floor
        s, d = np.r_[scores, own[good].astype(np.int64)], np.r_[found, self.ids[hit[good]]]
        order = np.lexsort((d, -s))[:k]
        scores[:], found[:] = s[order], d[order]


def _vectors(rows: DataFrame) -> DataFrame:
    """(id, terms, counts, n) of rows (id, text); terms and counts as 64-bit integers in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                made = bags(batch.column("text"))
                cols = [pa.array([t.tobytes() for t, _ in made], pa.binary()), pa.array([c.astype(np.int64).tobytes() for _, c in made], pa.binary()), pa.array([len(t) for t, _ in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", "terms", "counts", "n"])

    return mapped(rows, run, "id long, terms binary, counts binary, n long")


def index(source: DataFrame) -> DataFrame:
    """One row (INDEX) per shard of rows (id, text), in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size, n, length = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size, n, length
            made = invert(shard, n, held)
            made = (*made[:2], length, *made[2:])
            shard, size, n, length = shard + 1, 0, 0, 0
            held.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

        for whole in batches:
            for batch in slices(whole, "text"):
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
                for d, t, (h, c) in zip(batch.column("id").to_pylist(), sizes, bags(batch.column("text")), strict=True):
                    n, size, length = n + 1, size + t, length + int(c.sum())
                    if len(h):
                        held.append((NO_ID if d is None else d, h, c))
                if size >= SHARD_BYTES:
                    yield flush()
        if n:
            yield flush()

    return cut(mapped(source, run, INDEX))


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", tally=None) -> DataFrame:
    """Rows (query_id, rank, id, score) of the k best docs for each row of queries (same columns as docs); ids are integers.

    tally: an accumulator that gets the number of postings scored."""
    spark = docs.sparkSession
    for frame in (docs, queries):
        if frame.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"ids must be integers: {id_col}")
    shards = index(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    asking = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    asked = cut(_vectors(asking.groupBy("id").agg(F.min("text").alias("text"))).where("n > 0"))
    entries = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, words, count = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    average = max(words, 1) / max(n, 1)
    share = max(SEEDS, 1.5 / max(count, 1))
    first = F.xxhash64("shard") / F.lit(2.0**64) + F.lit(0.5) < share
    blocks = max(1, -(-entries // BLOCK_TERMS))
    none = np.iinfo(np.int64).max
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()  # about BLOCK_TERMS entries
        if not part:
            continue
        own = [(r["id"], np.frombuffer(r["terms"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in part]
        vocabulary = np.unique(np.concatenate([t for _, t, _ in own]))
        known = spark.sparkContext.broadcast(vocabulary)

        def df_of(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            wanted = known.value
            seen = np.zeros(len(wanted), dtype=np.int64)
            for batch in batches:
                for t, f in zip(batch.column("terms").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                    t = np.frombuffer(t, dtype=np.int64)
                    at = np.minimum(np.searchsorted(wanted, t), len(wanted) - 1)
                    held = wanted[at] == t
                    seen[at[held]] += np.diff(np.frombuffer(f, dtype=np.int64))[held]
            held = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["term", "n"])

        sums = mapped(shards.select("terms", "firsts"), df_of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the block
        df = np.zeros(len(vocabulary))
        df[sums["term"].to_numpy()] = sums["n"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        asked_here = Asked(own, vocabulary)
        ask = spark.sparkContext.broadcast((vocabulary, idf, asked_here))

        def find(floors):
            def run(batches: Iterator[pa.RecordBatch], ask=ask) -> Iterator[pa.RecordBatch]:
                vocabulary, idf, asks = ask.value
                least = floors.value if floors is not None else np.zeros(len(asks.ids))
                scores = np.zeros((len(asks.ids), k), dtype=np.int64)
                found = np.full((len(asks.ids), k), none)
                seen = 0
                for batch in batches:
                    for at in range(batch.num_rows):
                        shard = Shard(vocabulary, idf, average, batch.slice(at, 1).to_pylist()[0])
                        seen += shard.search(asks, least, scores, found)
                if tally is not None:
                    tally.add(seen)
                q, r = np.nonzero(scores)
                yield pa.RecordBatch.from_arrays([pa.array(asks.ids[q]), pa.array(found[q, r]), pa.array(scores[q, r])], names=["query_id", "id", "s"])

            return run

        schema = "query_id long, id long, s long"
        seeds = cut(mapped(shards.where(first), find(None), schema))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))
        kth = {r["query_id"]: r["s"] for r in seeds.withColumn("r", rank).where(F.col("r") == k).collect()}  # a row per query of the block
        floors = spark.sparkContext.broadcast(np.array([kth.get(i, 0) for i in asked_here.ids.tolist()], dtype=np.float64))
        got = seeds.unionByName(mapped(shards.where(~first), find(floors), schema))
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), (F.col("s") / SCALE).alias("score"))


#: The same search in DuckDB, over documents, for ids divisible by 100.
SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS f FROM words WHERE t <> '' GROUP BY doc_id, t),
dl AS (SELECT doc_id, sum(f) AS l FROM tf GROUP BY doc_id),
df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(l) FROM dl) * 1.0 / (SELECT count(*) FROM documents) AS a),
impact AS (
  SELECT tf.doc_id, tf.t, cast(round(ln(1 + (n - d + 0.5) / (d + 0.5)) * (f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * l / a))) * {SCALE}) AS BIGINT) AS i
  FROM tf JOIN df ON tf.t = df.t JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN whole),
scored AS (
  SELECT q.doc_id AS query_id, x.doc_id AS doc_id, sum(q.f * x.i) AS s
  FROM tf q JOIN impact x ON q.t = x.t WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, x.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM scored WHERE s > 0)
SELECT query_id, cast(r AS INTEGER) AS rank, doc_id, cast(s AS DOUBLE) / {SCALE} AS score FROM ranked WHERE r <= {K}
"""

"""Near-duplicate documents by a chosen-path set similarity join.

Words are split at ASCII blanks after lower-casing A-Z; a document's set holds its distinct shingles of five words (a
shorter document's whole sequence is its one shingle). Two documents are linked if 100 * intersection >= 75 * union.

1. Documents with equal sets form a class (one row per class from here on); each class has EMBED minwise values.
2. TREES independent trees branch the classes: a node's children are keyed by the minwise value at positions that the
   tree and level choose, BRANCHES of them below the root. A node of LEAF classes or fewer is compared exhaustively.
3. Larger nodes are settled as far as one component goes, at the root and after the last level: a node is cut into blocks
   of BLOCK classes that each hold PIVOTS of its classes too, links inside the blocks are confirmed, and the classes that
   hang together with one pivot are one component. A node that is all one component is done: no link in it could join
   anything more. Where FEW classes or fewer stand outside, these meet every block and one another, which compares
   every pair that could matter (rows grow to three times the node's at most). Only nodes that are neither are branched, up to
   LEVELS times. So a great group of copies ends at the root.
4. In a node or block, one byte of each minwise value gives estimates that discard classes without any plausible partner
   (EMBED bytes a row; at similarity 0.75 a pair is lost with a probability under 1e-5). The full sets of the others
   are read again from their documents, and the links are confirmed on them by exact counting; a spanning forest of the
   links leaves the node.
5. What is still too large after the last level - unlike classes that share a value on every chosen level - is compared
   block by block, so nothing is capped.
6. Components come from min-label propagation, hooks among labels followed several steps a round, in the cluster.

Recall: a pair at similarity s stays together in a tree with probability s at the root and 1 - (1 - s) ** BRANCHES per
further level, for a level's positions are the same in all nodes of a tree. At 0.75 ten trees all miss it with probability
1e-6 at depth 1, 5e-6 at 2, 2.1e-5 at 3 and 6.6e-5 at 4; more similar pairs are lost far more rarely, and a component only
needs a spanning forest of its links. A pair that stays in large nodes to the last level is compared exactly there.

Defined results: a null, empty or blank text has an empty set, no links, and is its own component; repeated rows (equal
id and text) are one class and share a component; a null id is never the component of a class that has other ids; an
empty table gives an empty result; other columns are not read. Hashes have 64 bits (shingles, paths) and 128 bits (sets).

Skew: copies are pre-aggregated by their set's digest; paths are counted with partial sums before rows meet; a task
holds one node of LEAF rows at a time. What reaches the driver are counts only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups, mapped, slices, string_list, word_hashes

SHINGLE = 5
EMBED = 128
TREES, LEVELS, BRANCHES, LEAF = 10, 4, 2, 1024
#: Agreement of minwise values below which a pair is not looked at: 0.75 less 4.4 standard deviations.
PLAUSIBLE = 0.58
BLOCK, PIVOTS, FEW = 512, 4, 1024
#: Hooks that a round of the components follows beyond the first.
JUMPS = 2
#: Ids of documents whose sets are read again are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_seed = np.random.default_rng(20240229)
_MULTIPLY = _seed.integers(0, 1 << 63, EMBED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seed.integers(0, 1 << 63, EMBED, dtype=np.uint64)
_PLACE = _seed.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array(word_hashes(words), dtype=np.uint64)
    n = min(SHINGLE, len(h))
    rows = len(h) - n + 1
    total = np.full(rows, n, dtype=np.uint64)
    for k in range(n):
        total = mix(total + h[k : k + rows] * _PLACE[k])
    return np.unique(total)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise values, 32 bits each, of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), EMBED), dtype=np.uint32)
    for k in range(EMBED):
        x = flat * _MULTIPLY[k] + _ADD[k]
        out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32) ^ (x >> np.uint64(7)).astype(np.uint32), starts)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, row_id, n, digest, sig (binary: EMBED 32-bit minwise values) and low (a byte of each) of every row;
    empty sets have neither."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [shingles(t) for t in string_list(batch.column("text"))]
                full = [s for s in sets if len(s)]
                sigs = minwise(full) if full else np.empty((0, EMBED), dtype=np.uint32)
                made, low = iter(sigs), iter(sigs.astype(np.uint8))
                rows = np.arange(at, at + len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("text_key"), pa.array(rows), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()), pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "text_key", "row_id", "n", "digest", "sig", "low"],
                )

    return mapped(source, run, f"id {kind}, text_key long, row_id long, n long, digest binary, sig binary, low binary")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def value(position: int):
    """A minwise value of the binary column sig."""
    return F.substring("sig", 4 * position + 1, 4)


def positions(level: int) -> list[list[int]]:
    """The positions that each tree branches on at a level: one at the root, BRANCHES below."""
    rng = np.random.default_rng([level, 11])
    per = BRANCHES if level else 1
    order = np.concatenate([rng.permutation(EMBED) for _ in range(-(-TREES * per // EMBED))])
    return order[: TREES * per].reshape(TREES, per).tolist()


def node_rows(frame: DataFrame, tree: DataFrame, columns: list[str]) -> DataFrame:
    """tree (node, gid) with columns of frame by gid, rows of a node together and sorted."""
    wide = tree.join(frame.select("gid", *columns), "gid")
    return wide.repartition("node").sortWithinPartitions("node")


def plausible(classes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, gid) of leaves whose estimated similarity to another class of the node is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, gids = [], []
        for t in groups(batches, "node"):
            if t.num_rows < 2:
                continue
            low = np.frombuffer(b"".join(t["low"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, EMBED)
            n = np.asarray(t["n"], dtype=np.int64)
            near = np.zeros(t.num_rows, dtype=bool)
            for k in range(t.num_rows - 1):
                same = np.count_nonzero(low[k + 1 :] == low[k], axis=1) >= PLAUSIBLE * EMBED
                same &= 100 * np.minimum(n[k], n[k + 1 :]) >= 75 * np.maximum(n[k], n[k + 1 :])
                if same.any():
                    near[k] = True
                    near[k + 1 :] |= same
            if near.any():
                nodes += t["node"].to_pylist()[:1] * int(near.sum())
                gids += np.asarray(t["gid"])[near].tolist()
            if len(nodes) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(gids, pa.int64())], names=["node", "gid"])
                nodes, gids = [], []
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(gids, pa.int64())], names=["node", "gid"])

    return mapped(node_rows(classes, leaves, ["n", "low"]), run, "node long, gid long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections. Shingles of one set alone are in none, so only shared ones are counted, in slices
    that bound memory."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.r_[True, flat[1:] != flat[:-1]]
    shared = ~fresh | ~np.r_[fresh[1:], True]
    number, owner = (np.cumsum(fresh) - 1)[shared], owner[shared]
    out = np.diag(np.array([len(s) for s in sets], dtype=np.float64))
    if not len(number):
        return out
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1
    off = np.zeros((m, m))
    step = max(1 << 10, (1 << 22) // m)
    for a in range(0, int(number[-1]) + 1, step):
        lo, hi = np.searchsorted(number, [a, a + step])
        dense = np.zeros((m, min(step, int(number[hi - 1]) - a + 1)), dtype=np.float32)
        dense[owner[lo:hi], number[lo:hi] - a] = 1
        off += dense @ dense.T
    np.fill_diagonal(off, 0)
    return out + off


def spanning(linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of a symmetric link matrix, and the root of each row's tree."""
    m, seen, out, tree = len(linked), np.zeros(len(linked), dtype=bool), [], np.arange(len(linked))
    for root in range(m):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            k = stack.pop()
            new = np.flatnonzero(linked[k] & ~seen)
            seen[new] = True
            tree[new] = root
            out += [(k, x) for x in new.tolist()]
            stack += new.tolist()
    return out, tree


def confirmed(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, node): links between classes of a node, confirmed on full sets - a spanning forest of each node's links, node
    null - and, where nodes (node, gid, pivot) name pivots, for each class a that hangs together with some in its node the
    least of them, b."""
    named = "pivot" in nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, where = [], [], []
        for t in groups(batches, "node"):
            if t.num_rows < 2:
                continue
            own = [np.frombuffer(x, dtype=np.uint64) for x in t["hashes"].to_pylist()]
            sizes = np.array([len(s) for s in own], dtype=np.float64)
            both = common_counts(own)
            found, tree = spanning(100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both))
            gids = t["gid"].to_pylist()
            a += [gids[x] for x, _ in found]
            b += [gids[y] for _, y in found]
            where += [None] * len(found)
            if named:
                least: dict[int, int] = {}
                for root, gid, pivot in zip(tree.tolist(), gids, t["pivot"].to_pylist(), strict=True):
                    if pivot:
                        least[root] = min(gid, least.get(root, gid))
                held = [(gid, least[root]) for root, gid in zip(tree.tolist(), gids, strict=True) if root in least]
                a += [x for x, _ in held]
                b += [y for _, y in held]
                where += [t["node"][0].as_py()] * len(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(where, pa.int64())], names=["a", "b", "node"])

    return mapped(node_rows(sets, nodes, ["hashes"]), run, "a long, b long, node long")


def read_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gid, hashes) of the wanted classes (gid, digest, id), from their documents."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = wanted.select(F.col("id").alias("wid")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    source = source.join(ids, F.expr("id <=> wid"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [shingles(t) for t in string_list(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "hashes"])

    found = mapped(source.select("text"), run, "digest binary, hashes binary")
    return found.join(wanted.select("gid", "digest"), "digest").dropDuplicates(["digest", "gid"]).select("gid", "hashes")


def components(links: DataFrame) -> DataFrame:
    """(gid, label): the least class reachable by links (a, b), for every class that has a link."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("gid")).distinct().withColumn("label", F.col("gid")))
    while True:
        # the least label on either side of a link goes to both classes and to the classes that their labels name
        seen = edges.join(labels.select(F.col("gid").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("gid").alias("b"), F.col("label").alias("lb")), "b")
        hooks = cut(seen.where("la <> lb").select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")).groupBy("label").agg(F.min("to").alias("to")))
        if hooks.isEmpty():
            return labels
        # hooks go down only; following them twice doubles the reach of a round
        far = labels.join(hooks, "label", "left").select("gid", F.coalesce("to", "label").alias("label"))
        for _ in range(JUMPS):
            far = far.join(hooks, "label", "left").select("gid", F.coalesce("to", "label").alias("label"))
        labels = cut(far)


def compared(docs: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What confirmed gives for all pairs of classes that share a node (node, gid, and pivot where there are any)."""
    active = cut(plausible(classes, nodes))
    wanted = cut(active.select("gid").distinct().join(classes.select("gid", "digest", "id"), "gid"))
    sets = cut(read_sets(docs, wanted, id_col, text_col))
    return cut(confirmed(sets, active.join(nodes, ["node", "gid"]) if "pivot" in nodes.columns else active))


def block():
    """The block of a class in a node of c classes."""
    return F.pmod(F.xxhash64("gid", F.lit(5)), F.ceil(F.col("c") / BLOCK).cast("long"))


def settle(docs: DataFrame, classes: DataFrame, large: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found in large nodes (node, gid, tree, c), and the rows of nodes that are not settled by them."""
    rows = cut(large.withColumn("block", block()).withColumn("sub", F.xxhash64("node", "block")))
    # pivots are least by as many hashes; counted before rows meet
    pivots = rows.groupBy("node").agg(F.array_distinct(F.array(*(F.min_by("gid", F.xxhash64("gid", F.lit(50 + k))) for k in range(PIVOTS)))).alias("gid"))
    held = cut(rows.select("sub", "node").distinct().join(pivots, "node").select(F.col("sub").alias("node"), F.explode("gid").alias("gid"), F.lit(True).alias("pivot")))
    plain = rows.select(F.col("sub").alias("node"), "gid").join(held, ["node", "gid"], "left_anti").withColumn("pivot", F.lit(False))
    found = compared(docs, classes, cut(held.unionByName(plain)), id_col, text_col)
    links = found.where("node is null").select("a", "b")

    # of each node, the pivot that most classes hang together with, and how many do not
    anchors = found.where("node is not null").select(F.col("node").alias("sub"), F.col("a").alias("gid"), F.col("b").alias("anchor"))
    named = cut(rows.join(anchors, ["sub", "gid"], "left"))
    parts = named.where("anchor is not null").groupBy("node", "anchor").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("node").agg(F.max(F.struct("m", "anchor")).alias("top")).select("node", F.col("top.anchor").alias("main"), F.col("top.m").alias("m"))
    state = cut(named.select("node", "c").distinct().join(main, "node", "left").withColumn("others", F.col("c") - F.coalesce("m", F.lit(0))).where("others > 0"))
    if state.isEmpty():
        return links, large.limit(0)
    rest = cut(named.join(state.select("node", "main", "others"), "node"))
    few = rest.where(F.col("others") <= FEW)
    if not few.isEmpty():
        inside = F.col("anchor").eqNullSafe(F.col("main"))
        blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / BLOCK).cast("long") - 1)
        met = few.where(inside).select("sub", "gid").unionByName(few.where(~inside).select("node", "gid", F.explode(blocks).alias("block")).select(F.xxhash64("node", "block").alias("sub"), "gid"))
        links = links.unionByName(compared(docs, classes, cut(met.withColumnRenamed("sub", "node")), id_col, text_col).select("a", "b"))
    return cut(links), cut(rest.where(F.col("others") > FEW).select("node", "gid", "tree", "c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id, kept, and for joins back text_key (xxhash64 of the text)
    and label, which tells components apart that one id names (null for a text without words)."""
    rows = cut(sketch(docs, id_col, text_col))
    classes = cut(
        rows.where("n > 0").groupBy("digest").agg(F.min("row_id").alias("gid"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    )

    # the trees, level by level; only rows of large nodes that could not be settled go on
    leaves, large, links = None, None, None
    for level in range(LEVELS):
        chosen = positions(level)
        if level == 0:
            each = [F.xxhash64(F.lit(t), value(p[0])).alias("node") for t, p in enumerate(chosen)]
            paths = classes.select("gid", F.posexplode(F.array(*each)).alias("tree", "node"))
        else:
            wide = large.join(classes.select("gid", "sig"), "gid")
            each = F.array(*(F.array(*(F.xxhash64("node", F.lit(100 + b), value(x)) for b, x in enumerate(p))) for p in chosen))
            paths = wide.select("gid", "tree", F.explode(F.get(each, F.col("tree"))).alias("node")).select("gid", "tree", "node")
            paths = cut(paths)
        sizes = cut(paths.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
        here = cut(paths.join(sizes, "node").select("node", "gid", "tree", "c"))
        small = here.where(F.col("c") <= LEAF).select("node", "gid")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = here.where(F.col("c") > LEAF)
        if not large.isEmpty() and level in (0, LEVELS - 1):
            found, large = settle(docs, classes, large, id_col, text_col)
            links = found if links is None else links.unionByName(found)
        if large.isEmpty():
            large = None
            break
    found = compared(docs, classes, leaves, id_col, text_col).select("a", "b")
    links = found if links is None else cut(links.unionByName(found))

    if large is not None:
        last = F.ceil(F.col("c") / BLOCK).cast("long") - 1
        pairs = large.withColumn("block", block()).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        pairs = cut(pairs.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "gid"))
        links = cut(links.unionByName(compared(docs, classes, pairs, id_col, text_col).select("a", "b")))

    labels = components(links)
    of_class = cut(classes.select("digest", "gid", "id").join(labels, "gid", "left").withColumn("label", F.coalesce("label", "gid")))
    least = cut(of_class.groupBy("label").agg(F.min("id").alias("component_id")))
    lead = of_class.join(least, "label").select("digest", "component_id", "label")
    out = rows.select("id", "text_key", "row_id", "n", "digest").join(lead, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), "text_key", "label")

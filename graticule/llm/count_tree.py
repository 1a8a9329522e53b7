r"""N-gram Jaccard join over an index of count vectors.

Shingles are hashed into groups; a document's group counts are a point, and the overlap of two documents is
at most the sum of their coordinate minima.  The index has the levels of a tree:

1. size interval: sets that can reach the similarity differ in size by at most its inverse;
2. block of groups: with I the smallest overlap that links sizes a and b, linked sets differ in at most
   t = a + b - 2 I shingles, so of more than t blocks at least one has equal counts in both, for any
   assignment of shingles to groups;
3. leaf: the documents whose point is the same in all (fine) groups of the block, named by a hash of it.

A linked pair therefore shares a leaf, and only leaves with different documents give candidates.  Wide
bounding boxes would not do: among vectors of many coordinates the box of a few dozen points bounds the overlap
by nearly the whole set and nothing is pruned, so a leaf's box is a single point of its block.  Candidates are
then bounded by the summed minima of a coarse vector over all groups, and survivors are verified on the
shingles themselves.

A block that a document has no shingle in tells nothing.  An interval has ``spare`` blocks beyond t + 1, so
empty leaves can be left out by documents that have at most ``spare`` of them; the few others post them too.
No linked pair is missed: equal blocks of a pair number more than ``spare``, so if all were empty both
documents would have more than ``spare`` empty blocks and post them.

Groups of copies: equal sets are one node from the first scan on.  Near copies meet their leaf's smallest node
first, so a group is linked along stars instead of all its pairs.  Afterwards only leaves that still hold several
components are searched: boxes around the components first, then the points of boxes that can reach the
overlap.  Documents connected by such reach meet and are compared on their shingles, which gives links between
parts not yet joined: pairs never leave a task.  Many documents are compared in tiles.

Defined cases: null text, text without words: n_shingles 0, linked with nothing; fewer words than a shingle
has: the whole sequence is the one shingle; equal sets always link; rows that repeat a doc_id are documents
of their own; a null doc_id names no component as long as another member has an id; other columns are ignored;
an empty table gives no rows.  Nodes are 64-bit digests of sets.
"""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.batches import pieces
from graticule.llm.ordering import same
from graticule.llm.shingles import digest, mixed, shingles
from graticule.operators.graph import connected_components
from graticule.plans.lineage import cut

GROUPS = 64  # coordinates of the coarse vector
STEP = 1.35  # ratio of a size interval
POSTED = 1e-3  # wanted share of documents that post their empty leaves
TILE = 1024  # documents of a leaf compared in one task
GRAMS = 1 << 19  # shingles of a leaf compared in one task
MEETING = 4 * TILE  # documents within reach of each other that meet once instead of in each of their leaves
COPIED = 1_000_000  # up to this many ids of wanted documents are copied to all tasks


class Similarity:
    """Jaccard similarity ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def largest(self, n: int) -> int:
        """Largest set that can link with one of n shingles."""
        return n * self.den // self.num

    def differing(self, a: int, b: int) -> int:
        """Most shingles that linked sets of these sizes can differ in."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def intervals(self, upto: int) -> list[tuple[int, int, int, int]]:
        """(smallest, largest member, blocks, spare) per interval of the smaller set's size, up to size ``upto``."""
        low = next(n for n in range(1, 10 * self.den) if self.differing(n, self.largest(n)) > 0)  # below, only equal sets link
        out = []
        while low <= upto:
            high = max(low, int(low * STEP))
            t = self.differing(high, self.largest(high))
            spare = min(range(t + 4), key=lambda x: (max(POSTED, _more_empty(low, t + 1 + x, x)), x))
            out.append((low, self.largest(high), t + 1 + spare, spare))
            low = high + 1
        return out


@functools.lru_cache(maxsize=1 << 16)
def _more_empty(shingles: int, blocks: int, spare: int) -> float:
    """Chance of more than ``spare`` empty blocks, taking their number for Poisson."""
    mean = blocks * math.exp(-shingles / blocks)
    term = total = math.exp(-mean)
    for x in range(1, spare + 1):
        term *= mean / x
        total += term
    return max(0.0, 1 - total)


def leaves(grams: np.ndarray, intervals: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Names of the leaves that hold this set."""
    n, out = len(grams), []
    for k, (low, high, blocks, spare) in enumerate(intervals):
        if not low <= n <= high:
            continue
        h = mixed(grams + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(block, minlength=blocks)
        # h is a shingle's fine group; a block's point is named by the sums over its groups
        lo = np.bincount(block, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), blocks).astype(np.uint64)
        hi = np.bincount(block, (h >> np.uint64(32)).astype(np.float64), blocks).astype(np.uint64)
        name = mixed(mixed(lo + np.uint64(k)) + mixed(hi ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(3) + np.arange(blocks, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        full = held > 0
        out.append(name if blocks - int(full.sum()) > spare else name[full])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def coarse(grams: np.ndarray) -> np.ndarray:
    """The point of a set: GROUPS counts, and four or sixteen times as many for long texts."""
    groups = GROUPS if len(grams) < 512 else 4 * GROUPS if len(grams) < 4096 else 16 * GROUPS
    return np.bincount((mixed(grams) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same counts over fewer groups: remainders of a power of two nest."""
    return point.reshape(-1, groups).sum(axis=0)


def _strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_key() -> Column:
    return F.xxhash64("text")


def members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key (tells texts of one doc_id apart), n_shingles, node (null without shingles)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(t, k) for t in _strings(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), b.column(b.schema.get_field_index("text_key")), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "text_key", "n_shingles", "node"])

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(scan, "doc_id long, text_key long, n_shingles long, node long")


def postings(docs: DataFrame, k: int, similarity: Similarity) -> DataFrame:
    """leaf, node.  A task posts a node once, so copies do not fill a leaf."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[int, int, int, int]] = []
        seen: set[int] = set()
        for b in pieces(batches):
            leaf, node = [], []
            for t in _strings(b, "text"):
                s = shingles(t, k)
                d = digest(s) if len(s) else None
                if d is None or d in seen:
                    continue
                seen.add(d)
                if not known or known[-1][0] <= len(s):
                    known = similarity.intervals(2 * len(s) + 64)
                names = leaves(s, known)
                leaf.append(names)
                node.append(np.full(len(names), d, np.int64))
            if leaf:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaf).astype(np.int64)), pa.array(np.concatenate(node))], names=["leaf", "node"])

    return docs.select("text").mapInArrow(scan, "leaf long, node long")


def shared_leaves(posted: DataFrame) -> DataFrame:
    """leaf, node, first: the nodes of each leaf behind its smallest one.  Leaves of one node vanish.

    Rows are sorted within partitions and read as a stream, so no leaf is ever held together.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf0 = first0 = last0 = None
        for b in batches:
            leaf, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(leaf):
                continue
            opens = np.empty(len(leaf), bool)
            opens[0], opens[1:] = leaf[0] != leaf0, leaf[1:] != leaf[:-1]
            at = np.maximum.accumulate(np.where(opens, np.arange(len(leaf)), -1))
            first = np.where(at >= 0, node[np.maximum(at, 0)], node[0] if first0 is None else first0)
            again = np.empty(len(leaf), bool)
            again[0], again[1:] = (not opens[0]) and node[0] == last0, ~opens[1:] & (node[1:] == node[:-1])
            keep = (node != first) & ~again
            leaf0, first0, last0 = leaf[-1], first[-1], node[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(node[keep]), pa.array(first[keep])], names=["leaf", "node", "first"])

    return posted.repartition("leaf").sortWithinPartitions("leaf", "node").mapInArrow(scan, "leaf long, node long, first long")


def _of_wanted(docs: DataFrame, wanted: DataFrame, k: int, column: str, kind: str, value) -> DataFrame:
    """node and ``value`` of its shingles, for one document per wanted node (doc_id).  A task gives a node once.

    A null doc_id names no single document: if one is wanted, all texts without an id are read, where they lie.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches):
            nodes, values = [], []
            for s in (shingles(t, k) for t in _strings(b, "text")):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    nodes.append(d)
                    values.append(value(s))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["node", column])

    wanted = cut(wanted)  # ids only; beyond the bound the texts are shuffled to them instead
    named = wanted.where("doc_id IS NOT NULL")
    texts = docs.select("doc_id", "text").join(F.broadcast(named) if named.count() <= COPIED else named, "doc_id", "left_semi")
    if not wanted.where("doc_id IS NULL").limit(1).isEmpty():
        texts = texts.unionByName(docs.select("doc_id", "text").where("doc_id IS NULL AND text IS NOT NULL"))
    found = cut(texts.mapInArrow(scan, f"node long, {column} array<long>")).withColumn(column, F.col(column).cast(kind))
    # only rows that repeat a doc_id can bring a node twice
    return found if found.count() == found.select("node").distinct().count() else cut(found.dropDuplicates(["node"]))


def points_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, counts: the points of the wanted documents."""
    return _of_wanted(docs, wanted, k, "counts", "array<int>", lambda s: coarse(s).astype(np.int64))


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{x}_{c}" if c != "node" else x) for c in df.columns])


def near(pairs: DataFrame, points: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) that the summed minima of their points let link; a point's sum is the size of its set."""
    num, den = similarity.num, similarity.den
    total = lambda c: F.aggregate(c, F.lit(0), lambda t, v: t + v)
    # over GROUPS coordinates for either length: every GROUPS-th count is folded onto the same group
    fold = lambda c: F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.aggregate(F.sequence(F.lit(0), F.size(c) - GROUPS, F.lit(GROUPS)), F.lit(0), lambda t, j: t + F.get(c, j + g)))
    points = points.select("node", F.when(F.size("counts") == GROUPS, F.col("counts")).otherwise(fold(F.col("counts"))).alias("counts"), total(F.col("counts")).alias("n"))
    minima = total(F.zip_with("a_counts", "b_counts", lambda x, y: F.least(x, y)))
    return pairs.join(_side(points, "a"), "a").join(_side(points, "b"), "b").where((num + den) * minima >= num * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, k: int, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) that link by their shingles; only texts of these pairs are read for it.  ``ids``: node, doc_id."""
    num, den = similarity.num, similarity.den
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    grams = _of_wanted(docs, ids.join(nodes, "node", "left_semi").select("doc_id"), k, "grams", "array<long>", lambda s: s.astype(np.int64))
    both = pairs.join(_side(grams, "a"), "a").join(_side(grams, "b"), "b")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    return both.select("a", "b", shared.alias("s"), (F.size("a_grams") + F.size("b_grams")).alias("u")).where(den * F.col("s") >= num * (F.col("u") - F.col("s"))).select("a", "b")


def _boxes(order: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    return np.split(order, np.flatnonzero(np.diff(group[order])) + 1)


def search(node: np.ndarray, component: np.ndarray, size: np.ndarray, points: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Pairs (2 x n) that connect all rows of different components that the summed minima of their points let link; fewer than the rows.

    Boxes first: the largest counts of a component bound what any of its points shares with another's.  The
    points of all boxes within reach are then compared at once.
    """
    num, den = similarity.num, similarity.den
    boxes = _boxes(np.argsort(component, kind="stable"), component)
    top = np.array([points[b].max(axis=0) for b in boxes])
    least = np.array([size[b].min() for b in boxes])
    root, out = np.arange(len(node)), []
    for x in range(len(boxes) - 1):
        reach = (num + den) * np.minimum(top[x], top[x + 1:]).sum(axis=1) >= num * (least[x] + least[x + 1:])
        if not reach.any():
            continue
        others = np.concatenate([boxes[y] for y in np.flatnonzero(reach) + x + 1])
        for i in boxes[x]:
            apart = others[root[others] != root[i]]
            near = apart[(num + den) * np.minimum(points[i], points[apart]).sum(axis=1) >= num * (size[i] + size[apart])]
            out += _united(root, i, near)
    return node[np.array(out, np.int64).reshape(-1, 2).T]


def _united(root: np.ndarray, i: int, linked: np.ndarray) -> list[tuple[int, int]]:
    """Unite row i with rows of other roots; one pair for each of these roots."""
    others, first = np.unique(root[linked], return_index=True)
    if len(others):
        root[np.isin(root, others)] = root[i]
    return [(i, j) for j in linked[first]]


def spanning(node: np.ndarray, component: np.ndarray, offsets: np.ndarray, values: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Links (2 x n, smaller node first) that join the components of these rows as all their links do; the shingles of row i are ``values[offsets[i]: offsets[i + 1]]``."""
    num, den = similarity.num, similarity.den
    code = np.unique(values[offsets[0]: offsets[-1]], return_inverse=True)[1]
    ends, size, root = offsets - offsets[0], np.diff(offsets).astype(np.int64), component.copy()
    held, out = np.zeros(len(code), bool), []
    for i in range(len(node) - 1):
        own = code[ends[i]: ends[i + 1]]
        held[own] = True
        shared = np.add.reduceat(held[code[ends[i + 1]:]], ends[i + 1: -1] - ends[i + 1], dtype=np.int64)
        held[own] = False
        out += _united(root, i, np.flatnonzero((root[i + 1:] != root[i]) & (den * shared >= num * (size[i] + size[i + 1:] - shared))) + i + 1)
    return np.sort(node[np.array(out, np.int64).reshape(-1, 2).T], axis=0)


def _leaf_by_leaf(rows: DataFrame, tiles: Column, arrays: DataFrame, found, schema: str) -> DataFrame:
    """What ``found`` gives for the rows (leaf, node, ...) of a leaf, or of any two tiles of one that has several, with their ``arrays`` (node, array)."""
    columns = [*rows.columns, arrays.columns[1]]
    tiles = rows.groupBy("leaf").agg(F.ceil(tiles).cast("int").alias("tiles"))
    dealt = rows.join(tiles, "leaf").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(arrays, "node")
    dealt = dealt.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *columns)

    def of_groups(b: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        columns = [b.column(k).to_numpy() for k in range(2, b.num_columns - 1)]
        offsets, values = b.column(b.num_columns - 1).offsets.to_numpy(), b.column(b.num_columns - 1).values.to_numpy()
        out, start = [], 0
        for end in ends:
            if end - start > 1:
                out.append(found(*(c[start:end] for c in columns), offsets[start: end + 1], values))
            start = end
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out] or [np.empty(0, np.int64)])) for k in range(len(names))], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last key of earlier batches
        for b in batches:
            b = pa.concat_batches([held, b]) if held is not None else b
            if not b.num_rows:
                continue
            p, q, leaf = (b.column(k).to_numpy() for k in range(3))
            ends = (np.flatnonzero((leaf[1:] != leaf[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist()
            held = b.slice(ends[-1]) if ends else b
            yield of_groups(b, ends)
        if held is not None:
            yield of_groups(held, [held.num_rows])

    return dealt.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q").mapInArrow(scan, schema)


def candidates(at: DataFrame, points: DataFrame, similarity: Similarity) -> DataFrame:
    """leaf, a, b: connects the nodes of a leaf that lie in different components and may link; with the component and size of either node."""

    def found(leaf: np.ndarray, node: np.ndarray, c: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
        groups = int(np.diff(offsets).min())
        counts = np.array([folded(values[x:y], groups) for x, y in zip(offsets[:-1], offsets[1:])])
        n = counts.sum(axis=1).astype(np.int64)
        a, b = search(np.arange(len(node)), c, n, counts, similarity)
        return leaf[a], node[a], node[b], c[a], c[b], n[a], n[b]

    return _leaf_by_leaf(at, F.count(F.lit(1)) / TILE, points.select("node", "counts"), found, "leaf long, a long, b long, a_c long, b_c long, a_n long, b_n long")


def joining(pairs: DataFrame, docs: DataFrame, ids: DataFrame, k: int, similarity: Similarity) -> DataFrame:
    """Links (a, b) that join the components of all nodes connected by ``pairs`` (of ``candidates``) as all links among them do.

    Connected nodes meet once, whatever the number of leaves they share, unless they are too many: those meet
    leaf by leaf.  Few nodes all meet at once.  They are compared on their shingles where they meet, and only
    links between parts not yet joined are given: fewer than the rows, however many pairs are near.  ``ids``: node, doc_id.
    """
    pairs = cut(pairs)
    side = lambda x: F.struct(F.col(x).alias("node"), F.col(f"{x}_c").alias("c"), F.col(f"{x}_n").alias("n"))
    nodes = cut(pairs.select("leaf", F.explode(F.array(side("a"), side("b"))).alias("s")).select("leaf", "s.*").distinct())
    once = cut(nodes.select("node", "c", "n").distinct())
    if once.limit(MEETING + 1).count() <= MEETING:
        rows = once.select(F.lit(0).cast("long").alias("leaf"), "node", "c", "n")
    else:
        told = connected_components(pairs.select("a", "b"))
        many = told.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MEETING).select("component")
        few = told.join(many, "component", "left_anti").select(F.col("component").alias("leaf"), "node")
        rows = few.join(once, "node").select("leaf", "node", "c", "n").unionByName(nodes.join(few.select("node"), "node", "left_anti"))
    grams = _of_wanted(docs, ids.join(once.select("node"), "node", "left_semi").select("doc_id"), k, "grams", "array<long>", lambda s: s.astype(np.int64))

    def found(leaf: np.ndarray, node: np.ndarray, c: np.ndarray, n: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return spanning(node, c, offsets, values, similarity)

    tiles = F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / GRAMS)
    return _leaf_by_leaf(rows, tiles, grams, found, "a long, b long")


def _open(posted: DataFrame, label: DataFrame) -> DataFrame:
    """leaf, node, c of the leaves that still hold several components.

    Two nodes of a leaf have met in the star already; leaves that hold the same nodes are kept once.
    """
    at = posted.join(label, "node", "left").select("leaf", "node", F.coalesce("component", "node").alias("c"))
    content = [F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.min("c").alias("x"), F.max("c").alias("y")]
    leaves_ = at.groupBy("leaf").agg(*content).where("x <> y AND m > 2").groupBy("m", "s").agg(F.min("leaf").alias("leaf")).select("leaf")
    return at.join(leaves_, "leaf", "left_semi")


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key, n_shingles, node) and, per node, its smallest doc_id and its component."""
    similarity = Similarity(num, den)
    found = cut(members(docs, k))
    shared = cut(shared_leaves(postings(docs, k, similarity)))
    posted = shared.select("leaf", "node").unionByName(shared.select("leaf", F.col("first").alias("node")).distinct())
    wanted = posted.select("node").distinct()
    ids = cut(found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    points = points_of(docs, ids.join(wanted, "node", "left_semi").select("doc_id"), k)

    stars = shared.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(verified(near(stars, points, similarity), docs, ids, k, similarity))
    at = cut(_open(posted, connected_components(links)))
    more = joining(candidates(at, points, similarity), docs, ids, k, similarity)
    whole = connected_components(links.unionByName(cut(more)))

    return found, ids.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))


def components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: classes of documents reachable by links of similarity num/den."""
    found, nodes = classes(docs, k, num, den)
    names = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(names, "component").select(F.col("node").alias("_node"), "component_id")
    return found.join(named, same(F.col("node"), F.col("_node")), "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the smallest doc_id stays (null last), of texts under one
    doc_id that with the smaller hash, of equal rows (doc_id, text) one.  Rows without shingles are no duplicates of others."""
    found, nodes = classes(docs, k, num, den)
    at = found.join(nodes.select("node", "component"), "node")
    first = at.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    kept = first.unionByName(found.where("node IS NULL").select("doc_id", "text_key")).select(F.col("doc_id").alias("_kept_doc_id"), F.col("text_key").alias("_kept_text_key")).distinct()
    return docs.join(kept, same(F.col("doc_id"), F.col("_kept_doc_id")) & (text_key() == F.col("_kept_text_key")), "left_semi").dropDuplicates(["doc_id", "text"])

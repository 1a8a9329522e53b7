"""Extremely randomised trees of all designs and held-out folds, grown together level by level.

A tree belongs to a design (columns of the inputs) and a fold; it learns from the rows of all other folds, so a fold is a
mask and nothing is refitted.  Every node draws one cut per column of its design, uniform between the least and the
greatest value that its rows have there, and takes the cut that explains most weighted variance while both sides keep
``least`` rows; ties go to the first column.  A node that cannot be cut, or whose best cut explains nothing, is a leaf.

One level is two narrow jobs.  In the first, tasks hand on the bounds per (tree, node, column), reducers draw the cuts from
a keyed hash of (seed, tree, node, column); in the second, tasks hand on counts and sums on the left of every cut, reducers
choose.  Tasks find the node of a row by walking the trees, so no state lies beside the rows and a lost task is simply run
again.  Partial results leave a task as one packed row per block of trees; deep levels take their trees in groups, so that
neither a task nor a reducer holds more than CELLS numbers.  The forest itself (NODES at most) travels to the tasks.

Rows whose inputs, target, fold or weight are NULL or not finite, or whose weight is not positive, take no part in growing;
rows with such inputs or fold get a NULL prediction.  Without training rows a tree is a leaf that predicts NULL.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graticule.operators.fitted import LEAF, model_table
from graticule.plans.lineage import shared

BLOCK = 64  # trees of one packed row
CELLS = 1 << 22  # numbers held at once by a task
NODES = 1 << 24  # nodes of one forest
FOLDS = 1000
GAIN = 1e-12  # share of the explained sum of squares that a cut has to add


@dataclass
class Forest:
    """Trees in heap order: the children of node i are 2 i + 1 (value at most the cut) and 2 i + 2."""

    x: list[str]
    designs: dict[str, list[int]]
    folds: list
    trees: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def owner(self, tree: int) -> tuple[str, object]:
        """Design and held-out fold of a tree."""
        lot = tree // self.trees
        return list(self.designs)[lot // len(self.folds)], self.folds[lot % len(self.folds)]

    def lots(self) -> list[tuple[str, int, range]]:
        """(design, position of the fold, trees) of all lots."""
        n = len(self.folds)
        return [(d, k, range((i * n + k) * self.trees, (i * n + k + 1) * self.trees)) for i, d in enumerate(self.designs) for k in range(n)]

    def models(self, spark: SparkSession, fold: str, kind: str) -> DataFrame:
        """Rows of a model table (``operators.fitted``) with the held-out fold beside them."""
        return model_table(spark, [{"model": d, "kind": "trees", "intercept": 0.0, "trees": [self.exported(t) for t in lot], fold: self.folds[k]} for d, k, lot in self.lots()], f", {fold} {kind}")

    def exported(self, tree: int) -> list[tuple]:
        """Nodes of one tree from its root, children by position."""
        nodes, todo = [], [0]
        at = {0: 0}
        while todo:
            i = todo.pop(0)
            f = int(self.feature[tree, i])
            if f == LEAF:
                nodes.append((LEAF, 0.0, 0, 0, float(self.value[tree, i])))
                continue
            for child in (2 * i + 1, 2 * i + 2):
                at[child] = len(at)
                todo.append(child)
            nodes.append((f, float(self.cut[tree, i]), at[2 * i + 1], at[2 * i + 2], float(self.value[tree, i])))
        return nodes


def walked(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row of ``x`` (columns x rows) in one tree after ``levels`` levels."""
    n, flat = x.shape[1], x.ravel()
    rows = np.arange(n)
    at = np.maximum(feature, 0).astype(np.int64) * n
    cut = np.where(feature == LEAF, np.nan, cut)
    down = np.where(feature == LEAF, 0, np.arange(len(feature)) + 1)  # a leaf keeps its rows
    node = np.zeros(n, np.int64)
    for _ in range(levels):
        node = node + down[node] + (flat[at[node] + rows] > cut[node])
    return node


def mixed64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def drawn(seed: int, tree: np.ndarray, node: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) keyed by (seed, tree, node, column)."""
    key = np.array([seed], np.uint64)
    h = mixed64(key + mixed64(tree.astype(np.uint64) + np.uint64(1)))
    h = mixed64(mixed64(h + node.astype(np.uint64)) + column.astype(np.uint64))
    return (h >> np.uint64(11)).astype(float) * 2.0 ** -53


def _packed(blocks: Iterator[tuple[int, np.ndarray]], part: int) -> pa.RecordBatch:
    rows = list(blocks)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["block", "part", "v"])


def _blocks(v: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(0, len(v), BLOCK):
        yield (first + k) // BLOCK, v[k: k + BLOCK]


PACKED = "block int, part int, v binary"


def _reduced(parts: DataFrame, merge, shape: tuple, finish, schema: str) -> DataFrame:
    """Merge the packed rows of each block in the order of their tasks, read as a stream; then ``finish(block, merged)``."""

    def scan(batches):
        block, held = None, None
        for b in batches:
            for at, v in zip(b.column(0).to_pylist(), b.column(2)):
                one = np.frombuffer(v.as_buffer(), float).reshape(-1, *shape)
                if at != block:
                    if block is not None:
                        yield finish(block, held)
                    block, held = at, one.copy()
                else:
                    merge(held, one, out=held)
        if block is not None:
            yield finish(block, held)

    return parts.repartition("block").sortWithinPartitions("block", "part").mapInArrow(scan, schema)


def _columns(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (columns x rows), target, weight and position of the fold."""
    c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(width + 3)]
    return np.array(c[:width], float).reshape(width, b.num_rows), c[width], c[width + 1], c[width + 2]


def _finite(names: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ok


def _place(fold: str, folds: list) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in folds]), F.col(fold)).cast("int") - 1


def grow(df: DataFrame, x: Sequence[str], y: str, fold: str, designs: Mapping[str, Sequence[str]], trees: int, depth: int, least: int, seed: int, weight: Column | None = None) -> Forest:
    """``trees`` trees of at most ``depth`` levels for every design (name -> columns) and held-out value of ``fold``."""
    x = list(x)
    folds = [r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().orderBy(fold).limit(FOLDS + 1).collect()]
    if len(folds) > FOLDS:
        raise ValueError(f"more than {FOLDS} folds")
    named = {d: [x.index(c) for c in cs] for d, cs in designs.items()}
    many, width = len(named) * len(folds) * trees, max(map(len, named.values()))
    size = (1 << depth + 1) - 1
    if many * size > NODES:
        raise ValueError(f"the forest would have more than {NODES} nodes")
    forest = Forest(x, named, folds, trees, np.full((many, size), LEAF, np.int16), np.zeros((many, size)), np.full((many, size), np.nan))
    if not many:
        return forest
    rows = df.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(x)], F.col(y).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("_w"), _place(fold, folds).alias("_f"))
    rows = shared(rows.where(_finite([*[f"_x{k}" for k in range(len(x))], "_y", "_w"]) & (F.col("_w") > 0) & F.col("_f").isNotNull()))
    centre = rows.agg(F.avg("_y")).first()[0] or 0.0
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a few rows already mean much work: they pass all trees
        rows = shared(rows.repartition(cores))
    columns = [(named[d], k) for d, k, lot in forest.lots() for _ in lot]  # of every tree: its inputs, its held-out fold
    open_ = np.zeros((many, size), bool)
    open_[:, 0] = True
    for level in range(depth + 1):
        begin, slots = (1 << level) - 1, 1 << level
        group = max(CELLS // (slots * (1 + width) * 3) // BLOCK, 1) * BLOCK
        for a in range(0, many, group):
            z = min(a + group, many)
            if open_[a:z, begin: begin + slots].any():
                _level(spark, rows, forest, columns, open_, a, z, level, least, seed, width, centre, last=level == depth)
    forest.value += centre
    rows.unpersist()
    return forest


def _level(spark, rows, forest, columns, open_, a, z, level, least, seed, width, centre, last) -> None:
    """Cut the open nodes of one level in trees a to z; their totals become the values."""
    begin, slots, n_x = (1 << level) - 1, 1 << level, len(forest.x)
    sent = spark.sparkContext.broadcast((forest.feature[a:z], forest.cut[a:z], open_[a:z, begin: begin + slots], columns[a:z]))

    def at_nodes(b):
        """Per tree of the group its inputs, the rows it learns from, their order by each column and their open nodes (from 1)."""
        feature, cut, opened, cols = sent.value
        v, y, w, f = _columns(b, n_x)
        kept = {}
        for t in range(len(feature)):
            inputs, held = cols[t]
            if not opened[t].any():
                continue
            if held not in kept:
                here = f != held
                order = np.argsort(v[:, here], axis=1, kind="stable")
                kept[held] = v[:, here], y[here] - centre, w[here], order, np.take_along_axis(v[:, here], order, axis=1)
            xs, ys, ws, order, sorted_ = kept[held]
            slot = walked(feature[t], cut[t], xs, level) - begin + 1
            place = np.concatenate([[0], np.where(opened[t], np.arange(1, slots + 1), 0)])  # 0: in no open node
            yield t, inputs, xs, ys, ws, order, sorted_, place[np.maximum(slot, 0)]

    def bounds(batches):
        low = np.full((z - a, slots, width, 2), np.inf)  # least value, and the greatest with its sign turned
        for b in batches:
            for t, inputs, _, _, _, order, sorted_, slot in at_nodes(b):
                for j, c in enumerate(inputs):
                    s, own = slot[order[c]], np.full((slots + 1, 2), np.inf)
                    own[s[::-1], 0] = sorted_[c][::-1]
                    own[s, 1] = -sorted_[c]
                    np.minimum(low[t, :, j], own[1:], out=low[t, :, j])
        yield _packed(_blocks(low, a), TaskContext.get().partitionId())

    def draw(block, low):
        n = len(low)
        tree, node, col = np.ogrid[block * BLOCK: block * BLOCK + n, begin: begin + slots, 0:width]
        lo, hi = low[..., 0], -low[..., 1]
        with np.errstate(invalid="ignore"):
            at = lo + drawn(seed, tree, node, col) * (hi - lo)
            at = np.where(hi > lo, np.where(at < hi, at, lo), np.nan)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.tobytes()], pa.binary())], names=["block", "v"])

    at = np.full((z - a, slots, width), np.nan)
    if not last:
        drawn_cuts = _reduced(rows.mapInArrow(bounds, PACKED), np.minimum, (slots, width, 2), draw, "block int, v binary")
        for block, v in drawn_cuts.toLocalIterator():
            at[block * BLOCK - a: block * BLOCK - a + BLOCK] = np.frombuffer(v, float).reshape(-1, slots, width)
    cuts = spark.sparkContext.broadcast(at)

    def sums(batches):
        held = np.zeros((z - a, slots, 1 + width, 3))  # count, weight, weighted target: of the node, then left of every cut
        tried = cuts.value
        for b in batches:
            for t, inputs, xs, y, w, _, _, slot in at_nodes(b):
                wy = w * y
                held[t, :, 0] += np.stack([np.bincount(slot, v, slots + 1)[1:] for v in (None, w, wy)], axis=1)
                for j, c in enumerate(inputs):
                    left = np.flatnonzero(xs[c] <= np.concatenate([[np.nan], tried[t, :, j]])[slot])
                    s = slot[left]
                    held[t, :, 1 + j] += np.stack([np.bincount(s, v, slots + 1)[1:] for v in (None, w[left], wy[left])], axis=1)
        yield _packed(_blocks(held, a), TaskContext.get().partitionId())

    def choose(block, held):
        n, w, s = (held[..., k] for k in range(3))
        total = [v[..., :1] for v in (n, w, s)]
        left = [v[..., 1:] for v in (n, w, s)]
        right = [t - v for t, v in zip(total, left)]
        with np.errstate(invalid="ignore", divide="ignore"):
            whole = total[2] ** 2 / total[1]
            told = left[2] ** 2 / left[1] + right[2] ** 2 / right[1]
            fits = (left[0] >= least) & (right[0] >= least) & (told > whole + GAIN * np.maximum(told, whole))
            pick = np.where(fits, told, -np.inf).argmax(axis=-1)
            value = (total[2] / total[1])[..., 0]
        some = fits.any(axis=-1)
        out = np.stack([np.where(some, pick, -1), value, n[..., 0]], axis=-1)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "v"])

    chosen = _reduced(rows.mapInArrow(sums, PACKED), np.add, (slots, 1 + width, 3), choose, "block int, v binary")
    here = slice(begin, begin + slots)
    for block, v in chosen.toLocalIterator():
        out = np.frombuffer(v, float).reshape(-1, slots, 3)
        for k, (pick, value, n) in enumerate(np.moveaxis(out, 2, 1)):
            t = block * BLOCK + k
            opened = open_[t, here] & (n > 0)
            forest.value[t, here] = np.where(opened, value, forest.value[t, here])
            cut_here = np.flatnonzero(opened & (pick >= 0))
            inputs = np.array(columns[t][0], np.int16)
            forest.feature[t, begin + cut_here] = inputs[pick[cut_here].astype(int)]
            forest.cut[t, begin + cut_here] = at[t - a, cut_here, pick[cut_here].astype(int)]
            for side in (1, 2):
                if not last:
                    open_[t, 2 * (begin + cut_here) + side] = True
    sent.unpersist()
    cuts.unpersist()


def held_out(df: DataFrame, forest: Forest, fold: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, design, predicted: mean over the trees that did not see the row's fold."""
    sent = df.sparkSession.sparkContext.broadcast((forest.feature, forest.cut, forest.value, forest.lots()))
    n_x, levels = len(forest.x), int(np.log2(forest.feature.shape[1] + 1)) - 1
    names = [f"_x{k}" for k in range(n_x)]
    rows = df.select(*keep, *[F.col(c).cast("double").alias(n) for n, c in zip(names, forest.x)], _place(fold, forest.folds).alias("_f") if forest.folds else F.lit(None).cast("int").alias("_f"))
    schema = ", ".join(f"`{c}` {k}" for c, k in df.select(*keep).dtypes) + ", design string, predicted double"

    def scan(batches):
        feature, cut, value, lots = sent.value
        for b in batches:
            kept = pa.RecordBatch.from_arrays(b.columns[:len(keep)], names=list(keep))
            v = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keep): len(keep) + n_x]], float).reshape(n_x, b.num_rows)
            f = b.column(len(keep) + n_x).to_numpy(zero_copy_only=False).astype(float)
            ok = np.isfinite(v).all(axis=0)
            told: dict = {}
            for design, k, lot in lots:
                out = told.setdefault(design, np.full(b.num_rows, np.nan))
                at = np.flatnonzero(ok & (f == k))
                if len(at):
                    xs = v[:, at]
                    out[at] = sum((value[t][walked(feature[t], cut[t], xs, levels)] for t in lot), np.zeros(len(at))) / len(lot)
            for design, out in told.items():
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([design] * b.num_rows, pa.string()), pa.array(out, pa.float64(), from_pandas=True)], names=[*keep, "design", "predicted"])

    return rows.mapInArrow(scan, schema)

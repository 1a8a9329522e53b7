"""Permutation tests whose replicates are computed, not sorted.

A keyed bijection of 0 .. n - 1 gives every replicate its own permutation: row i takes the value of row
``partner(i)``.  It is a Feistel network on the digits of i to the base a = ceil(sqrt(n)), six rounds with keys from the
digest of (seed, replicate, round); results of n or more are sent through again (cycle walking; a * a exceeds n by about two in
sqrt(n)).  Nothing is shuffled or ordered by replicate: a batch of rows against a block of replicates is one matrix.

Values behind the partner's index come from a count table: rows are indexed in the order of their value, so the
value of an index is found among the running totals of the distinct values.  Scores and classes have few distinct
values; the table is broadcast behind a count, and values with more distinct ones raise (``resampling.permuted`` joins them).
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graticule.operators.resampling import indexed
from graticule.plans import order_stats as O

ROUNDS = 6
MULTIPLIERS = (0x7FEB352D, 0x4F6CDD1D)  # below 2**31, so products of 32 bits stay exact in a signed long
BLOCK = 256  # replicates of one matrix
ROWS = 2048  # rows of one matrix
TABLE = 1_000_000  # distinct values of a broadcast count table (16 bytes each)


def round_keys(seed, first: int, last: int) -> np.ndarray:
    """(replicates, rounds) keys of 32 bits."""
    return np.array([[int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16) for k in range(ROUNDS)] for rep in range(first, last)], np.uint64)


def partners(index: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(rows, replicates) partner of every index below its n, for every row of round keys."""
    mask = np.uint64(0xFFFFFFFF)

    def once(v, a, keyed):
        left, right = v // a, v % a
        for k in range(ROUNDS):
            h = right ^ keyed[..., k]
            for m, s in zip(MULTIPLIERS, (15, 13)):
                h = (h * np.uint64(m)) & mask
                h ^= h >> np.uint64(s)
            moved = left + ((h * a) >> np.uint64(32))
            left, right = right, np.where(moved >= a, moved - a, moved)
        return left * a + right

    n = n.astype(np.uint64)
    a = np.ceil(np.sqrt(n.astype(float))).astype(np.uint64)
    a += (a * a < n).astype(np.uint64)
    out = once(index.astype(np.uint64)[:, None], a[:, None], keys[None, :, :])
    while True:
        row, rep = np.nonzero(out >= n[:, None])
        if not len(row):
            return out.astype(np.int64)
        out[row, rep] = once(out[row, rep], a[row], keys[rep])


def count_table(df: DataFrame, block: str, value: str, limit: int = TABLE) -> tuple[dict, dict, dict]:
    """Per block: first indices, values in order, and size.  Distinct values are counted before they are fetched."""
    table = O.running_totals(O.value_counts(df.select(block, value), [block], value), [block], value)
    rows = table.select(block, value, "_before", "_total").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values; use resampling.permuted")
    rows = rows.sort_values([block, "_before"])
    starts = {k: g["_before"].to_numpy(np.int64) for k, g in rows.groupby(block)}
    values = {k: g[value].to_numpy() for k, g in rows.groupby(block)}
    sizes = {k: int(g["_total"].iloc[0]) for k, g in rows.groupby(block)}
    return starts, values, sizes


def null_sums(rows: DataFrame, reps: int, seed, columns: Sequence[str], term: Callable[[pd.DataFrame, Callable], list[np.ndarray]]) -> DataFrame:
    """(rep, columns): sums over all rows of ``term``, for every replicate.

    ``term(rows, partner)`` returns one array of shape (columns of the block,) per output, summed over the rows given;
    ``partner(index, n)`` is the matrix of partners for the block of replicates at hand.  A task adds up its rows and hands
    on one number per replicate and output.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(columns), reps))
        keys = None
        for pdf in batches:
            keys = round_keys(seed, 0, reps) if keys is None else keys
            for start in range(0, len(pdf), ROWS):
                part = pdf.iloc[start: start + ROWS]
                for r in range(0, reps, BLOCK):
                    block = keys[r: r + BLOCK]
                    for k, s in enumerate(term(part, lambda i, n: partners(np.asarray(i), np.asarray(n), block))):
                        total[k, r: r + BLOCK] += s
        if keys is not None:
            yield pd.DataFrame({"rep": np.arange(reps), **{c: total[k] for k, c in enumerate(columns)}})

    sums = rows.mapInPandas(run, "rep long, " + ", ".join(f"{c} double" for c in columns))
    return sums.groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: replicates multiply the work of a row, not its size."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def pieces(ranges: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Index ranges [a, b) cut into [start, stop) of at most ``ROWS`` indices, so a long range is no task's alone."""
    step = F.lit(ROWS).cast("long")
    cut = ranges.select(*keep, "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1, step)).alias("start"))
    return cut.select(*keep, "start", F.least(F.col("start") + step, F.col("b")).alias("stop"))


def positions(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, key, index, n): 0-based place of a unique numeric key in its block."""
    r = O.running_totals(df.select(*by, key).withColumn("_n", F.lit(1).cast("long")), by, key)
    return r.select(*by, key, F.col("_before").cast("long").alias("index"), F.col("_total").cast("long").alias("n"))


def block_correlation(df: DataFrame, block: str, key: str, x: str, y: str, reps: int, seed) -> DataFrame:
    """(rep, stat): correlation of y with x when x is reassigned inside each block."""
    starts, values, _ = count_table(df, block, x)
    rows = spread(positions(df, [block], key).join(df.select(block, key, F.col(y).cast("double").alias("y")), [block, key]).select(block, "index", "n", "y"))
    shared = df.sparkSession.sparkContext.broadcast((starts, values))

    def term(part, partner):
        first, of = shared.value
        moved = partner(part["index"], part["n"])
        out = np.zeros(moved.shape[1])
        for b, at in part.groupby(block).indices.items():
            taken = of[b][np.searchsorted(first[b], moved[at], side="right") - 1].astype(float)
            out += part["y"].to_numpy()[at] @ taken
        return [out]

    m = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")).select(F.struct("*").alias("m")).scalar()
    return null_sums(rows, reps, seed, ["xy"], term).withColumn("_m", m).select("rep", ((F.col("xy") / F.col("_m.n") - F.col("_m.mx") * F.col("_m.my")) / (F.col("_m.sx") * F.col("_m.sy"))).alias("stat"))


def rank_auroc(df: DataFrame, score: str, positive: Column, reps: int, seed) -> DataFrame:
    """(rep, stat): area under the ROC curve when the labels are reassigned; row i is positive if its partner is among the first P."""
    table = O.running_totals(O.value_counts(df, [], score), [], score)
    runs = table.select(F.col("_before").cast("long").alias("a"), F.col("_upto").cast("long").alias("b"), F.col("_total").cast("long").alias("n"), (F.col("_before") + (F.col("_n") + 1) / 2).cast("double").alias("rank"))
    n_positive = df.where(F.col(score).isNotNull()).agg(F.count_if(positive).cast("long").alias("p")).scalar()
    rows = spread(pieces(runs, ["n", "rank"]).withColumn("p", n_positive))

    def term(part, partner):
        size = (part["stop"] - part["start"]).to_numpy()
        owner = np.repeat(np.arange(len(part)), size)
        index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(part["start"].to_numpy(), size)
        n, p, rank = (part[c].to_numpy() for c in ("n", "p", "rank"))
        out = 0.0
        for k in range(0, len(index), ROWS):
            who = owner[k: k + ROWS]
            out = out + rank[who] @ (partner(index[k: k + ROWS], n[who]) < p[who][:, None])
        return [out]

    sums = null_sums(rows, reps, seed, ["ranks"], term)
    sizes = df.where(F.col(score).isNotNull()).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("q")).select(F.struct("p", "q").alias("s")).scalar()
    return sums.withColumn("_s", sizes).select("rep", ((F.col("ranks") - F.col("_s.p") * (F.col("_s.p") + 1) / 2) / (F.col("_s.p") * F.col("_s.q"))).alias("stat"))


def class_counts(df: DataFrame, group: str, klass: str, classes: Sequence[str], reps: int, seed) -> DataFrame:
    """(group, rep, c0, c1, ...): rows of each class in each group when classes are reassigned over all rows.

    Only two count tables are read: groups and classes occupy ranges of indices.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(klass))
    sizes = df.groupBy(order.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k > 0").toPandas().set_index("k")["n"]  # one row per class
    cuts = np.cumsum([0] + [int(sizes.get(k + 1, 0)) for k in range(len(classes))])
    # groups in digest order: each holds a range of indices
    groups = df.where(order > 0).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = indexed(groups, group)
    ranges = O.running_totals(placed.select("_i", "_n"), [], "_i").join(placed.select("_i", group), "_i").select(group, F.col("_before").cast("long").alias("a"), F.col("_upto").cast("long").alias("b"), F.col("_total").cast("long").alias("n"))
    parts = spread(pieces(ranges, [group, "n"]))
    n_classes, kind = len(classes), dict(df.select(group).dtypes)[group]
    names = [f"c{k}" for k in range(n_classes)]

    def run(batches):
        held, keys = {}, None
        for pdf in batches:
            keys = round_keys(seed, 0, reps) if keys is None else keys
            for g, n, start, stop in zip(pdf[group], pdf["n"], pdf["start"], pdf["stop"]):
                total = held.setdefault(g, np.zeros((n_classes, reps), np.int64))
                index = np.arange(start, stop)
                for r in range(0, reps, BLOCK):
                    moved = partners(index, np.full(len(index), n), keys[r: r + BLOCK])
                    below = np.stack([(moved < c).sum(axis=0) for c in cuts])
                    total[:, r: r + BLOCK] += np.diff(below, axis=0)
                if len(held) > 64:  # groups are unbounded, what a task holds is not
                    yield from (pd.DataFrame({group: k, "rep": np.arange(reps), **dict(zip(names, v))}) for k, v in held.items())
                    held = {}
        for k, v in held.items():
            yield pd.DataFrame({group: k, "rep": np.arange(reps), **dict(zip(names, v))})

    counted = parts.mapInPandas(run, f"{group} {kind}, rep long, " + ", ".join(f"{c} long" for c in names))
    return counted.groupBy(group, "rep").agg(*[F.sum(c).alias(c) for c in names])


LEVELS = 10_000  # distinct factor values of a logistic model


def newton_slopes(hits: np.ndarray, n: np.ndarray, x: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Unpenalised logistic slope of every row of ``hits`` (successes per level of x, out of n); NaN where it does not settle."""
    mean = (n @ x) / n.sum()
    scale = np.sqrt((n @ (x - mean) ** 2) / n.sum()) or 1.0
    u = (x - mean) / scale
    total = hits.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        b0, b1 = np.log(total / (n.sum() - total)), np.zeros(len(hits))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(b0[:, None] + b1[:, None] * u)))
            off, w = hits - n * p, n * p * (1 - p)
            g0, g1 = off.sum(axis=1), off @ u
            h00, h01, h11 = w.sum(axis=1), w @ u, w @ (u * u)
            det = h00 * h11 - h01 * h01
            d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            b0, b1 = b0 + d0, b1 + d1
            if not (np.maximum(np.abs(d0), np.abs(d1)) > 1e-12).any():
                break
        return np.where(np.isfinite(b1) & (np.abs(d1) < 1e-6), b1 / scale, np.nan)


def logistic_null(df: DataFrame, x: str, hit: Column, block: str, reps: int, seed) -> DataFrame:
    """(rep, slope): logistic slope of ``hit`` on x, rep -1 as observed, the others with x reassigned inside each block.

    The rows of a block that are hits hold its first indices, the levels of x ranges of indices; a replicate is the table of
    hits per level, and Newton steps run for many replicates at once on these tables.  Rows without x, hit or block take no part.
    """
    rows = df.select(F.col(block).alias("b"), F.col(x).cast("double").alias("x"), hit.cast("boolean").alias("hit")).where("b IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND hit IS NOT NULL")
    counts = rows.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k"))
    levels = counts.groupBy("x").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).orderBy("x").limit(LEVELS + 1).toPandas()
    if len(levels) > LEVELS:
        raise ValueError(f"more than {LEVELS} distinct factor values")
    value, n, seen = (levels[c].to_numpy(float) for c in ("x", "n", "k"))
    starts, values, sizes = count_table(rows, "b", "x")
    place = {b: np.searchsorted(value, v) for b, v in values.items()}
    ranges = counts.groupBy("b").agg(F.lit(0).cast("long").alias("a"), F.sum("k").alias("b1"), F.sum("n").alias("n")).where("b1 > 0").select(F.col("b").alias("block"), "a", F.col("b1").alias("b"), "n")
    shared = df.sparkSession.sparkContext.broadcast((starts, place))

    def run(batches):
        first, of = shared.value
        total, keys = np.zeros((reps, len(value)), np.int64), None
        for pdf in batches:
            keys = round_keys(seed, 0, reps) if keys is None else keys
            for b, size, start, stop in zip(pdf["block"], pdf["n"], pdf["start"], pdf["stop"]):
                index = np.arange(start, stop)
                for r in range(0, reps, BLOCK):
                    moved = partners(index, np.full(len(index), size), keys[r: r + BLOCK])
                    level = of[b][np.searchsorted(first[b], moved, side="right") - 1]
                    m = moved.shape[1]
                    total[r: r + m] += np.bincount((level + np.arange(m) * len(value)).ravel(), minlength=m * len(value)).reshape(m, -1)
        if keys is not None:
            yield pd.DataFrame({"rep": np.arange(reps), "hits": list(total)})

    parts = spread(pieces(ranges, ["block", "n"])).mapInPandas(run, "rep long, hits array<long>")
    # one array per task and replicate; added up level by level
    tables = parts.select("rep", F.posexplode("hits").alias("at", "k")).groupBy("rep", "at").agg(F.sum("k").alias("k")).groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "k"))), lambda e: e["k"]).alias("hits"))
    observed = df.sparkSession.createDataFrame([(-1, [int(k) for k in seen])], "rep long, hits array<long>")

    def slopes(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"rep": pdf["rep"], "slope": newton_slopes(np.stack(pdf["hits"].to_numpy()).astype(float), n, value)})

    return tables.unionByName(observed).mapInPandas(slopes, "rep long, slope double")


def moran_null(values: DataFrame, weights: DataFrame, key: str, z: str, reps: int, seed) -> DataFrame:
    """(rep, stat): Moran's I when values are reassigned over all nodes; edges are the rows, the graph stays."""
    one = values.withColumn("_all", F.lit(0))
    starts, of, sizes = count_table(one, "_all", z)
    if not sizes:
        return values.sparkSession.createDataFrame([], "rep long, stat double")
    first, level = starts[0], of[0].astype(float)
    n = np.diff(np.append(first, sizes[0]))
    centred = level - (level @ n) / n.sum()
    den = float((centred * centred) @ n)
    place = positions(values, [], key)
    edges = weights.join(place.select(F.col(key).alias("src"), F.col("index").alias("i"), "n"), "src").join(place.select(F.col(key).alias("dst"), F.col("index").alias("j")), "dst")
    shared = values.sparkSession.sparkContext.broadcast((first, centred))

    def term(part, partner):
        at, zc = shared.value
        taken = lambda c: zc[np.searchsorted(at, partner(part[c], part["n"]), side="right") - 1]
        return [part["w"].to_numpy() @ (taken("i") * taken("j"))]

    return null_sums(spread(edges.select("i", "j", "n", "w")), reps, seed, ["num"], term).select("rep", (F.col("num") / max(den, 1e-300)).alias("stat"))


def duck_partners(rows: str, seed, reps: int) -> str:
    """DuckDB CTEs ending in ``bij(rep, g, i, v)``: the partner v of every index i of ``rows(g, i, n)``; the twin of ``partners``."""
    names = ", ".join(f"k{k}" for k in range(ROUNDS))
    keys = ", ".join(f"CAST('0x' || substr(md5('{seed}|' || rep || '|{k}'), 1, 8) AS BIGINT) AS k{k}" for k in range(ROUNDS))
    same = f"rep, g, i, n, a, {names}"

    def step(source: str) -> str:
        out = f"SELECT {same}, v // a AS l, v % a AS r FROM ({source})"
        for k in range(ROUNDS):
            out = f"SELECT {same}, l, r, xor(r, k{k}) AS h FROM ({out})"
            for m, shift in zip(MULTIPLIERS, (15, 13)):
                out = f"SELECT {same}, l, r, xor((h * {m}) & 4294967295, ((h * {m}) & 4294967295) >> {shift}) AS h FROM ({out})"
            out = f"SELECT {same}, r AS l, (l + ((h * a) >> 32)) % a AS r FROM ({out})"
        return f"SELECT {same}, l * a + r AS v FROM ({out})"

    start = f"SELECT kb.*, g, i, i AS v, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM {rows}, kb"
    return f"kb AS (SELECT rep, {keys} FROM range({reps}) AS t(rep)), walk AS ({step(start)} UNION ALL {step('SELECT * FROM walk WHERE v >= n')}), bij AS (SELECT rep, g, i, v FROM walk WHERE v < n)"

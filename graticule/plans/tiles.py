"""All-pairs work in bounded tiles.

Rows are hashed into blocks of at most about ``BLOCK_ROWS`` rows (``BLOCKS`` blocks for smaller tables); every unordered pair of
blocks is one tile, so a row travels once per block, not once per few hundred rows.  A task works through its tile in matrices
of ``TILE_ROWS`` rows a side and emits only a reduction (nearest rows, counts, pairs under a threshold), so pairs are never
written out and memory is bounded by two blocks and one matrix.  Where only the values of a pair matter, equal rows are one row
with their number.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from graticule.plans.lineage import cut

TILE_ROWS = 1024
BLOCK_ROWS = 32768
BLOCKS = 16
STRIP = 64  # rows of distances worked out at once
HELD = 1 << 20  # rows of results a tile holds before it merges them
TARGET_LIMIT = 20000
EXACT = 1e-6  # squared distances this small next to the rows' squared lengths are taken from differences


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of one tile each from batches sorted by tile."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for _, g in pdf.groupby(["_a", "_b"], sort=False):
            if held and (held[0]["_a"].iloc[0], held[0]["_b"].iloc[0]) != (g["_a"].iloc[0], g["_b"].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(g)
    if held:
        yield pd.concat(held, ignore_index=True)


def scan(df: DataFrame, key: str, columns: Sequence[str], reduce: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Run ``reduce(left, right, mask)`` on every matrix of every tile; mask marks each unordered pair exactly once.

    ``left is right`` on the diagonal.  ``merge`` reduces the results of several matrices of a tile to fewer rows.
    """
    n = df.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(-(-n // TILE_ROWS), BLOCKS))
    rows = df.select(key, *columns).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    spread = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.withColumns({"_a": F.least("_block", "_other"), "_b": F.greatest("_block", "_other")}).drop("_other")

    def matrices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = int(pdf["_a"].iloc[0]), int(pdf["_b"].iloc[0])
        pdf = pdf.sort_values(key, kind="stable")
        parts = {k: [g.iloc[i: i + TILE_ROWS].reset_index(drop=True) for i in range(0, len(g), TILE_ROWS)] for k, g in ((k, pdf[pdf["_block"] == k]) for k in {a, b})}
        for i, left in enumerate(parts[a]):
            if a == b:
                yield reduce(left, left, np.triu(np.ones((len(left), len(left)), dtype=bool), 1))
            for right in parts[b][i + 1:] if a == b else parts[b]:
                yield reduce(left, right, np.ones((len(left), len(right)), dtype=bool))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(batches):
            held, size = [], 0
            for out in matrices(pdf):
                if merge is None:
                    yield out
                    continue
                held.append(out)
                size += len(out)
                if size > HELD:
                    held = [merge(pd.concat(held, ignore_index=True))]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield held.pop()
                        size = 0
            if held:
                yield merge(pd.concat(held, ignore_index=True))

    tiles = blocks * (blocks + 1) // 2
    return spread.repartition(min(tiles, 4096), "_a", "_b").sortWithinPartitions("_a", "_b").mapInPandas(run, schema)


def weighed(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Equal rows once: their columns, smallest key and number ``_w``."""
    return cut(df.groupBy(*columns).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_w")))


def pair_weights(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray | None:
    """Pairs of rows behind each pair of weighed rows, those of equal rows on the diagonal; None where all are 1."""
    x, y = left["_w"].to_numpy(float), right["_w"].to_numpy(float)
    if left is right:
        w = np.triu(np.outer(x, x), 1)
        np.fill_diagonal(w, x * (x - 1) / 2)
        return w
    return None if (x == 1).all() and (y == 1).all() else np.outer(x, y)


def matrix(pdf: pd.DataFrame, column: str, dims: slice = slice(None)) -> np.ndarray:
    """Vectors of a frame as rows; stacked once per frame."""
    if not len(pdf):
        return np.zeros((0, 0))
    held = getattr(pdf, "_stacked", None)
    if held is None:
        held = {}
        object.__setattr__(pdf, "_stacked", held)
    if column not in held:
        held[column] = np.stack([np.asarray(v, dtype=float) for v in pdf[column]])
    return held[column][:, dims]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances from inner products, tiny ones from differences; a few rows at a time, which stay near the processor."""
    sq = np.empty((len(x), len(y)))
    if not sq.size:
        return sq
    a, b = (x * x).sum(1), (y * y).sum(1)
    limit = EXACT * (a.max() + b.max())
    twice, other = -2.0 * x, np.ascontiguousarray(y.T)
    for s in range(0, len(x), STRIP):
        part = sq[s: s + STRIP]
        np.dot(twice[s: s + STRIP], other, out=part)
        part += a[s: s + STRIP, None]
        part += b
        if not part.min() >= limit:
            row, column = np.nonzero(part < limit)
            row += s
            for k in range(0, len(row), 1 << 16):
                r, c = row[k: k + (1 << 16)], column[k: k + (1 << 16)]
                sq[r, c] = ((x[r] - y[c]) ** 2).sum(1)
        np.sqrt(part, out=part)
    return sq


def _bucket(values: np.ndarray) -> np.ndarray:
    """Order-preserving coarse code of non-negative doubles (exponent and 14 mantissa bits)."""
    return (values.astype(np.float64) + 0.0).view(np.int64) >> 38


def _measured(measure: Callable, left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
    found = measure(left, right)
    return found if isinstance(found, list) else [found]


def _kept(g, w: np.ndarray | None, *arrays: np.ndarray) -> tuple:
    """Groups, weights and values of the pairs that count."""
    if np.isscalar(g):
        if g < 0:
            return (np.zeros(0, np.int64), None, *[a.ravel()[:0] for a in arrays])
        keep = None if w is None else w > 0
        if keep is None or keep.all():
            return (int(g), None if w is None else w.ravel(), *[a.ravel() for a in arrays])
        return (int(g), w[keep], *[a[keep] for a in arrays])
    at = np.flatnonzero(g >= 0 if w is None else (g >= 0) & (w > 0))  # mostly few
    return (g.ravel()[at].astype(np.int64), None if w is None else w.ravel()[at], *[a.ravel()[at] for a in arrays])


def _groups(g) -> np.ndarray:
    """Distinct groups; one number stands for itself."""
    if np.isscalar(g):
        return np.array([g])
    return np.flatnonzero(np.bincount(g)) if len(g) and g.max() < 1 << 16 else np.unique(g)


def _tally(g, codes: np.ndarray, w: np.ndarray | None) -> pd.DataFrame:
    """(grp, bucket, n) of pairs with these groups and codes."""
    if not len(codes):
        return pd.DataFrame({"grp": np.zeros(0, np.int64), "bucket": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    out = []
    for grp in _groups(g):
        mine = slice(None) if np.isscalar(g) else g == grp
        c, v = codes[mine], None if w is None else w[mine]
        low = c.min()
        if low == 0 and c.max() > 0:  # zeros lie far from all other codes
            at = c == 0
            out.append(pd.DataFrame({"grp": [grp], "bucket": [0], "n": [int(at.sum() if v is None else v[at].sum())]}))
            c, v = c[~at], None if v is None else v[~at]
            low = c.min()
        if c.max() - low < 1 << 22:
            n = np.bincount(c - low, v)
            at = np.flatnonzero(n)
            out.append(pd.DataFrame({"grp": grp, "bucket": at + low, "n": n[at].astype(np.int64)}))
        else:
            at, place = np.unique(c, return_inverse=True)
            out.append(pd.DataFrame({"grp": grp, "bucket": at, "n": np.bincount(place, v).astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def _edge(bucket: int) -> float:
    """Smallest value of a bucket."""
    return float((np.array([bucket], np.int64) << 38).view(np.float64)[0])


def _histogram(measure: Callable, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(grp, bucket, n, s) of the pairs of a matrix; s, on one of a group's rows, sums what ``measure`` gives besides group and value."""
    w = pair_weights(left, right)
    out = []
    for g, v, *more in _measured(measure, left, right):
        low = high = 0
        if w is None and not np.isscalar(g) and g.size and g.min() >= 0:
            codes = _bucket(v)
            low, high, groups = int(codes.min()), int(codes.max()), int(g.max()) + 1
        if high > low and groups * (high - low + 1) <= 1 << 19:  # all groups in one count
            width = high - low + 1
            codes -= low
            codes += np.multiply(g, width, dtype=np.int64)
            n = np.bincount(codes.ravel(), minlength=groups * width)
            at = np.flatnonzero(n)
            t = pd.DataFrame({"grp": at // width, "bucket": at % width + low, "n": n[at]})
            sums = [m[g == k].sum() if groups > 1 else m.sum() for m in more for k in range(groups)]
        else:
            g, u, v, *more = _kept(g, w, v, *more)
            t = _tally(g, _bucket(v), u)
            sums = {k: float((m if u is None else u * m)[slice(None) if np.isscalar(g) else g == k].sum()) for m in more for k in t["grp"].unique()}
        t["s"] = 0.0
        if more and len(t):
            start = np.flatnonzero(~t["grp"].duplicated())
            t.loc[start, "s"] = [sums[k] for k in t["grp"].to_numpy()[start]]
        out.append(t)
    return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]


def _listed(measure: Callable, left: pd.DataFrame, right: pd.DataFrame, wanted: dict[int, np.ndarray]) -> pd.DataFrame:
    """(grp, bucket, v, n) of the values in the wanted buckets of each group."""
    w = pair_weights(left, right)
    out = [pd.DataFrame({"grp": np.zeros(0, np.int64), "bucket": np.zeros(0, np.int64), "v": np.zeros(0), "n": np.zeros(0, np.int64)})]
    every = sorted({int(b) for buckets in wanted.values() for b in buckets})
    runs = [b for b in every if b - 1 not in every]
    runs = [(b, next(e for e in range(b + 1, b + len(every) + 1) if e not in every)) for b in runs]  # buckets side by side are one range
    if len(runs) > 16:
        runs = [(every[0], every[-1] + 1)]
    last = None
    for g, v, *_ in _measured(measure, left, right):
        if np.isscalar(g) and g < 0 or not v.size:
            continue
        if v is not last:  # groups of the same values
            hit = np.zeros(v.shape, bool)
            for b, e in runs:
                hit |= (v >= _edge(b)) & (v < _edge(e))
            last, at = v, np.flatnonzero(hit)
        v = v.ravel()[at] + 0.0
        code = _bucket(v)
        u = np.ones(len(at), np.int64) if w is None else w.ravel()[at]
        of = np.full(len(at), g, np.int64) if np.isscalar(g) else g.ravel()[at].astype(np.int64)
        for grp in np.unique(of[of >= 0]):
            if int(grp) not in wanted:
                continue
            mine = (of == grp) & np.isin(code, wanted[int(grp)]) & (u > 0)
            if mine.any():
                d, place = np.unique(v[mine], return_inverse=True)
                n = np.bincount(place, u[mine]).astype(np.int64)
                out.append(pd.DataFrame({"grp": int(grp), "bucket": _bucket(d), "v": d, "n": n}))
    return pd.concat(out, ignore_index=True)


def _added(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda d: d.groupby(by, as_index=False).sum()


def pair_quantiles(df: DataFrame, key: str, columns: Sequence[str], measure: Callable, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of a non-negative pair value per integer pair group.

    ``measure(left, right)`` reads ``columns`` and returns (group, value) matrices, or a list of them; a group may be one
    number for all pairs, groups below zero are ignored; a third matrix is added up per group (``sum``).  Two scans: counts per (group, coarse bucket), then only the values
    of the few buckets that hold the requested ranks.
    """
    rows = weighed(df, columns, key)

    def histogram(left, right, mask):
        return _histogram(measure, left, right)

    w = Window.partitionBy("grp")
    hist = scan(rows, key, [*columns, "_w"], histogram, "grp long, bucket long, n long, s double", _added(["grp", "bucket"])).groupBy("grp", "bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cum = hist.withColumn("before", F.sum("n").over(w.orderBy("bucket")) - F.col("n")).withColumn("total", F.sum("n").over(w)).withColumn("sum", F.sum("s").over(w))
    entries = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos")) for name, p in probs.items()])
    hits = cum.withColumn("e", F.explode(entries)).where(
        ((F.floor("e.pos") >= F.col("before")) & (F.floor("e.pos") < F.col("before") + F.col("n")))
        | ((F.ceil("e.pos") >= F.col("before")) & (F.ceil("e.pos") < F.col("before") + F.col("n"))))
    # one or two rows per (pair group, requested quantile)
    targets = hits.select("grp", "bucket", "before", "total", "sum", "e.name", "e.pos").limit(TARGET_LIMIT + 1).toPandas()
    if len(targets) > TARGET_LIMIT:
        raise ValueError(f"more than {TARGET_LIMIT} pair groups and quantiles; ask for fewer groups at a time")
    wanted: dict[int, np.ndarray] = {int(g): np.unique(b["bucket"].to_numpy(np.int64)) for g, b in targets.groupby("grp")}

    def values(left, right, mask):
        return _listed(measure, left, right, wanted)

    fine = scan(rows, key, [*columns, "_w"], values, "grp long, bucket long, v double, n long", _added(["grp", "bucket", "v"])).groupBy("grp", "bucket", "v").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("grp", "bucket").orderBy("v")
    fine = fine.withColumn("upto", F.sum("n").over(inside))
    t = df.sparkSession.createDataFrame(targets, "grp long, bucket long, before long, total long, sum double, name string, pos double")
    j = fine.join(F.broadcast(t), ["grp", "bucket"])
    covers = lambda r: (r >= F.col("before") + F.col("upto") - F.col("n")) & (r < F.col("before") + F.col("upto"))
    lo = F.max(F.when(covers(F.floor("pos")), F.col("v")))
    hi = F.max(F.when(covers(F.ceil("pos")), F.col("v")))
    per = j.groupBy("grp", "name").agg((lo + (hi - lo) * F.max(F.col("pos") - F.floor("pos"))).alias("q"), F.max("total").alias("n_pairs"), F.max("sum").alias("sum"))
    return per.groupBy("grp").agg(F.max("n_pairs").alias("n_pairs"), F.max("sum").alias("sum"), *[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in probs])


def pair_totals(df: DataFrame, key: str, columns: Sequence[str], measure: Callable) -> DataFrame:
    """Count, sum and sum of squares of a pair value per pair group; ``measure`` as in ``pair_quantiles``."""
    def reduce(left, right, mask):
        w = pair_weights(left, right)
        out = []
        for g, v in _measured(measure, left, right):
            g, u, v = _kept(g, w, v)
            if not len(v):
                continue
            weighted = v if u is None else u * v
            if np.isscalar(g):
                out.append(pd.DataFrame({"grp": [g], "n": [len(v) if u is None else int(u.sum())], "s": [weighted.sum()], "q": [weighted @ v]}))
                continue
            grp = _groups(g)
            place = g if grp[-1] < 1 << 16 else np.searchsorted(grp, g)
            at = np.flatnonzero(np.bincount(place))
            out.append(pd.DataFrame({"grp": grp, "n": np.bincount(place, u)[at].astype(np.int64), "s": np.bincount(place, weighted)[at], "q": np.bincount(place, weighted * v)[at]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"grp": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "s": [], "q": []})

    t = scan(weighed(df, columns, key), key, [*columns, "_w"], reduce, "grp long, n long, s double, q double", _added(["grp"]))
    return t.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def nearest(df: DataFrame, key: str, vector: str, k: int, dims: slice = slice(None)) -> DataFrame:
    """Exact k nearest other rows: top k per tile, then top k per row."""
    def reduce(left, right, mask):
        d = distances(matrix(left, vector, dims), matrix(right, vector, dims))
        same = left is right
        out = []
        for ids, others, m in ((left, right, d), (right, left, d.T)):
            if same:
                m = m.copy()
                np.fill_diagonal(m, np.inf)
            if m.shape[1]:
                top = np.argsort(m, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"src": np.repeat(ids[key].to_numpy(), top.shape[1]), "dst": others[key].to_numpy()[top].ravel(), "dist": np.take_along_axis(m, top, 1).ravel()}))
            if same:
                break
        out = pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "dist": []})
        return out[np.isfinite(out["dist"])]

    near = scan(df, key, [vector], reduce, "src long, dst long, dist double")
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)

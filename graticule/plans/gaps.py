"""Exact quantiles of |x - y| over all pairs of numbers, without forming the pairs.

Distinct values with their numbers lie in order in blocks of about ``BLOCK`` values.  How many pairs differ by at most t is read
off the order, block against block, and only blocks whose differences can lie on both sides of an interval are looked at; the
others count whole.  A coarse picture of the values gives a first interval around the wanted ranks, ``STEPS`` thresholds at a
time shrink it, and the few differences left in it are sorted.  Work grows as the values times a few tiles, not as the pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graticule.plans.lineage import cut

BLOCK = 1 << 16
STEPS = 128
SKETCH = 4096  # values of the coarse picture
MARGIN = 0.002  # share of the pairs on either side of the first interval
LISTED = 200_000  # differences that are sorted
BLOCKS = "grp long, block int, low double, high double, n long, coarse array<double>, x binary, w binary"


def _upto(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """For every x the number of ordered y with y - x <= t, as rounded differences compare."""
    p = np.searchsorted(y, x + t, side="right")
    while True:
        more = np.flatnonzero((p < len(y)) & (y[np.minimum(p, len(y) - 1)] - x <= t))
        if not len(more):
            break
        p[more] += 1
    while True:
        less = np.flatnonzero((p > 0) & (y[np.maximum(p - 1, 0)] - x > t))
        if not len(less):
            return p
        p[less] -= 1


def _count(x, wx, y, wy, t: float, same: bool) -> int:
    """Pairs of rows that differ by at most t; y lies behind x or is x."""
    if t < 0:
        return 0
    total = np.concatenate([[0], np.cumsum(wy)])
    reached = total[_upto(x, y, t)]
    if same:
        return int(wx @ (reached - total[1:]) + (wx * (wx - 1) // 2).sum())
    return int(wx @ reached)


def _list(x, wx, y, wy, low: float, high: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Differences above low and up to high, and the pairs of rows that have them."""
    a, b = (_upto(x, y, low) if low >= 0 else np.zeros(len(x), np.int64)), _upto(x, y, high)
    if same:
        a = np.maximum(a, np.arange(1, len(x) + 1))
    size = np.maximum(b - a, 0)
    i = np.repeat(np.arange(len(x)), size)
    j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    d, n = y[j] - x[i], wx[i] * wy[j]
    if same and low < 0:
        d, n = np.append(d, 0.0), np.append(n, (wx * (wx - 1) // 2).sum())
    v, place = np.unique(d, return_inverse=True)
    sums = np.zeros(len(v), np.int64)
    np.add.at(sums, place, n)
    return v, sums


def _blocks(counts: DataFrame) -> DataFrame:
    """One row per (grp, block) of ordered values; blocks are in order."""
    sizes = counts.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per group
    most = max((r["n"] for r in sizes), default=0)
    parts = -(-most // BLOCK)
    edges: dict[int, list[float]] = {}
    if parts > 1:
        cuts = counts.groupBy("grp").agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 100 * parts).alias("c"))
        edges = {r["grp"]: sorted(set(r["c"])) for r in cuts.collect()}  # fetched once, so that all rows see the same

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block = np.zeros(len(pdf), np.int32)
            for g, at in pdf.groupby("grp").indices.items():
                block[at] = np.searchsorted(edges.get(g, []), pdf["v"].to_numpy()[at], side="left")
            yield pdf.assign(block=block)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        x, w = pdf["v"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        share = max(16, SKETCH // parts)
        rank = (np.arange(share) + 0.5) / share * w.sum()
        coarse = x[np.minimum(np.searchsorted(np.cumsum(w), rank), len(x) - 1)]
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1].to_numpy(), "block": pdf["block"].iloc[:1].to_numpy(), "low": x[:1], "high": x[-1:], "n": [int(w.sum())], "coarse": [coarse], "x": [x.tobytes()], "w": [w.tobytes()]})

    placed = counts.mapInPandas(place, "grp long, v double, n long, block int")
    return cut(placed.groupBy("grp", "block").applyInPandas(gather, BLOCKS))


def _tiles(blocks: DataFrame, tiles: list[tuple[int, int, int]], work, schema: str) -> DataFrame:
    """``work(grp, x, wx, y, wy, same)`` on pairs of blocks (grp, a, b), a <= b."""
    rows = [(k, g, block, side) for k, (g, a, b) in enumerate(tiles) for side, block in enumerate([a, b] if a < b else [a])]
    need = blocks.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["tile", "grp", "block", "side"]), "tile int, grp long, block int, side int")
    parts = min(len(tiles), max(4 * blocks.sparkSession.sparkContext.defaultParallelism, len(tiles) // 8))  # a frame holds a few tiles
    sent = blocks.select("grp", "block", "x", "w").join(F.broadcast(need), ["grp", "block"]).select("tile", "grp", "side", "x", "w")
    sent = sent.repartitionById(parts, F.pmod(F.col("tile"), F.lit(parts))).sortWithinPartitions("tile", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def done():
            (_, g, x, wx), (_, _, y, wy) = held[0], held[-1]
            return work(g, x, wx, y, wy, len(held) == 1)
        for pdf in batches:
            for tile, g, x, w in zip(pdf["tile"], pdf["grp"], pdf["x"], pdf["w"]):
                if held and held[0][0] != tile:
                    yield done()
                    held = []
                held.append((tile, g, np.frombuffer(x, float), np.frombuffer(w, np.int64)))
        if held:
            yield done()

    return sent.mapInPandas(run, schema)


def gap_quantiles(df: DataFrame, group: str, value: str, prob: float) -> dict[int, float]:
    """Group -> the exact linearly interpolated quantile of |x - y| over its pairs of rows; groups of fewer than two numbers are left out.

    Rows without a value take no part; as elsewhere NaN is larger than all numbers.
    """
    v = F.col(value).cast("double")
    counts = cut(df.where(v.isNotNull()).select(F.col(group).cast("long").alias("grp"), v.alias("v")).groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n")))
    total = {r["grp"]: r["n"] for r in counts.groupBy("grp").agg(F.sum("n").alias("n")).collect()}
    blocks = _blocks(counts.where("NOT isnan(v)"))
    about = blocks.drop("x", "w").orderBy("grp", "block").toPandas()  # one row per block
    state, out = {}, {}
    for g, n in total.items():
        if n < 2:
            continue
        pos = prob * (n * (n - 1) // 2 - 1)
        first, last = int(np.floor(pos)) + 1, int(np.ceil(pos)) + 1  # wanted ranks, from 1
        mine = about[about["grp"] == g]
        numbers = int(mine["n"].sum())
        if last > numbers * (numbers - 1) // 2:
            out[g] = float("nan")
            continue
        low, high = mine["low"].to_numpy(), mine["high"].to_numpy()
        z, z_n = np.concatenate(mine["coarse"].tolist()), np.concatenate([np.full(len(c), m / len(c)) for c, m in zip(mine["coarse"], mine["n"])])
        if len(z) > SKETCH:
            at = np.searchsorted(np.cumsum(z_n), (np.arange(SKETCH) + 0.5) / SKETCH * z_n.sum())
            z = z[np.minimum(at, len(z) - 1)]
            z_n = np.ones(len(z))
        d = (z[None, :] - z[:, None])[np.triu_indices(len(z))]
        weight = np.outer(z_n, z_n)[np.triu_indices(len(z))]
        order = np.argsort(d)
        upto = np.cumsum(weight[order]) / weight.sum()
        guess = [d[order[min(np.searchsorted(upto, q), len(d) - 1)]] for q in (max(prob - MARGIN, 0), min(prob + MARGIN, 1))]
        top = float(high.max() - low.min())
        # the interval is (low, high]: fewer than ``first`` pairs up to its low end, ``last`` or more up to its high end
        state[g] = {"first": first, "last": last, "frac": pos - np.floor(pos), "lo": -1.0, "hi": top, "before": 0, "upto": numbers * (numbers - 1) // 2,
                    "try": np.unique([-1.0, 0.0, *guess, top]), "block": mine["block"].to_numpy(), "low": low, "high": high, "n": mine["n"].to_numpy()}

    def split(s):
        """Pairs of blocks whose differences may lie in the interval, and the pairs of rows of those that lie below it."""
        least, most = np.maximum(s["low"][None, :] - s["high"][:, None], 0), s["high"][None, :] - s["low"][:, None]
        upper = np.triu(np.ones(least.shape, bool))
        below = upper & (most <= s["lo"])
        pairs = np.where(np.eye(len(s["n"]), dtype=bool), (s["n"] * (s["n"] - 1) // 2)[:, None], s["n"][:, None] * s["n"][None, :])
        a, b = np.nonzero(upper & ~below & (least <= s["hi"]))
        return list(zip(s["block"][a].tolist(), s["block"][b].tolist())), int(pairs[below].sum())

    while True:
        todo = {g: s for g, s in state.items() if s["upto"] - s["before"] > LISTED and len(s["try"]) > 2}
        if not todo:
            break
        parts = {g: split(s) for g, s in todo.items()}
        tried = {g: s["try"] for g, s in todo.items()}

        def number(g, x, wx, y, wy, same):
            return pd.DataFrame({"grp": g, "step": np.arange(len(tried[g])), "n": [_count(x, wx, y, wy, t, same) for t in tried[g]]})
        tiles = [(g, a, b) for g, (ab, _) in parts.items() for a, b in ab]
        found = _tiles(blocks, tiles, number, "grp long, step int, n long").groupBy("grp", "step").agg(F.sum("n").alias("n")).toPandas()
        for g, s in todo.items():
            mine = found[found["grp"] == g].sort_values("step")
            upto = mine["n"].to_numpy() + parts[g][1]
            a = np.flatnonzero(upto < s["first"])[-1]
            b = np.flatnonzero(upto >= s["last"])[0]
            s["lo"], s["hi"], s["before"], s["upto"] = float(tried[g][a]), float(tried[g][b]), int(upto[a]), int(upto[b])
            s["try"] = np.unique(np.clip(np.linspace(s["lo"], s["hi"], STEPS), s["lo"], s["hi"]))
    # no number lies between the ends of an interval that cannot be cut: all its pairs differ by the high end
    listed = {g: s for g, s in state.items() if s["upto"] - s["before"] <= LISTED}
    out |= {g: s["hi"] for g, s in state.items() if g not in listed}
    parts = {g: split(s) for g, s in listed.items()}
    ends = {g: (s["lo"], s["hi"]) for g, s in listed.items()}

    def values(g, x, wx, y, wy, same):
        v, n = _list(x, wx, y, wy, *ends[g], same)
        return pd.DataFrame({"grp": g, "v": v, "n": n})
    tiles = [(g, a, b) for g, (ab, _) in parts.items() for a, b in ab]
    if tiles:
        found = _tiles(blocks, tiles, values, "grp long, v double, n long").groupBy("grp", "v").agg(F.sum("n").alias("n")).toPandas()  # ``LISTED`` per group at most
        for g, s in listed.items():
            mine = found[found["grp"] == g].sort_values("v")
            upto = np.cumsum(mine["n"].to_numpy()) + s["before"]
            lo, hi = (float(mine["v"].to_numpy()[np.searchsorted(upto, r)]) for r in (s["first"], s["last"]))
            out[g] = float(lo + (hi - lo) * s["frac"])
    return out

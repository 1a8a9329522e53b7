"""Greedy selection in few passes.

Scores of a greedy choice only fall as picks are made (a distance to the nearest pick, a bonus for what no pick has
yet).  So a pass that returns the best ``BREADTH`` rows and the next one behind them settles many picks at once: while
the best of these rows, scored anew after every pick, still comes before that next row as it was, no other row can
come first.  When it no longer does, all picks of the round are applied to the pool in one pass, the pool is written and the round
before it removed.  Jobs follow rounds, not picks; every plan reads one written table; the driver holds ``BREADTH`` rows.

Ties go to the smaller key.  A row is picked once; a pool smaller than the number of picks gives as many as it has.
Rows with a null key or a null vector, value or score take no part.  A pool with repeated keys is refused.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graticule.operators import joins as J
from graticule.plans.lineage import Rounds

BREADTH = 1024  # rows that a pass returns
NEAR_ANCHORS = 4096  # up to this many anchors go with the tasks, counted first; more are dealt in blocks of as many
POINT_ROWS = 16384  # points of one task against one block of anchors

Update = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def lazy_greedy(pool: DataFrame, key: str, n: int, update: Update, breadth: int = BREADTH) -> pd.DataFrame:
    """The picks in order, with all columns of ``pool`` (``key``, ``score`` and state) as they were when picked.

    ``update(rows, picks)`` returns the rows with state and score after further picks; no score may rise.
    """
    rounds, picks = Rounds(pool.sparkSession), []
    while len(picks) < n:
        top = pool.where(F.col("score").isNotNull() & F.col(key).isNotNull()).orderBy(F.desc("score"), key).limit(breadth + 1).toPandas()
        if top[key].duplicated().any():
            raise ValueError(f"{key} repeats in the pool")
        behind = (top["score"].iloc[breadth], -top[key].iloc[breadth]) if len(top) > breadth else None
        open_, new = top.head(breadth), []
        while len(picks) < n and len(open_):
            score, name = open_["score"].to_numpy(), open_[key].to_numpy()
            first = np.flatnonzero(score == score.max())
            first = first[np.argmin(name[first])]
            if behind is not None and (score[first], -name[first]) < behind:
                break
            pick = open_.iloc[[first]]
            picks.append(pick), new.append(pick)
            open_ = update(open_.drop(open_.index[first]).reset_index(drop=True), pick)
        if behind is None or len(picks) == n:
            break
        taken = pd.concat(new)

        def apply(batches):
            for pdf in batches:
                rest = pdf[~pdf[key].isin(taken[key])].reset_index(drop=True)
                yield update(rest, taken) if len(rest) else rest

        pool = rounds.keep(pool.mapInPandas(apply, pool.schema))
    rounds.end()
    return pd.concat(picks).reset_index(drop=True) if picks else pd.DataFrame(columns=pool.columns)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, width))


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return np.einsum("ij,ij->i", d, d)


def nearest_anchor(points: DataFrame, anchors: DataFrame, key: str, vector: str, near: int = NEAR_ANCHORS) -> DataFrame:
    """(key, vector, d2): squared distance to the nearest anchor, infinite without anchors; exact.

    A few anchors go with the tasks and nothing is shuffled.  More are dealt in blocks: a task holds one block of points
    and one of anchors, and only (key, distance) is reduced afterwards.
    """
    points, anchors = points.select(key, vector).where(F.col(vector).isNotNull()), anchors.select(F.col(vector).alias("_a")).where(F.col(vector).isNotNull())
    some = anchors.limit(near + 1).toPandas()

    def least(pdf: pd.DataFrame, at: np.ndarray) -> np.ndarray:
        x, best = _matrix(pdf[vector], at.shape[1]), np.full(len(pdf), np.inf)
        for a in at:
            np.minimum(best, squared(x, a), out=best)
        return best

    if len(some) <= near:
        at = _matrix(some["_a"], 0)

        def scan(batches):
            for pdf in batches:
                yield pdf.assign(d2=least(pdf, at))
        return points.mapInPandas(scan, f"{key} {points.schema[key].dataType.simpleString()}, {vector} {points.schema[vector].dataType.simpleString()}, d2 double")
    dealt = max(1, -(-points.count() // POINT_ROWS)), max(1, -(-anchors.count() // near))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = points.select(key, vector, F.pmod(F.xxhash64(key), F.lit(dealt[0])).cast("int").alias("_p"), every(dealt[1]).alias("_b"))
    right = anchors.select("_a", F.pmod(F.xxhash64("_a"), F.lit(dealt[1])).cast("int").alias("_b"), every(dealt[0]).alias("_p"))

    def block(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: mine[key], "d2": least(mine, _matrix(other["_a"], 0))}) if len(mine) and len(other) else pd.DataFrame({key: mine[key][:0], "d2": []})

    found = left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInPandas(block, f"{key} {points.schema[key].dataType.simpleString()}, d2 double")
    return points.join(found.groupBy(key).agg(F.min("d2").alias("d2")), key)


def farthest_points(reference: DataFrame, candidates: DataFrame, key: str, vector: str, n: int, breadth: int = BREADTH, near: int = NEAR_ANCHORS) -> DataFrame:
    """(pick, key, dist): greedy max-min coverage of ``candidates``, starting from the reference points."""
    pool = nearest_anchor(candidates, reference, key, vector, near).select(key, vector, F.col("d2").alias("score"))

    def update(rows: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        best = rows["score"].to_numpy(dtype=float)
        x = _matrix(rows[vector], 0)
        for p in picks[vector]:
            best = np.minimum(best, squared(x, np.asarray(p, dtype=float))) if len(x) else best
        return rows.assign(score=best)

    got = lazy_greedy(pool, key, n, update, breadth)
    out = [(k + 1, int(r[key]), float(np.sqrt(r["score"]))) for k, r in enumerate(got.to_dict("records"))]
    return candidates.sparkSession.createDataFrame(out, f"pick long, {key} long, dist double")


def greedy_novelty(candidates: DataFrame, seen: DataFrame, key: str, signatures: Sequence[str] | str, x: str, n: int, bonus: Sequence[float] | float,
                   breadth: int = BREADTH, joint: float = 0.0) -> DataFrame:
    """(pick, key, score): repeated choice by the sum of a bonus per unseen signature, ``joint`` for an unseen combination of all
    signatures, and the distance of ``x`` to the nearest seen or picked value.

    What is seen is joined, by signature and as a series of values, never listed; a null signature counts as one value.
    """
    signatures = [signatures] if isinstance(signatures, str) else list(signatures)
    bonus = [float(bonus)] * len(signatures) if isinstance(bonus, (int, float)) else [float(b) for b in bonus]
    pool = candidates.select(key, *signatures, F.col(x).cast("double").alias(x)).where(F.col(x).isNotNull())

    def marked(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        known = seen.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct().withColumn(name, F.lit(False))
        same: Column = F.lit(True)
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return rows.join(known, same, "left").drop(*[f"_{c}" for c in columns]).withColumn(name, F.coalesce(name, F.lit(True)))

    flags = [f"_new{k}" for k in range(len(signatures))]
    for c, flag in zip(signatures, flags):
        pool = marked(pool, [c], flag)
    pool = marked(pool, signatures, "_newall")
    pool = J.nearest_key(pool, x, seen, x).withColumn("_d", F.coalesce(F.abs(F.col(x) - F.col("nearest")), F.lit(float("inf")))).drop("nearest")
    worth = F.col("_d")
    for flag, b in [*zip(flags, bonus), ("_newall", joint)]:
        worth = worth + F.when(F.col(flag), b).otherwise(0.0)
    pool = pool.withColumn("score", worth)

    def seen_in(rows: pd.DataFrame, picks: pd.DataFrame, columns: list[str]) -> np.ndarray:
        names = lambda df: list(zip(*[df[c].astype(object).where(df[c].notna(), None) for c in columns]))
        found = set(names(picks))
        return np.array([v in found for v in names(rows)], dtype=bool)

    def update(rows: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        at, d = rows[x].to_numpy(dtype=float), rows["_d"].to_numpy(dtype=float)
        for v in picks[x]:
            d = np.minimum(d, np.abs(at - v))
        rows, score = rows.assign(_d=d), d
        for columns, flag, b in [*[([c], f, b) for c, f, b in zip(signatures, flags, bonus)], (signatures, "_newall", joint)]:
            fresh = rows[flag].to_numpy(dtype=bool) & ~seen_in(rows, picks, columns)
            rows, score = rows.assign(**{flag: fresh}), score + np.where(fresh, b, 0.0)
        return rows.assign(score=score)

    got = lazy_greedy(pool, key, n, update, breadth)
    out = [(k + 1, int(r[key]), float(r["score"])) for k, r in enumerate(got.to_dict("records"))]
    return candidates.sparkSession.createDataFrame(out, f"pick long, {key} long, score double")

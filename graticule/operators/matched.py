"""Random subsets that look like a given one, and how much every cluster weighs in a subspace.

A matched subset has, session by session, as many clusters as the given one with the same numbers of rows in them.
Wanted numbers are served largest first; each draws, without replacement, among the clusters of its session that are large enough.
Clusters of one size are exchangeable, so the draw needs only how many clusters there are of every size: an urn per
(replicate, session) deals the wanted numbers over sizes, and the clusters of a size take them in keyed order.  The urn's
input is a histogram: n rows have at most about sqrt(2 n) distinct cluster sizes.  Rows are touched twice, to count clusters and to
take the drawn rows.

The given clusters are large enough themselves, so a draw never fails.  Rows with a null cluster or session take no part; an
unknown (null) membership is no membership; without members the result is empty; rows that repeat count as often as they stand.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graticule.operators.resampling import _eigen, hashed_order, largest_angle, replicates
from graticule.plans import order_stats as O
from graticule.plans.lineage import cut, shared


def deal(wanted: list[tuple[int, int]], sizes: list[tuple[int, int]], key: str) -> list[tuple[int, int, int]]:
    """(size, wanted number, clusters) of one draw: each wanted number falls on clusters that are large enough."""
    rng = np.random.default_rng(int(hashlib.md5(key.encode()).hexdigest()[:16], 16))
    size = np.array([s for s, _ in sizes])
    left = np.array([n for _, n in sizes])
    out = []
    for want, times in sorted(wanted, reverse=True):
        enough = np.flatnonzero((size >= want) & (left > 0))
        got = rng.multivariate_hypergeometric(left[enough], times, method="marginals")
        left[enough] -= got
        out += [(int(size[k]), int(want), int(n)) for k, n in zip(enough, got) if n]
    return out


def matched_draws(df: DataFrame, cluster: str, row: str, in_subset: Column, reps: int, seed: int, session: str | None = None) -> DataFrame:
    """(rep, session, cluster, row) of ``reps`` random subsets matched to the rows where ``in_subset`` holds."""
    where = F.lit(0).cast("long") if session is None else F.col(session)
    rows = df.select(where.alias("_s"), F.col(cluster).alias("_c"), F.col(row).alias("_r"), F.coalesce(in_subset, F.lit(False)).alias("_in")).where("_s IS NOT NULL AND _c IS NOT NULL")
    sizes = shared(rows.groupBy("_s", "_c").agg(F.count(F.lit(1)).alias("_have"), F.count_if("_in").alias("_want")))
    counted = lambda c, name: sizes.where(F.col(c) > 0).groupBy("_s", c).agg(F.count(F.lit(1)).alias("_n")).groupBy("_s").agg(F.array_sort(F.collect_list(F.struct(c, "_n"))).alias(name))
    urns = counted("_want", "wanted").join(counted("_have", "sizes"), "_s").select("_s", F.col("_s").cast("string").alias("_name"), "wanted", "sizes", replicates(reps).alias("rep"))

    def draw(batches):
        for pdf in batches:
            out = []
            for s, name, wanted, have, rep in zip(pdf["_s"], pdf["_name"], pdf["wanted"], pdf["sizes"], pdf["rep"]):
                dealt = deal([tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in wanted], [tuple(h.values()) if isinstance(h, dict) else tuple(h) for h in have], f"{seed}|{rep}|{name}")
                for size in sorted({d[0] for d in dealt}):
                    mine = [(w, n) for z, w, n in dealt if z == size]
                    out.append((s, rep, size, [w for w, _ in mine], np.cumsum([n for _, n in mine]).tolist()))
            yield pd.DataFrame(out, columns=["_s", "rep", "_have", "_takes", "_upto"])

    plan = urns.mapInPandas(draw, f"_s {urns.schema['_s'].dataType.simpleString()}, rep long, _have long, _takes array<long>, _upto array<long>")
    pool = sizes.select("_s", "_c", "_have").join(plan, ["_s", "_have"])
    order = hashed_order(pool, ["rep", "_s", "_have"], "_c", seed, "_p", F.col("rep"))
    step = F.size(F.filter("_upto", lambda u: u < F.col("_p")))
    chosen = cut(order.select("rep", "_s", "_c", "_have", F.get("_takes", step).alias("_take")).where("_take IS NOT NULL"))
    # rows of all clusters, and of the chosen ones once per replicate, over as many tasks as keep each at O.TASK_ROWS
    n = sizes.agg(F.sum("_have").alias("n")).first()["n"] or 0
    drawn = chosen.agg(F.sum("_have").alias("n")).first()["n"] or 0
    tasks = O.partitions(df, max(n, drawn))
    members = O.dealt(rows.select("_s", "_c", "_r"), tasks, "_s", "_c").join(O.dealt(chosen.drop("_have"), tasks, "_s", "_c"), ["_s", "_c"])
    placed = hashed_order(members, ["rep", "_s", "_c"], "_r", seed + 1, "_p", F.col("rep"), tasks=tasks)
    return placed.where("_p <= _take").select("rep", *([] if session is None else [F.col("_s").alias(session)]), F.col("_c").alias(cluster), F.col("_r").alias(row))


def signature(draws: DataFrame, cluster: str, by: list[str]) -> DataFrame:
    """(by, size, n_clusters): how many clusters hold how many rows."""
    return draws.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("size")).groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n_clusters"))


def leave_one_out_angles(moments: DataFrame, cluster: str, d: int, k: int) -> DataFrame:
    """(cluster, n, angle_deg): largest angle between the top-k subspace of all rows and of all rows but a cluster's.

    ``moments`` as ``resampling.cluster_moments`` gives them; a cluster is left out by subtracting its sums from the total.  NULL
    where nothing is left.
    """
    long = moments.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    total = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("t")).scalar()  # 1 + d + d * d numbers

    def solve(batches):
        for pdf in batches:
            out = []
            for c, m, t in zip(pdf[cluster], pdf["m"], pdf["t"]):
                m, t = np.asarray(m, dtype=float), np.asarray(t, dtype=float)
                rest = t - m
                out.append((c, int(m[0]), largest_angle(_eigen(t, d, k)[0], _eigen(rest, d, k)[0]) if rest[0] > 0.5 else None))
            yield pd.DataFrame(out, columns=[cluster, "n", "angle_deg"])

    return moments.select(cluster, "m", total.alias("t")).mapInPandas(solve, f"{cluster} {moments.schema[cluster].dataType.simpleString()}, n long, angle_deg double")

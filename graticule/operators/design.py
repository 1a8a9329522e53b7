"""Design of experiments: coverage, candidates, regret, verdicts, blinding."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.functions import arrays as A
from graticule.functions.hashing import draw_key, hex_prefix, uniform
from graticule.plans import order_stats as O
from graticule.plans.gaps import gap_quantiles

ANCHOR_LIMIT = 1024
ANCHORS_AT_ONCE = 16  # rows are read once for so many


def _bounded_rows(df: DataFrame, what: str) -> list:
    rows = df.limit(ANCHOR_LIMIT + 1).collect()
    if len(rows) > ANCHOR_LIMIT:
        raise ValueError(f"{what}: more than {ANCHOR_LIMIT} rows")
    return rows


def anchor_gap_scale(points: DataFrame, anchors: DataFrame, key: str, vector: str) -> DataFrame:
    """1.4826 * median |J_i - J_k| per anchor with J the squared distance to the anchor."""
    n = points.count()
    rows = _bounded_rows(anchors.orderBy(key), "anchors") if n > 1 else []
    out = []
    for k in range(0, len(rows), ANCHORS_AT_ONCE):
        objectives = [F.struct(F.lit(int(r[key])).cast("long").alias("anchor"), A.squared_distance(F.col(vector), A.literal_array(list(r[vector]))).alias("j")) for r in rows[k: k + ANCHORS_AT_ONCE]]
        medians = gap_quantiles(points.select(F.explode(F.array(*objectives)).alias("e")).select("e.anchor", "e.j"), "anchor", "j", 0.5)
        out += [(int(r[key]), n * (n - 1) // 2, 1.4826 * medians[r[key]] if r[key] in medians else None) for r in rows[k: k + ANCHORS_AT_ONCE]]
    return points.sparkSession.createDataFrame(out, "anchor long, n_pairs long, scale double")


def latin_hypercube(points: DataFrame, key: str, dims: Sequence[str], seed: int) -> DataFrame:
    """One point per stratum and dimension: (hashed position - 1 + u) / n, per dimension."""
    n = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = points
    for d in dims:
        h = draw_key(seed, d, F.col(key))
        rows = out.withColumn("_h", h)
        rows = O.ordinal(rows, [], [F.col("_h"), F.col(key)], [hex_prefix(F.col("_h"))], "_pos").drop("_h")
        out = rows.withColumn(d, (F.col("_pos") - 1 + uniform(seed, "u", d, F.col(key))) / n).drop("_pos")
    return out


def pairwise_regret(df: DataFrame, pair: str, objective: str, chosen: Column) -> DataFrame:
    """Objective of the chosen candidate minus the best of its pair; exactly two candidates, one chosen."""
    g = df.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("c"), F.max(F.when(chosen, F.col(objective))).alias("chosen_value"), F.min(objective).alias("best_value"))
    ok = (F.col("n") == 2) & (F.col("c") == 1)
    return g.select(pair, ok.alias("ok"), F.when(ok, F.col("chosen_value") - F.col("best_value")).alias("regret"))


def blind_codes(df: DataFrame, key: str, seed: int, prefix: str = "AUDIT") -> DataFrame:
    """Anonymous running code in hashed order."""
    rows = df.withColumn("_h", draw_key(seed, F.col(key)))
    rows = O.ordinal(rows, [], [F.col("_h"), F.col(key)], [hex_prefix(F.col("_h"))], "_pos")
    return rows.withColumn("code", F.format_string(f"{prefix}-%02d", "_pos")).drop("_h", "_pos")

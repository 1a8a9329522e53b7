"""Joins the equi-join does not cover: nearest, as-of, shifted alignment, stencils."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graticule.plans import order_stats as O
from graticule.plans import series as S


def lookup_states(df: DataFrame, lookup: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Tuple lookup that keeps 'no such tuple' apart from 'tuple present, value missing'."""
    j = df.join(lookup.withColumn("_present", F.lit(True)), list(keys), "left")
    state = F.when(F.col("_present").isNull(), "absent").when(F.col(value).isNull(), "present_null").otherwise("present")
    return j.withColumn("state", state).drop("_present")


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], order: str, value: str, tolerance: float, rows: float = S.SLICE_ROWS, ties: str = "before") -> DataFrame:
    """Nearest right row within ``tolerance`` per left row; linear work, no pair is ever built.

    Both sides are merged into one series and the last/next right row is carried to each left row.  A left
    row with a NULL position or key stays, unmatched.
    """
    by = list(by)
    right = right.dropna(subset=[*by, order])
    payload = F.struct(F.col(order).alias("at"), F.col(value).alias("val"))
    merged = left.withColumns({"_payload": F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType), "_side": F.lit(1)}).unionByName(
        right.select(*by, order, payload.alias("_payload"), F.lit(0).alias("_side")), allowMissingColumns=True)
    both = S.with_seen(merged, by, order, F.col("_payload"), "_back", "_next", rows).where("_side = 1")
    db, dn = F.col(order) - F.col("_back.at"), F.col("_next.at") - F.col(order)
    prefer_next = F.col("_back").isNull() | ((dn < db) if ties == "before" else (dn <= db))
    hit = F.when(F.col("_next").isNotNull() & prefer_next, F.col("_next")).otherwise(F.col("_back"))
    out = both.withColumn("_hit", hit).withColumn("_hit", F.when(F.abs(F.col("_hit.at") - F.col(order)) <= tolerance, F.col("_hit")))
    return out.withColumns({"match_at": F.col("_hit.at"), "match_value": F.col("_hit.val")}).drop("_payload", "_side", "_back", "_next", "_hit")


def nearest_key(df: DataFrame, x: str, keys: DataFrame, key: str) -> DataFrame:
    """Closest key (ties to the smaller one), matched as a series; NULL finds nothing."""
    distinct = keys.select(F.col(key).cast("double").alias("k")).where("k IS NOT NULL").distinct()
    right = distinct.select(F.col("k").alias(x), F.col("k").alias("v"))
    return asof_nearest(df, right, [], x, "v", float("inf")).withColumnRenamed("match_value", "nearest").drop("match_at")


def best_shift(mine: DataFrame, pilot: DataFrame, by: Sequence[str], order: str, flag: str, depth: str, shifts: Sequence[float], tolerance: float,
               shallow_frac: float, hard_ratio: float) -> DataFrame:
    """Align two flag series by the shift of best agreement and grade the disagreement there."""
    by = list(by)
    keys = [*by, "shift"]
    grid = F.explode(F.array(*[F.lit(float(s)) for s in shifts])).alias("shift")
    left = mine.select("*", grid).withColumn(order, F.col(order) - F.col("shift"))
    right = pilot.select(*by, order, flag, grid)
    m = asof_nearest(left, right, keys, order, flag, tolerance, ties="after").where("match_value IS NOT NULL")
    m = m.select(*keys, flag, depth, "match_value")
    agree = m.groupBy(*keys).agg(F.avg((F.col(flag) == F.col("match_value")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n_matched"))
    best = agree.groupBy(*by).agg(F.max_by(F.struct("shift", "agreement", "n_matched"), F.struct("agreement", (-F.col("shift")).alias("o"))).alias("b")).select(*by, "b.*")
    hit = m.join(best, keys)
    ref = O.quantiles(hit.where(F.col(flag)), by, depth, {"ref": 0.9})
    g = hit.join(ref, by, "left")
    shallow = ~F.col("match_value") & (F.col(depth) < shallow_frac * F.col("ref"))
    invaded = shallow & F.col(flag)
    both = F.count_if(F.col(flag) & F.col("match_value"))
    return g.groupBy(*by).agg(
        F.first("shift").alias("shift"), F.first("agreement").alias("agreement"), F.first("n_matched").alias("n_matched"),
        (both / F.nullif(F.count_if(flag), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if("match_value"), F.lit(0))).alias("recall"),
        F.count_if(shallow).alias("n_shallow"), F.count_if(invaded).alias("n_invaded"),
        F.count_if(invaded & (F.col(depth) / F.col("ref") < hard_ratio)).alias("n_hard"))


def cross_source_pair_moments(df: DataFrame, source: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Number and mean squared distance of all unordered pairs from different sources.

    Over a set, the sum of squared differences is n * sum(x^2) - (sum x)^2, so pair statistics
    follow from per-source sums and no pair is materialised.
    """
    by = list(by)
    sums = df.groupBy(*by, source).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], F.sum(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))).alias("q"))
    sq = lambda wrap: sum((wrap(c) * wrap(c) for c in columns[1:]), wrap(columns[0]) * wrap(columns[0]))
    within = F.sum(F.col("n") * F.col("q") - sq(lambda c: F.col(f"s_{c}")))
    overall = F.sum("n") * F.sum("q") - sq(lambda c: F.sum(f"s_{c}"))
    n_pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    return sums.groupBy(*by).agg(n_pairs.alias("n_pairs"), ((overall - within) / F.nullif(n_pairs, F.lit(0.0))).alias("mean_sq_dist"))


def bilinear(maps: DataFrame, points: Column, min_weight: float = 0.99) -> DataFrame:
    """Mask-normalised bilinear samples; ``points`` is an array of structs (k, y, x) in pixel units."""
    rows, cols = F.col("n_rows"), F.col("n_cols")

    def corner(p, dy, dx):
        r, c = F.floor(p["y"]) + dy, F.floor(p["x"]) + dx
        wy = p["y"] - F.floor(p["y"]) if dy else 1 - (p["y"] - F.floor(p["y"]))
        wx = p["x"] - F.floor(p["x"]) if dx else 1 - (p["x"] - F.floor(p["x"]))
        inside = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
        z = F.when(inside, F.get("z", (r * cols + c).cast("int")))
        return F.struct(F.when(z.isNotNull(), wy * wx).otherwise(0.0).alias("w"), F.coalesce(z, F.lit(0.0)).alias("z"))

    def sample(p):
        cs = F.array(*[corner(p, dy, dx) for dy in (0, 1) for dx in (0, 1)])
        w = F.aggregate(cs, F.lit(0.0), lambda a, e: a + e["w"])
        wz = F.aggregate(cs, F.lit(0.0), lambda a, e: a + e["w"] * e["z"])
        return F.struct(p["k"].alias("k"), F.when(w >= min_weight, wz / w).alias("z"))

    return maps.select("map_id", F.explode(F.transform(points, sample)).alias("p")).select("map_id", "p.k", "p.z")

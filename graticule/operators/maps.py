"""Descriptors of gridded maps.

Input layout: one row per map with ``map_id, n_rows, n_cols, z ARRAY<DOUBLE>, valid ARRAY<BOOLEAN>``
in row-major order.  A map is bounded by the instrument raster, so per-map work is expressed
on its arrays: it needs no shuffle and no key can become hot, whatever the number of maps.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions import arrays as A



def masked(maps: DataFrame) -> DataFrame:
    """Masked-out cells become NULL; nothing is filled in."""
    return maps.withColumn("z", F.zip_with("z", "valid", lambda z, ok: F.when(ok, z)))


def cells(maps: DataFrame, value: str = "z", keep: tuple[str, ...] = ("map_id", "label")) -> DataFrame:
    """Long cell table (map, r, c, value)."""
    pos = F.col("_pos")
    return (
        maps.select(*keep, "n_cols", F.posexplode_outer(value).alias("_pos", value)).where("_pos IS NOT NULL")
        .select(*keep, F.floor(pos / F.col("n_cols")).cast("long").alias("r"),
                (pos % F.col("n_cols")).cast("long").alias("c"), value)
    )


def arrays_from_cells(cell_table: DataFrame) -> DataFrame:
    """Inverse of :func:`cells` plus coordinates; a map is bounded by its raster."""
    packed = F.array_sort(F.collect_list(F.struct("r", "c", "z", "valid")))
    return (
        cell_table.groupBy("map_id").agg(packed.alias("p"), (F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))
        .select("map_id", "n_rows", "n_cols", F.col("p.z").alias("z"), F.col("p.valid").alias("valid"))
    )


def residualised(maps: DataFrame) -> DataFrame:
    """Adds the map median, the depth (its negative) and replaces z by z - median."""
    with_median = masked(maps).withColumn("median_z", A.array_median(F.col("z")))
    return with_median.withColumns({"depth": -F.col("median_z"), "z": A.shifted(F.col("z"), F.col("median_z"))})


def moments(residuals: DataFrame) -> DataFrame:
    """Sq, Sa, population skewness and excess kurtosis of the residual."""
    z = F.col("z")
    central = A.let(A.array_mean(z), lambda mu: F.struct(*[A.central_moment(z, mu, p).alias(f"m{p}") for p in (2, 3, 4)]))
    return residuals.withColumn("_c", central).select(
        "map_id", "label", F.sqrt(A.mean_of(z, lambda v: v * v)).alias("sq"), A.mean_of(z, F.abs).alias("sa"),
        (F.col("_c.m3") / F.pow("_c.m2", 1.5)).alias("skew"), (F.col("_c.m4") / (F.col("_c.m2") * F.col("_c.m2")) - 3).alias("kurt"))


def ranges(residuals: DataFrame) -> DataFrame:
    z = F.col("z")
    probs = {"p02": 0.02, "p98": 0.98, "lo": 0.0, "hi": 1.0, "p25": 0.25, "p75": 0.75, "p05": 0.05, "p95": 0.95}
    q = A.let(A.finite_sorted(z), lambda s: F.struct(*[A.sorted_quantile(s, p).alias(n) for n, p in probs.items()]))
    spread = A.let(A.array_mean(z), lambda mu: F.sqrt(A.central_moment(z, mu, 2)))
    return residuals.withColumn("_q", q).select(
        "map_id", (F.col("_q.p98") - F.col("_q.p02")).alias("p98_p2"), (F.col("_q.hi") - F.col("_q.lo")).alias("span"), (-F.col("_q.lo")).alias("deepest"),
        (F.col("_q.p75") - F.col("_q.p25")).alias("iqr"), (F.col("_q.p95") - F.col("_q.p05")).alias("tail"), spread.alias("centred_rms"))


def mad_outliers(residuals: DataFrame, k: float = 3.5) -> DataFrame:
    """Count of cells below -k robust sigmas, per million cells of the grid."""
    z = F.col("z")
    sigma = A.let(A.array_median(z), lambda m: 1.4826 * A.array_median(F.transform(z, lambda v: F.abs(v - m))))
    found = A.let(sigma, lambda s: F.struct(s.alias("sigma"), F.size(F.filter(z, lambda v: v < -k * s)).alias("n")))
    return residuals.withColumn("_f", found).select(
        "map_id", "_f.sigma", F.col("_f.n").alias("n_low"), (F.col("_f.n") * 1e6 / (F.col("n_rows") * F.col("n_cols"))).alias("per_million"))


def _at(r: Column, c: Column) -> Column:
    return F.get(F.col("z"), (r * F.col("n_cols") + c).cast("int"))


def _difference(index: Column, size: Column, at) -> Column:
    """Central difference inside, one-sided at both ends (unit pitch)."""
    inner = (at(index + 1) - at(index - 1)) / 2
    return F.when(index == 0, at(index + 1) - at(index)).when(index == size - 1, at(index) - at(index - 1)).otherwise(inner)


def with_gradients(maps: DataFrame, pitch: float) -> DataFrame:
    """Adds arrays ``gx``, ``gy`` (per unit length) and ``lap`` (per squared pixel, reflecting edges)."""
    rows, cols = F.col("n_rows"), F.col("n_cols")
    rc = lambda i: (F.floor(i / cols).cast("int"), (i % cols).cast("int"))

    def gx(_, i):
        r, c = rc(i)
        return _difference(c, cols, lambda k: _at(r, k)) / pitch

    def gy(_, i):
        r, c = rc(i)
        return _difference(r, rows, lambda k: _at(k, c)) / pitch

    def lap(v, i):
        r, c = rc(i)
        up, down = F.greatest(r - 1, F.lit(0)), F.least(r + 1, rows - 1)
        left, right = F.greatest(c - 1, F.lit(0)), F.least(c + 1, cols - 1)
        return _at(up, c) + _at(down, c) + _at(r, left) + _at(r, right) - 4 * v

    return maps.withColumns({"gx": F.transform("z", gx), "gy": F.transform("z", gy), "lap": F.transform("z", lap)})


def gradient_stats(maps: DataFrame, pitch: float) -> DataFrame:
    rms = lambda c: F.sqrt(A.mean_of(F.col(c), lambda v: v * v))
    rows = with_gradients(maps, pitch).withColumns({"gx_rms": rms("gx"), "gy_rms": rms("gy"), "lap_rms": rms("lap")})
    return rows.select("map_id", "gx_rms", "gy_rms", F.hypot("gx_rms", "gy_rms").alias("slope_rms"),
                       (F.col("gx_rms") / F.greatest("gy_rms", F.lit(1e-300))).alias("aniso"), "lap_rms")


def zone_stats(maps: DataFrame, pitch: float, core_half: float, ring_width: float) -> DataFrame:
    """Gradient medians of the centre square and of the edge ring; missing cells use the map median."""
    filled = masked(maps).withColumn("z", A.let(A.array_median(F.col("z")), lambda m: F.transform("z", lambda v: F.coalesce(v, m))))
    rows, cols = F.col("n_rows"), F.col("n_cols")
    yy = lambda i: (F.floor(i / cols) + 0.5) * pitch - rows * pitch / 2
    xx = lambda i: ((i % cols) + 0.5) * pitch - cols * pitch / 2
    core = lambda i: (F.abs(xx(i)) <= core_half) & (F.abs(yy(i)) <= core_half)
    ring = lambda i: (F.abs(xx(i)) >= cols * pitch / 2 - ring_width) | (F.abs(yy(i)) >= rows * pitch / 2 - ring_width)
    out = with_gradients(filled, pitch).withColumn("_g", F.zip_with("gx", "gy", lambda a, b: F.hypot(a, b))) \
        .withColumn("_g", F.zip_with("_g", "valid", lambda g, ok: F.when(ok, g)))
    pick = lambda zone: A.array_median(F.transform("_g", lambda g, i: F.when(zone(i), g)))
    return out.withColumns({"core": pick(core), "ring": pick(ring)}).select(
        "map_id", "core", "ring", (F.col("ring") / F.greatest("core", F.lit(1e-12))).alias("ratio"))


def axis_profiles(maps: DataFrame, band: float = 0.30) -> DataFrame:
    """Median of every column ('u') and row ('v') over the central tangential band, with counts."""
    rows, cols = F.col("n_rows"), F.col("n_cols")
    long = masked(maps)
    centre = lambda n: (n - 1) / 2.0
    col_vals = lambda j: F.filter("z", lambda v, i: v.isNotNull() & (i % cols == j) & (F.abs(F.floor(i / cols) - centre(rows)) <= band * rows))
    row_vals = lambda j: F.filter("z", lambda v, i: v.isNotNull() & (F.floor(i / cols) == j) & (F.abs(i % cols - centre(cols)) <= band * cols))
    entry = lambda axis, vals: lambda j: F.struct(F.lit(axis).alias("axis"), j.cast("long").alias("pos"), vals(j).alias("vals"))
    u = F.transform(F.sequence(F.lit(0), cols - 1), entry("u", col_vals))
    v = F.transform(F.sequence(F.lit(0), rows - 1), entry("v", row_vals))
    return long.select("map_id", F.explode(F.concat(u, v)).alias("p")).select(
        "map_id", "p.axis", "p.pos", A.array_median(F.col("p.vals")).alias("height"), F.size("p.vals").alias("n_valid"))


def stack_mask(maps: DataFrame) -> DataFrame:
    """Per grid position: valid in every map, share of valid maps and mean of the valid values."""
    cell = cells(masked(maps))
    return cell.groupBy("r", "c").agg(
        F.bool_and(F.col("z").isNotNull()).alias("all_valid"), F.avg(F.col("z").isNotNull().cast("double")).alias("coverage"),
        F.avg("z").alias("mean_z"))


def imputed(maps: DataFrame, min_coverage: float) -> DataFrame:
    """Missing cells take the position mean where enough maps cover it; others stay missing.

    The position table has one row per raster cell, independent of the number of maps.
    """
    fill = stack_mask(maps).where(F.col("coverage") >= min_coverage).select("r", "c", "mean_z")
    return cells(masked(maps)).join(fill, ["r", "c"], "left").withColumn("filled", F.coalesce("z", "mean_z"))


def mask_contract(maps: DataFrame, pitch: Column) -> DataFrame:
    """One row per map listing every violated rule of the height-map contract."""
    checks = {
        "shape": F.size("z") != F.col("n_rows") * F.col("n_cols"),
        "mask_shape": F.size("valid") != F.size("z"),
        "pitch": ~(pitch > 0) | F.isnan(pitch),
        "masked_in_not_finite": F.exists(F.zip_with("z", "valid", lambda z, ok: ok & (z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")))), lambda b: b),
        "masked_out_not_null": F.exists(F.zip_with("z", "valid", lambda z, ok: ~ok & z.isNotNull()), lambda b: b),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    return maps.select("map_id", F.concat_ws("|", broken).alias("violations"), (F.size(broken) == 0).alias("ok"))

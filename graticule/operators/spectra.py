"""Spectral descriptors.

``posexplode_outer`` is used after a transform on purpose: the inner form lets the optimizer infer
a size filter that would evaluate the transform a second time.

The transforms are narrow Arrow-batched matrix products; everything after them is grouped by
map id directly above the explode, so partial aggregation reduces every map to a handful of
rows before anything is shuffled.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions import arrays as A
from graticule.functions import composition as C
from graticule.functions import transforms as T
from graticule.operators.maps import masked

# Wavelength bands [lo, hi) in map units.
BANDS = [("lt8", 0.0, 8.0), ("8_16", 8.0, 16.0), ("16_32", 16.0, 32.0), ("32_64", 32.0, 64.0), ("64_inf", 64.0, math.inf)]


def dct_table(maps: DataFrame, rows: int, cols: int, pitch: float) -> DataFrame:
    """(map, u, v, coef, lam); lam is NULL for the constant mode."""
    k = F.col("_k")
    fy = F.floor(k / cols) / F.lit(2.0 * rows * pitch)
    fx = (k % cols) / F.lit(2.0 * cols * pitch)
    return (
        maps.select("map_id", "label", T.dct2(F.col("z"), rows, cols).alias("_c"))
        .select("map_id", "label", F.posexplode_outer("_c").alias("_k", "coef")).where("_k IS NOT NULL")
        .select("map_id", "label", F.floor(k / cols).cast("long").alias("u"), (k % cols).cast("long").alias("v"), "coef",
                F.when(k > 0, 1 / F.hypot(fy, fx)).alias("lam"))
    )


def geometric_edges(lo: float, hi: float, bins: int) -> list[float]:
    return [float(e) for e in np.geomspace(lo, hi, bins + 1)]


def bin_of(lam: Column, edges: list[float]) -> Column:
    """Index of the half-open bin; the last bin is closed; outside is NULL."""
    out = F.when(lam.isNull() | (lam < edges[0]) | (lam > edges[-1]), F.lit(None).cast("long"))
    for b in range(len(edges) - 2):
        out = out.when(lam < edges[b + 1], F.lit(b).cast("long"))
    return out.otherwise(F.lit(len(edges) - 2).cast("long"))


def radial_spectrum(coefs: DataFrame, edges: list[float], low_modes: int = 20) -> DataFrame:
    """Log-binned non-constant energy per map with mode counts and coverage."""
    energy = F.col("coef") * F.col("coef")
    per_bin = coefs.where("lam IS NOT NULL").withColumn("bin", bin_of(F.col("lam"), edges)) \
        .groupBy("map_id", "label", "bin").agg(F.sum(energy).alias("energy"), F.count(F.lit(1)).alias("n_modes"))
    packed = per_bin.groupBy("map_id", "label").agg(
        F.sum("energy").alias("total"), F.sum(F.when(F.col("bin").isNull(), F.col("energy")).otherwise(0.0)).alias("_out"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("bin", F.lit(-1)), F.struct("energy", "n_modes")))).alias("_bins"))
    index = F.col("bin")
    edge = F.array(*[F.lit(e) for e in edges])
    lo, hi = F.get(edge, index.cast("int")), F.get(edge, (index + 1).cast("int"))
    hit = F.try_element_at("_bins", index)
    return (
        packed.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(edges) - 2).cast("long"))))
        .withColumns({"energy": F.coalesce(hit["energy"], F.lit(0.0)), "n_modes": F.coalesce(hit["n_modes"], F.lit(0))})
        .select("map_id", "label", "bin", lo.alias("lam_lo"), hi.alias("lam_hi"), F.sqrt(lo * hi).alias("lam_geo"), "energy",
                (F.col("energy") / F.col("total")).alias("fraction"), "n_modes", (F.col("n_modes") < low_modes).alias("low_modes"),
                (F.col("_out") / F.col("total")).alias("uncovered"), (F.col("energy") / F.col("total") / F.log(hi / lo)).alias("density"))
    )


def spectrum_descriptors(radial: DataFrame) -> DataFrame:
    """Log centroid, normalised entropy, effective number of bands, peak wavelength."""
    total = radial.groupBy("map_id", "label").agg(
        F.sum("fraction").alias("s"), F.sum(F.col("fraction") * F.log("lam_geo")).alias("sl"),
        F.sum(F.when(F.col("fraction") > 0, F.col("fraction") * F.log("fraction")).otherwise(0.0)).alias("sq"),
        F.max_by("lam_geo", F.struct("fraction", -F.col("bin"))).alias("peak"), F.count(F.lit(1)).alias("n"))
    entropy = -(F.col("sq") / F.col("s") - F.log("s"))
    return total.select("map_id", "label", (F.col("sl") / F.col("s")).alias("centroid_log"), F.exp(F.col("sl") / F.col("s")).alias("centroid"),
                        (entropy / F.log(F.col("n").cast("double"))).alias("entropy"), F.exp(entropy).alias("bands"), "peak")


def band_energies(coefs: DataFrame) -> DataFrame:
    """Energy of each band, of the constant mode and in total, one row per map."""
    energy = F.col("coef") * F.col("coef")
    aggs = [F.sum(F.when((F.col("lam") >= lo) & (F.col("lam") < hi), energy).otherwise(0.0)).alias(f"e_{n}") for n, lo, hi in BANDS]
    return coefs.groupBy("map_id", "label").agg(*aggs, F.sum(F.when(F.col("lam").isNull(), energy).otherwise(0.0)).alias("e_dc"),
                                                 F.count(F.lit(1)).alias("n_cells"))


def band_composition(coefs: DataFrame) -> DataFrame:
    """Five shares of the non-constant energy and the share of the constant mode."""
    names = [n for n, _, _ in BANDS]
    e = band_energies(coefs)
    total = sum((F.col(f"e_{n}") for n in names[1:]), F.col(f"e_{names[0]}"))
    e = e.withColumn("e_total", total)
    return e.select("map_id", "label", *[(F.col(f"e_{n}") / F.col("e_total")).alias(f"p_{n}") for n in names],
                    (F.col("e_dc") / (F.col("e_dc") + F.col("e_total"))).alias("dc_share"), "e_total", "n_cells")


def log_band_energy(coefs: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Per-cell band energy, band RMS and floored log10 energy."""
    e = band_energies(coefs)
    cols = []
    for n, _, _ in BANDS:
        per_cell = F.col(f"e_{n}") / F.col("n_cells")
        cols += [F.sqrt(per_cell).alias(f"rms_{n}"), F.log10(F.greatest(per_cell, F.lit(floor))).alias(f"log_{n}")]
    return e.select("map_id", "label", *cols)


def bandpass(maps: DataFrame, rows: int, cols: int, pitch: float, bands=BANDS) -> DataFrame:
    """Band-limited copies of each map, one array column per band."""
    return maps.select("map_id", "label", "n_rows", "n_cols", "z",
                       *[T.band_filter(F.col("z"), rows, cols, pitch, lo, hi).alias(f"z_{n}") for n, lo, hi in bands])


def population_variance(values: Column) -> Column:
    return A.let(A.array_mean(values), lambda mu: A.central_moment(values, mu, 2))


def difference_bands(maps: DataFrame, rows: int, cols: int, sigmas: list[float]) -> DataFrame:
    """Standard deviation of octave differences of Gaussian-smoothed maps, plus the last low-pass."""
    sm = maps.select("map_id", *[T.smooth(F.col("z"), rows, cols, s).alias(f"g{k}") for k, s in enumerate(sigmas)])
    out = []
    for k in range(len(sigmas) - 1):
        out.append(F.sqrt(F.greatest(population_variance(F.zip_with(f"g{k}", f"g{k + 1}", lambda a, b: a - b)), F.lit(0.0))).alias(f"dog{k}"))
    out.append(F.sqrt(F.greatest(population_variance(F.col(f"g{len(sigmas) - 1}")), F.lit(0.0))).alias("low"))
    return sm.select("map_id", *out)


def scale_energy(maps: DataFrame, rows: int, cols: int, pitch: float, sigmas: list[float]) -> DataFrame:
    """Mean share of the map variance kept at each smoothing scale and in each wavelength band."""
    fields = {f"G{s:g}": T.smooth(F.col("z"), rows, cols, s) for s in sigmas}
    fields |= {n: T.band_filter(F.col("z"), rows, cols, pitch, lo, hi) for n, lo, hi in BANDS}
    wide = maps.select("map_id", population_variance(F.col("z")).alias("_v"), *[f.alias(f"f_{n}") for n, f in fields.items()])
    entry = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), population_variance(F.col(f"f_{n}")).alias("v")) for n in fields]))
    return wide.select("_v", entry.alias("e")).groupBy(F.col("e.scale").alias("scale")).agg(F.avg(F.col("e.v") / F.col("_v")).alias("share"))


def power_table(maps: DataFrame, rows: int, cols: int, pitch: float) -> DataFrame:
    """(map, lam, theta, power) of the Hann-windowed spectrum, constant mode left out."""
    k = F.col("_k")
    ky, kx = F.floor(k / cols), k % cols
    signed = lambda q, n: F.when(q < (n + 1) // 2, q).otherwise(q - n) / F.lit(n * pitch)
    return (
        maps.select("map_id", "label", T.hann_power(F.col("z"), rows, cols).alias("_p"))
        .select("map_id", "label", F.posexplode_outer("_p").alias("_k", "power"))
        .withColumns({"fy": signed(ky, rows), "fx": signed(kx, cols)})
        .where(k > 0)
        .select("map_id", "label", "power", (1 / F.hypot("fy", "fx")).alias("lam"), F.atan2("fy", "fx").alias("theta"))
    )


def directional_metrics(power: DataFrame, bands, theta_bins: int) -> DataFrame:
    """Axial order A2, wave and stripe angles and power-weighted angular entropy per band."""
    band = F.coalesce(*[F.when((F.col("lam") >= lo) & (F.col("lam") < hi), F.lit(n)) for n, lo, hi in bands])
    fold = F.pmod(F.col("theta"), F.lit(math.pi))
    tb = F.least(F.floor(fold / F.lit(math.pi / theta_bins) + 1e-9), F.lit(theta_bins - 1))
    per_bin = power.withColumn("band", band).where("band IS NOT NULL").groupBy("map_id", "label", "band", tb.alias("tb")).agg(
        F.sum("power").alias("p"), F.sum(F.col("power") * F.cos(2 * F.col("theta"))).alias("c"),
        F.sum(F.col("power") * F.sin(2 * F.col("theta"))).alias("s"))
    agg = per_bin.groupBy("map_id", "label", "band").agg(
        F.sum("p").alias("p"), F.sum("c").alias("c"), F.sum("s").alias("s"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)).alias("plogp"))
    wave = 0.5 * F.degrees(F.atan2("s", "c"))
    entropy = F.log("p") - F.col("plogp") / F.col("p")
    return agg.select("map_id", "label", "band", F.col("p").alias("energy"), (F.hypot("s", "c") / F.col("p")).alias("a2"), wave.alias("wave_deg"),
                      F.pmod(wave + 90, F.lit(180.0)).alias("stripe_deg"), (entropy / math.log(theta_bins)).alias("entropy"))


def lambda_star(radial: DataFrame, lo: float, hi: float, guard: float) -> DataFrame:
    """Energy-weighted geometric mean wavelength inside [lo, hi) if the window holds enough energy."""
    inside = (F.col("lam_geo") >= lo) & (F.col("lam_geo") < hi)
    g = radial.groupBy("map_id").agg(
        F.sum("energy").alias("total"), F.sum(F.when(inside, F.col("energy")).otherwise(0.0)).alias("band"),
        F.sum(F.when(inside, F.col("energy") * F.log("lam_geo")).otherwise(0.0)).alias("wl"))
    share = F.when(F.col("total") > 0, F.col("band") / F.col("total")).otherwise(0.0)
    valid = (F.col("total") > 0) & (share >= guard) & (F.col("band") > 0)
    return g.select("map_id", share.alias("share"), valid.alias("valid"), F.when(valid, F.exp(F.col("wl") / F.col("band"))).alias("lam_star"))


def lambda_peak(radial: DataFrame, lo: float, hi: float, min_modes: int, min_share: float) -> DataFrame:
    """Strongest admissible bin of the window with mode-count and share gates."""
    inside = (F.col("lam_geo") >= lo) & (F.col("lam_geo") < hi)
    ok = inside & (F.col("n_modes") >= min_modes)
    g = radial.groupBy("map_id").agg(
        F.sum(F.when(inside, F.col("energy")).otherwise(0.0)).alias("window"),
        F.max(F.when(ok, F.struct(F.col("energy"), (-F.col("bin")).alias("nb"), F.col("lam_geo")))).alias("top"))
    share = F.when(F.col("top").isNotNull() & (F.col("window") > 0), F.col("top.energy") / F.col("window")).otherwise(0.0)
    valid = F.col("top").isNotNull() & (share >= min_share)
    return g.select("map_id", share.alias("share"), valid.alias("valid"), F.when(valid, F.col("top.lam_geo")).alias("lam_peak"))


def acf_cut_length(residuals: DataFrame, rows: int, cols: int, pitch: float) -> DataFrame:
    """Mean of the first x and y lags where the periodic autocorrelation drops below 1/e."""
    def crossing(step: int, size: int) -> Column:
        lags = F.sequence(F.lit(1), F.lit(size // 2))
        low = F.filter(lags, lambda k: F.get("_a", (k * step).cast("int")) < F.get("_a", F.lit(0)) / F.lit(math.e))
        return F.coalesce(F.get(low, F.lit(0)), F.lit(size // 2))
    rows_ = residuals.select("map_id", T.autocorrelation(F.col("z"), rows, cols).alias("_a"))
    return rows_.select("map_id", ((crossing(cols, rows) + crossing(1, cols)) / 2.0 * pitch).alias("acf_length"))


def acf_radial_length(residuals: DataFrame, rows: int, cols: int, pitch: float) -> DataFrame:
    """First interpolated radial lag where the binned, mean-centred autocorrelation crosses 1/e."""
    half = min(rows, cols) // 2
    centred = residuals.withColumn("z", A.shifted(F.col("z"), A.array_mean(F.col("z"))))
    k = F.col("_k")
    wrap = lambda q, n: F.when(q < n - n // 2, q).otherwise(q - n)
    lags = (
        centred.select("map_id", T.autocorrelation(F.col("z"), rows, cols).alias("_a"))
        .withColumn("_a0", F.get("_a", F.lit(0)))
        .select("map_id", "_a0", F.posexplode_outer("_a").alias("_k", "a")).where("_k IS NOT NULL")
        .withColumn("bin", F.floor(F.hypot(wrap(F.floor(k / cols), rows), wrap(k % cols, cols)) + 0.5))
        .where(F.col("bin") <= half)
    )
    prof = lags.groupBy("map_id", "bin").agg(F.avg(F.col("a") / F.col("_a0")).alias("rho"))
    packed = prof.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("bin", "rho"))).alias("p"))
    first = F.get(F.filter("p", lambda e: e["rho"] < 1 / math.e), F.lit(0))
    packed = packed.withColumn("_f", first).withColumn("_b", F.get("p", (F.col("_f.bin") - 1).cast("int")))
    frac = (F.col("_b.rho") - 1 / math.e) / F.greatest(F.col("_b.rho") - F.col("_f.rho"), F.lit(1e-12))
    length = F.when(F.col("_f").isNull(), F.lit(float(half))).when(F.col("_f.bin") == 0, F.lit(0.0)) \
        .otherwise(F.col("_f.bin") - 1 + F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0)))
    return packed.select("map_id", (length * pitch).alias("corr_length"))


def observe(maps: DataFrame, rows: int, cols: int, pitch: float, theta_bins: int = 36,
            zero_threshold: float = 1e-10, replacement: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Canonical observation vector per map and the validity table of its blocks.

    Narrow: the map table is read once, every map is reduced on its own row, nothing is shuffled.
    """
    m = masked(maps)
    base = m.withColumns({"_med": A.array_median(F.col("z")), "_full": ~F.exists("z", lambda v: v.isNull()), "_any": F.exists("z", lambda v: v.isNotNull())}) \
        .withColumn("z", A.shifted(F.col("z"), F.col("_med")))
    two = [b for b in BANDS if b[0] in ("8_16", "16_32")]
    seen = base.withColumn("_s", T.band_and_direction(F.when(F.col("_full"), F.col("z")), rows, cols, pitch, BANDS, two, theta_bins)) \
        .withColumn("e_total", A.array_sum(F.col("_s.energies")))
    total = F.when(F.col("_s").isNotNull(), F.col("e_total"))
    share = [F.get("_s.energies", F.lit(k)) / F.nullif(F.col("e_total"), F.lit(0.0)) for k in range(len(BANDS))]
    parts, _ = C.zero_replaced(share, zero_threshold, replacement)
    at = lambda k, j: F.get(F.get("_s.directional", F.lit(k)), F.lit(j))
    wide = {f"{v}_{n}": at(k, j) for k, (n, _, _) in enumerate(two) for j, v in enumerate(("a2", "entropy", "energy"))}
    rows_ = seen.select("map_id", "label", (-F.col("_med")).alias("depth"), F.sqrt(A.mean_of(F.col("z"), lambda v: v * v)).alias("a_med"), "_full", "_any",
                        total.alias("e_total"), *[F.when(total > 0, c).alias(f"ilr{k}") for k, c in enumerate(C.ilr(parts), 1)], *[c.alias(n) for n, c in wide.items()])
    vector = rows_.drop("_full", "_any", "e_total", "energy_8_16", "energy_16_32")
    reason = lambda energy, why: F.when(~F.col("_any"), F.lit("EMPTY")).when(~F.col("_full"), F.lit("INCOMPLETE_GRID")).when(~(F.coalesce(energy, F.lit(0.0)) > 0), F.lit(why)).otherwise(F.lit(""))
    blocks = F.explode(F.array(*[
        F.struct(F.lit(n).alias("block"), e.alias("energy"), reason(e, w).alias("reason"))
        for n, e, w in [("ILR", F.col("e_total"), "ZERO_NON_DC"), ("8_16", F.col("energy_8_16"), "ZERO_BAND"), ("16_32", F.col("energy_16_32"), "ZERO_BAND")]]))
    validity = rows_.select("map_id", blocks.alias("b")).select("map_id", "b.block", (F.col("b.reason") == "").alias("band_valid"), "b.energy", "b.reason")
    return vector, validity

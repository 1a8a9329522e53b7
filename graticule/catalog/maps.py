"""Map descriptor queries (cell-table contracts, residuals, gradients, profiles)."""
from __future__ import annotations

from pyspark.sql import functions as F

from graticule.catalog.fixtures import maps, sql
from graticule.catalog.registry import query
from graticule.operators import maps as M

PITCH = 4.0
RESID = "vr AS (SELECT map_id, label, r, c, z - median(z) OVER (PARTITION BY map_id) AS z FROM cells WHERE valid)"
FULL = "vr AS (SELECT map_id, label, r, c, z - median(z) OVER (PARTITION BY map_id) AS z FROM cells)"
GRAD = """g AS (SELECT map_id, r, c, z, valid,
  CASE c WHEN 0 THEN lead(z) OVER x - z WHEN 7 THEN z - lag(z) OVER x ELSE (lead(z) OVER x - lag(z) OVER x) / 2 END / 4 AS gx,
  CASE r WHEN 0 THEN lead(z) OVER y - z WHEN 7 THEN z - lag(z) OVER y ELSE (lead(z) OVER y - lag(z) OVER y) / 2 END / 4 AS gy,
  coalesce(lead(z) OVER x, z) + coalesce(lag(z) OVER x, z) + coalesce(lead(z) OVER y, z) + coalesce(lag(z) OVER y, z) - 4 * z AS lap
  FROM src WINDOW x AS (PARTITION BY map_id, r ORDER BY c), y AS (PARTITION BY map_id, c ORDER BY r))"""


def full_maps(t):
    return maps(t).withColumn("valid", F.transform("z", lambda _: F.lit(True)))


@query("S3_cells_from_arrays", "map_id:l label:l r:l c:l z:d valid:b", sql("cells", "SELECT * FROM cells"))
def cells_from_arrays(t):
    m = maps(t)
    pair = m.withColumn("z", F.arrays_zip("z", "valid"))
    return M.cells(pair).select("map_id", "label", "r", "c", "z.z", "z.valid")


@query("S3_arrays_from_cells", "map_id:l n_rows:l n_cols:l packed:s n_valid:l", sql("cells", """
SELECT map_id, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols,
string_agg(CAST(CAST(floor(z * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY r, c) AS packed, count(*) FILTER (valid) AS n_valid
FROM cells GROUP BY map_id"""))
def arrays_from_cells(t):
    back = M.arrays_from_cells(cells_from_arrays(t))
    text = F.array_join(F.transform("z", lambda v: F.floor(v * 1000000).cast("string")), ",")
    return back.select("map_id", "n_rows", "n_cols", text.alias("packed"), F.size(F.filter("valid", lambda v: v)).alias("n_valid"))


@query("A1_residualise", "map_id:l depth:d r:l c:l z:d", sql("cells", """
SELECT map_id, -median(z) OVER (PARTITION BY map_id) AS depth, r, c, z - median(z) OVER (PARTITION BY map_id) AS z FROM cells WHERE valid"""))
def residualise(t):
    return M.cells(M.residualised(maps(t)), keep=("map_id", "depth")).where("z IS NOT NULL")


@query("A2_moments", "map_id:l sq:d sa:d skew:d kurt:d", sql("cells", RESID + """, mu AS (SELECT map_id, avg(z) AS m FROM vr GROUP BY map_id)
SELECT map_id, sqrt(avg(z * z)) AS sq, avg(abs(z)) AS sa, avg(pow(z - m, 3)) / pow(avg(pow(z - m, 2)), 1.5) AS skew,
avg(pow(z - m, 4)) / pow(avg(pow(z - m, 2)), 2) - 3 AS kurt FROM vr JOIN mu USING (map_id) GROUP BY map_id"""))
def moments(t):
    return M.moments(M.residualised(maps(t)))


@query("A3_ranges", "map_id:l p98_p2:d span:d deepest:d iqr:d tail:d centred_rms:d", sql("cells", RESID + """
SELECT map_id, quantile_cont(z, 0.98) - quantile_cont(z, 0.02) AS p98_p2, max(z) - min(z) AS span, -min(z) AS deepest,
quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iqr, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS tail, stddev_pop(z) AS centred_rms
FROM vr GROUP BY map_id"""))
def ranges(t):
    return M.ranges(M.residualised(maps(t)))


@query("A4_mad_outliers", "map_id:l sigma:d n_low:l per_million:d", sql("cells", RESID + """,
md AS (SELECT map_id, 1.4826 * median(abs(z)) AS sigma FROM vr GROUP BY map_id)
SELECT map_id, any_value(sigma) AS sigma, count(*) FILTER (z < -1.5 * sigma) AS n_low, count(*) FILTER (z < -1.5 * sigma) * 1e6 / 64 AS per_million
FROM vr JOIN md USING (map_id) GROUP BY map_id"""))
def mad_outliers(t):
    return M.mad_outliers(M.residualised(maps(t)), k=1.5)


@query("A5_gradient_stats", "map_id:l gx_rms:d gy_rms:d slope_rms:d aniso:d lap_rms:d", sql("cells", "src AS (SELECT * FROM cells), " + GRAD + """
SELECT map_id, sqrt(avg(gx * gx)) AS gx_rms, sqrt(avg(gy * gy)) AS gy_rms, sqrt(avg(gx * gx + gy * gy)) AS slope_rms,
sqrt(avg(gx * gx)) / greatest(sqrt(avg(gy * gy)), 1e-300) AS aniso, sqrt(avg(lap * lap)) AS lap_rms FROM g GROUP BY map_id"""))
def gradient_stats(t):
    return M.gradient_stats(full_maps(t), PITCH)


@query("A6_zone_stats", "map_id:l core:d ring:d ratio:d", sql("cells", """
md AS (SELECT map_id, median(z) AS m FROM cells WHERE valid GROUP BY map_id),
src AS (SELECT map_id, r, c, CASE WHEN valid THEN z ELSE m END AS z, valid FROM cells JOIN md USING (map_id)), """ + GRAD + """,
zz AS (SELECT map_id, sqrt(gx * gx + gy * gy) AS s, abs((c + 0.5) * 4 - 16) AS x, abs((r + 0.5) * 4 - 16) AS y FROM g WHERE valid)
SELECT map_id, median(s) FILTER (x <= 8 AND y <= 8) AS core, median(s) FILTER (x >= 12 OR y >= 12) AS ring,
median(s) FILTER (x >= 12 OR y >= 12) / greatest(median(s) FILTER (x <= 8 AND y <= 8), 1e-12) AS ratio FROM zz GROUP BY map_id"""))
def zone_stats(t):
    return M.zone_stats(maps(t), PITCH, core_half=8.0, ring_width=4.0)


PROFILES = """SELECT map_id, 'u' AS axis, c AS pos, median(z) FILTER (valid AND abs(r - 3.5) <= 2.4) AS height,
count(*) FILTER (valid AND abs(r - 3.5) <= 2.4) AS n_valid FROM cells GROUP BY map_id, c
UNION ALL SELECT map_id, 'v', r, median(z) FILTER (valid AND abs(c - 3.5) <= 2.4), count(*) FILTER (valid AND abs(c - 3.5) <= 2.4)
FROM cells GROUP BY map_id, r"""


@query("A7_axis_profiles", "map_id:l axis:s pos:l height:d n_valid:l", sql("cells", PROFILES))
def axis_profiles(t):
    return M.axis_profiles(maps(t))


@query("S15_profile_table", "axis:s pos:l n_maps:l n_cells:l mean_height:d", sql("cells", f"""p AS ({PROFILES})
SELECT axis, pos, count(height) AS n_maps, sum(n_valid) AS n_cells, avg(height) AS mean_height FROM p GROUP BY axis, pos"""))
def profile_table(t):
    return M.axis_profiles(maps(t)).groupBy("axis", "pos").agg(
        F.count("height").alias("n_maps"), F.sum("n_valid").alias("n_cells"), F.avg("height").alias("mean_height"))


@query("A32_stack_mask", "r:l c:l all_valid:b coverage:d mean_z:d", sql("cells", """
SELECT r, c, bool_and(valid) AS all_valid, avg(valid::INT) AS coverage, avg(z) FILTER (valid) AS mean_z FROM cells GROUP BY r, c"""))
def stack_mask(t):
    return M.stack_mask(maps(t))


@query("A32_impute_by_coverage", "map_id:l r:l c:l filled:d", sql("cells", """
f AS (SELECT r, c, avg(z) FILTER (valid) AS m FROM cells GROUP BY r, c HAVING avg(valid::INT) >= 0.9)
SELECT map_id, r, c, CASE WHEN valid THEN z ELSE m END AS filled FROM cells LEFT JOIN f USING (r, c)"""))
def impute_by_coverage(t):
    return M.imputed(maps(t), 0.9)


@query("C3_map_contract", "map_id:l violations:s ok:b", sql("cells", """
SELECT map_id, CASE WHEN bool_and(valid) THEN '' ELSE 'masked_out_not_null' END AS violations, bool_and(valid) AS ok FROM cells GROUP BY map_id"""))
def map_contract(t):
    """Maps whose masked-out cells still carry numbers break the contract."""
    return M.mask_contract(maps(t), F.lit(PITCH))

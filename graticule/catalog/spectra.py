"""Spectral queries: DCT energies, compositions, directional order, autocorrelation."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from graticule.catalog.fixtures import compositions, maps, sql
from graticule.catalog.maps import full_maps
from graticule.catalog.registry import query
from graticule.functions import composition as C
from graticule.functions import transforms as TR
from graticule.operators import maps as M
from graticule.operators import spectra as S

N, PITCH = 8, 4.0
EDGES = S.geometric_edges(6.0, 70.0, 6)

RESID = "resid AS (SELECT map_id, label, r, c, z - median(z) OVER (PARTITION BY map_id) AS z FROM cells)"
BASIS = """basis AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) * cos(pi() * (i + 0.5) * k / 8.0) END AS b
  FROM range(8) AS a(k), range(8) AS d(i))"""
DCT = RESID + ", " + BASIS + """,
half AS (SELECT map_id, label, k AS u, c, sum(b * z) AS z FROM resid JOIN basis ON i = r GROUP BY map_id, label, k, c),
dct AS (SELECT map_id, label, u, k AS v, sum(b * z) AS coef, CASE WHEN u + k > 0 THEN 1 / sqrt(pow(u / 64.0, 2) + pow(k / 64.0, 2)) END AS lam
  FROM half JOIN basis ON i = c GROUP BY map_id, label, u, k)"""
BANDED = DCT + """, be AS (SELECT map_id, label, sum(coef * coef) FILTER (lam < 8) AS e1, sum(coef * coef) FILTER (lam >= 8 AND lam < 16) AS e2,
  sum(coef * coef) FILTER (lam >= 16 AND lam < 32) AS e3, sum(coef * coef) FILTER (lam >= 32 AND lam < 64) AS e4,
  sum(coef * coef) FILTER (lam >= 64) AS e5, sum(coef * coef) FILTER (lam IS NULL) AS e0, e1 + e2 + e3 + e4 + e5 AS et FROM dct GROUP BY map_id, label)"""
EDGE_LIST = "[" + ", ".join(repr(e) for e in EDGES) + "]"


def radial_sql(name: str, edges: list[float]) -> str:
    lits = "[" + ", ".join(repr(e) for e in edges) + "]"
    n = len(edges) - 1
    return f"""{name} AS (SELECT m.map_id, m.label, m.b AS bin, m.lo AS lam_lo, m.hi AS lam_hi, sqrt(m.lo * m.hi) AS lam_geo,
  coalesce(sum(d.coef * d.coef), 0) AS energy, count(d.coef) AS n_modes, any_value(m.et) AS total
  FROM (SELECT map_id, label, et, b, {lits}[b + 1]::DOUBLE AS lo, {lits}[b + 2]::DOUBLE AS hi FROM be, range({n}) AS g(b)) m
  LEFT JOIN dct d ON d.map_id = m.map_id AND d.lam >= m.lo AND (d.lam < m.hi OR (m.b = {n - 1} AND d.lam <= m.hi))
  GROUP BY m.map_id, m.label, m.b, m.lo, m.hi)"""


def desc_sql(name: str, source: str, bins: int) -> str:
    return f"""{name} AS (SELECT map_id, label, sum(q * ln(lam_geo)) AS centroid_log, exp(sum(q * ln(lam_geo))) AS centroid,
  -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln({bins}) AS entropy, exp(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END)) AS bands,
  arg_max(lam_geo, q - bin * 1e-15) AS peak FROM (SELECT *, energy / sum(energy) OVER (PARTITION BY map_id) AS q FROM {source}) GROUP BY map_id, label)"""


RADIAL = BANDED + ", " + radial_sql("radial", EDGES)


def residuals(t):
    return M.residualised(full_maps(t))


def coefs(t):
    return S.dct_table(residuals(t), N, N, PITCH)


def radial(t, edges=EDGES):
    return S.radial_spectrum(coefs(t), edges)


@query("A9_dct2", "map_id:l u:l v:l coef:d lam:d", sql("cells", DCT + " SELECT * FROM dct"))
def dct2(t):
    return coefs(t)


@query("A10_radial_spectrum", "map_id:l bin:l lam_lo:d lam_hi:d lam_geo:d energy:d fraction:d n_modes:l low_modes:b uncovered:d density:d", sql("cells", RADIAL + """
SELECT *, energy / total AS fraction, n_modes < 20 AS low_modes, energy / total / ln(lam_hi / lam_lo) AS density,
(total - sum(energy) OVER (PARTITION BY map_id)) / total AS uncovered FROM radial"""))
def radial_spectrum(t):
    return radial(t)


@query("A11_spectrum_descriptors", "map_id:l centroid_log:d centroid:d entropy:d bands:d peak:d", sql("cells", RADIAL + ", " + desc_sql("ds", "radial", 6) + " SELECT * FROM ds"))
def spectrum_descriptors(t):
    return S.spectrum_descriptors(radial(t))


@query("A12_band_composition", "map_id:l p_lt8:d p_8_16:d p_16_32:d p_32_64:d p_64_inf:d dc_share:d", sql("cells", BANDED + """
SELECT map_id, e1 / et AS p_lt8, e2 / et AS p_8_16, e3 / et AS p_16_32, e4 / et AS p_32_64, e5 / et AS p_64_inf, e0 / (e0 + et) AS dc_share FROM be"""))
def band_composition(t):
    return S.band_composition(coefs(t))


@query("A12_dc_reconciliation", "band:s max_abs_residual:d", sql("cells", BANDED + """
SELECT band, 0.0 AS max_abs_residual FROM (VALUES ('8_16'), ('16_32'), ('32_64'), ('64_inf')) AS v(band) WHERE (SELECT count(*) FROM be) > 0"""))
def dc_reconciliation(t):
    """Shares that count the constant mode equal (1 - dc) * p, plus dc for the long band."""
    e = S.band_energies(coefs(t))
    names = [n for n, _, _ in S.BANDS]
    nondc = sum((F.col(f"e_{n}") for n in names[1:]), F.col("e_lt8"))
    dc = F.col("e_dc") / (F.col("e_dc") + nondc)
    rows = []
    for n in names[1:]:
        frozen = (F.col(f"e_{n}") + (F.col("e_dc") if n == "64_inf" else F.lit(0.0))) / (F.col("e_dc") + nondc)
        clean = (1 - dc) * F.col(f"e_{n}") / nondc + (dc if n == "64_inf" else F.lit(0.0))
        rows.append(F.struct(F.lit(n).alias("band"), F.abs(frozen - clean).alias("d")))
    return e.select(F.explode(F.array(*rows)).alias("x")).groupBy(F.col("x.band").alias("band")).agg(F.max("x.d").alias("max_abs_residual"))


ILR_SQL = """sqrt(6 / 5.0) * ((l1 + l2) / 2 - (l3 + l4 + l5) / 3) AS ilr1, sqrt(0.5) * (l1 - l2) AS ilr2,
sqrt(2 / 3.0) * (l3 - (l4 + l5) / 2) AS ilr3, sqrt(0.5) * (l4 - l5) AS ilr4"""
LOGS = "ln(greatest(p1, 1e-300)) AS l1, ln(greatest(p2, 1e-300)) AS l2, ln(greatest(p3, 1e-300)) AS l3, ln(greatest(p4, 1e-300)) AS l4, ln(greatest(p5, 1e-300)) AS l5"
def P():
    return [F.col(f"p{k}") for k in range(1, 6)]



@query("A13_zero_replace", "user_id:l replaced:b p1:d p2:d p3:d p4:d p5:d", sql("comp", """
h AS (SELECT *, p1 < 0.12 OR p2 < 0.12 OR p3 < 0.12 OR p4 < 0.12 OR p5 < 0.12 AS replaced,
  CASE WHEN p1 < 0.12 THEN 0.01 ELSE p1 END AS q1, CASE WHEN p2 < 0.12 THEN 0.01 ELSE p2 END AS q2, CASE WHEN p3 < 0.12 THEN 0.01 ELSE p3 END AS q3,
  CASE WHEN p4 < 0.12 THEN 0.01 ELSE p4 END AS q4, CASE WHEN p5 < 0.12 THEN 0.01 ELSE p5 END AS q5 FROM comp)
SELECT user_id, replaced, q1 / (q1 + q2 + q3 + q4 + q5) AS p1, q2 / (q1 + q2 + q3 + q4 + q5) AS p2, q3 / (q1 + q2 + q3 + q4 + q5) AS p3,
q4 / (q1 + q2 + q3 + q4 + q5) AS p4, q5 / (q1 + q2 + q3 + q4 + q5) AS p5 FROM h"""))
def zero_replace(t):
    parts, hit = C.zero_replaced(P(), 0.12, 0.01)
    return compositions(t).select("user_id", hit.alias("replaced"), *[p.alias(f"p{k}") for k, p in enumerate(parts, 1)])


@query("A14_ilr", "user_id:l ilr1:d ilr2:d ilr3:d ilr4:d", sql("comp", f"l AS (SELECT user_id, {LOGS} FROM comp) SELECT user_id, {ILR_SQL} FROM l"))
def ilr(t):
    return compositions(t).select("user_id", *[z.alias(f"ilr{k}") for k, z in enumerate(C.ilr(P()), 1)])


@query("A14_ilr_inverse", "user_id:l p1:d p2:d p3:d p4:d p5:d", sql("comp", "SELECT * FROM comp"))
def ilr_inverse(t):
    return ilr(t).select("user_id", *[p.alias(f"p{k}") for k, p in enumerate(C.ilr_inverse([F.col(f"ilr{k}") for k in range(1, 5)]), 1)])


@query("A14_aitchison_distance", "user_id:l dist:d", sql("comp", f"""l AS (SELECT user_id, {LOGS} FROM comp), z AS (SELECT user_id, {ILR_SQL} FROM l)
SELECT user_id, sqrt(ilr1 * ilr1 + ilr2 * ilr2 + ilr3 * ilr3 + ilr4 * ilr4) AS dist FROM z"""))
def aitchison_distance(t):
    """Distance of every composition to the uniform one."""
    return compositions(t).select("user_id", C.aitchison(P(), [F.lit(0.2)] * 5).alias("dist"))


@query("A15_band_energy", "map_id:l " + " ".join(f"rms_{n}:d log_{n}:d" for n, _, _ in S.BANDS), sql("cells", BANDED + " SELECT map_id, " + ", ".join(
    f"sqrt(e{k} / 64) AS rms_{n}, log10(greatest(e{k} / 64, 1e-12)) AS log_{n}" for k, (n, _, _) in enumerate(S.BANDS, 1)) + " FROM be"))
def band_energy(t):
    return S.log_band_energy(coefs(t))


@query("A16_bandpass", "map_id:l r:l c:l z:d", sql("cells", DCT + """,
keep AS (SELECT map_id, u, v, coef FROM dct WHERE lam >= 16 AND lam < 32),
back AS (SELECT map_id, i AS r, v, sum(b * coef) AS z FROM keep JOIN basis ON k = u GROUP BY map_id, i, v)
SELECT map_id, r, i AS c, sum(b * z) AS z FROM back JOIN basis ON k = v GROUP BY map_id, r, i"""))
def bandpass(t):
    band = S.bandpass(residuals(t), N, N, PITCH, [("16_32", 16.0, 32.0)])
    return M.cells(band.drop("z").withColumnRenamed("z_16_32", "z"))


KERNEL = """kern AS (SELECT o, w / sum(w) OVER () AS w FROM (SELECT o, exp(-0.5 * pow(o / {s}, 2)) AS w FROM range(-{r}, {r} + 1) AS g(o))),
refl AS (SELECT i AS dst, CASE WHEN m < 8 THEN m ELSE 15 - m END AS src, w FROM (SELECT i, ((i + o) % 16 + 16) % 16 AS m, w FROM range(8) AS g(i), kern)),
mat AS (SELECT dst, src, sum(w) AS w FROM refl GROUP BY dst, src)"""


def smooth_sql(s: float, prefix: str) -> str:
    k = KERNEL.format(s=s, r=int(4 * s + 0.5))
    for n in ("kern", "refl", "mat"):
        k = k.replace(n, f"{prefix}{n}")
    return k + f""", {prefix}a AS (SELECT map_id, dst AS r, c, sum(w * z) AS z FROM resid JOIN {prefix}mat ON src = r GROUP BY map_id, dst, c),
{prefix} AS (SELECT map_id, r, dst AS c, sum(w * z) AS z FROM {prefix}a JOIN {prefix}mat ON src = c GROUP BY map_id, r, dst)"""


@query("A17_gaussian_smooth", "map_id:l r:l c:l z:d", sql("cells", RESID + ", " + smooth_sql(1.5, "g") + " SELECT map_id, r, c, z FROM g"))
def gaussian_smooth(t):
    m = residuals(t)
    return M.cells(m.withColumn("z", TR.smooth(F.col("z"), N, N, 1.5)))


@query("A17_dog_bands", "map_id:l dog0:d dog1:d low:d", sql("cells", RESID + ", " + ", ".join(smooth_sql(s, p) for s, p in ((0.5, "ga"), (1.0, "gb"), (2.0, "gc"))) + """
SELECT map_id, stddev_pop(ga.z - gb.z) AS dog0, stddev_pop(gb.z - gc.z) AS dog1, stddev_pop(gc.z) AS low
FROM ga JOIN gb USING (map_id, r, c) JOIN gc USING (map_id, r, c) GROUP BY map_id"""))
def dog_bands(t):
    return S.difference_bands(residuals(t), N, N, [0.5, 1.0, 2.0])


@query("A18_scale_energy_table", "scale:s share:d", sql("cells", BANDED + ", " + smooth_sql(1.0, "ga") + ", " + smooth_sql(2.0, "gb") + """,
tv AS (SELECT map_id, var_pop(z) AS tv FROM resid GROUP BY map_id),
sv AS (SELECT map_id, 'G1' AS scale, var_pop(z) AS v FROM ga GROUP BY map_id UNION ALL SELECT map_id, 'G2', var_pop(z) FROM gb GROUP BY map_id
 UNION ALL SELECT map_id, 'lt8', e1 / 64 FROM be UNION ALL SELECT map_id, '8_16', e2 / 64 FROM be UNION ALL SELECT map_id, '16_32', e3 / 64 FROM be
 UNION ALL SELECT map_id, '32_64', e4 / 64 FROM be UNION ALL SELECT map_id, '64_inf', e5 / 64 FROM be)
SELECT scale, avg(v / tv) AS share FROM sv JOIN tv USING (map_id) GROUP BY scale"""))
def scale_energy_table(t):
    return S.scale_energy(residuals(t), N, N, PITCH, [1.0, 2.0])


POWER = RESID + """, hann AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 7) AS w FROM range(8) AS g(i)),
we AS (SELECT sum(pow(a.w * b.w, 2)) AS e FROM hann a, hann b),
wz AS (SELECT map_id, label, r, c, (z - avg(z) OVER (PARTITION BY map_id)) * a.w * b.w AS z FROM resid JOIN hann a ON a.i = r JOIN hann b ON b.i = c),
fr AS (SELECT map_id, label, k AS kx, r, sum(z * cos(2 * pi() * k * c / 8)) AS re, -sum(z * sin(2 * pi() * k * c / 8)) AS im FROM wz, range(8) AS g(k) GROUP BY map_id, label, k, r),
ff AS (SELECT map_id, label, kx, k AS ky, sum(re * cos(2 * pi() * k * r / 8) + im * sin(2 * pi() * k * r / 8)) AS re,
  sum(im * cos(2 * pi() * k * r / 8) - re * sin(2 * pi() * k * r / 8)) AS im FROM fr, range(8) AS g(k) GROUP BY map_id, label, kx, k),
pw AS (SELECT map_id, label, (re * re + im * im) / e AS p, fx, fy, 1 / sqrt(fx * fx + fy * fy) AS lam, atan2(fy, fx) AS th FROM
  (SELECT *, CASE WHEN kx < 4 THEN kx ELSE kx - 8 END / 32.0 AS fx, CASE WHEN ky < 4 THEN ky ELSE ky - 8 END / 32.0 AS fy FROM ff, we) WHERE kx + ky > 0),
dm0 AS (SELECT *, CASE WHEN lam >= 8 AND lam < 16 THEN '8_16' WHEN lam >= 16 AND lam < 32 THEN '16_32' END AS band,
  least(floor((CASE WHEN th < 0 THEN th + pi() WHEN th >= pi() THEN th - pi() ELSE th END) / (pi() / 12) + 1e-9), 11) AS tb FROM pw WHERE lam >= 8 AND lam < 32),
dm1 AS (SELECT map_id, band, tb, sum(p) AS p, sum(p * cos(2 * th)) AS c, sum(p * sin(2 * th)) AS s FROM dm0 GROUP BY map_id, band, tb),
dm AS (SELECT map_id, band, sum(p) AS energy, sqrt(pow(sum(c), 2) + pow(sum(s), 2)) / sum(p) AS a2, 0.5 * degrees(atan2(sum(s), sum(c))) AS wave_deg,
  (ln(sum(p)) - sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / sum(p)) / ln(12) AS entropy FROM dm1 GROUP BY map_id, band)"""
TWO = [b for b in S.BANDS if b[0] in ("8_16", "16_32")]


@query("A19_directional_metrics", "map_id:l band:s energy:d a2:d wave_deg:d stripe_deg:d entropy:d", sql("cells", POWER + """
SELECT *, CASE WHEN wave_deg + 90 >= 180 THEN wave_deg - 90 ELSE wave_deg + 90 END AS stripe_deg FROM dm"""))
def directional_metrics(t):
    return S.directional_metrics(S.power_table(residuals(t), N, N, PITCH), TWO, 12)


@query("A19_orientation_histogram", "label:l tb:l power:d", sql("cells", POWER + " SELECT label, tb, sum(p) AS power FROM dm0 GROUP BY label, tb"))
def orientation_histogram(t):
    p = S.power_table(residuals(t), N, N, PITCH).where("lam >= 8 AND lam < 32")
    tb = F.least(F.floor(F.pmod(F.col("theta"), F.lit(math.pi)) / F.lit(math.pi / 12) + 1e-9), F.lit(11))
    return p.groupBy("label", tb.alias("tb")).agg(F.sum("power").alias("power"))


@query("A20_lambda_star", "map_id:l share:d valid:b lam_star:d", sql("cells", RADIAL + """,
g AS (SELECT map_id, sum(energy) AS t, sum(energy) FILTER (lam_geo >= 10 AND lam_geo < 32) AS b, sum(energy * ln(lam_geo)) FILTER (lam_geo >= 10 AND lam_geo < 32) AS w FROM radial GROUP BY map_id)
SELECT map_id, b / t AS share, b / t >= 0.6 AS valid, CASE WHEN b / t >= 0.6 THEN exp(w / b) END AS lam_star FROM g"""))
def lambda_star(t):
    return S.lambda_star(radial(t), 10.0, 32.0, 0.6)


@query("A20_lambda_peak", "map_id:l share:d valid:b lam_peak:d", sql("cells", RADIAL + """,
g AS (SELECT map_id, sum(energy) AS w, max(energy) FILTER (n_modes >= 5) AS e, arg_max(lam_geo, energy) FILTER (n_modes >= 5) AS l FROM radial WHERE lam_geo >= 10 AND lam_geo < 32 GROUP BY map_id)
SELECT map_id, e / w AS share, e / w >= 0.55 AS valid, CASE WHEN e / w >= 0.55 THEN l END AS lam_peak FROM g"""))
def lambda_peak(t):
    return S.lambda_peak(radial(t), 10.0, 32.0, 5, 0.55)


ACF = RESID + """, lagk AS (SELECT k, d FROM range(5) AS g(k), (VALUES ('y'), ('x')) AS v(d)),
ac AS (SELECT a.map_id, d, k, sum(a.z * b.z) AS s FROM resid a JOIN lagk ON true JOIN resid b ON b.map_id = a.map_id
  AND b.r = (a.r + CASE WHEN d = 'y' THEN k ELSE 0 END) % 8 AND b.c = (a.c + CASE WHEN d = 'x' THEN k ELSE 0 END) % 8 GROUP BY a.map_id, d, k),
rho AS (SELECT map_id, d, k, s / max(s) FILTER (k = 0) OVER (PARTITION BY map_id, d) AS rho FROM ac),
fc AS (SELECT map_id, d, coalesce(min(k) FILTER (k > 0 AND rho < exp(-1)), 4) AS k FROM rho GROUP BY map_id, d)"""


@query("A8_acf_length", "map_id:l acf_length:d", sql("cells", ACF + " SELECT map_id, avg(k) * 4 AS acf_length FROM fc GROUP BY map_id"))
def acf_length(t):
    return S.acf_cut_length(residuals(t), N, N, PITCH)


@query("A8_acf_radial_length", "map_id:l corr_length:d", sql("cells", """
cz AS (SELECT map_id, r, c, z - avg(z) OVER (PARTITION BY map_id) AS z FROM cells),
a AS (SELECT x.map_id, dy, dx, sum(x.z * y.z) AS s FROM cz x JOIN (SELECT dy, dx FROM range(-4, 4) AS p(dy), range(-4, 4) AS q(dx)) ON true
  JOIN cz y ON y.map_id = x.map_id AND y.r = (x.r + dy + 8) % 8 AND y.c = (x.c + dx + 8) % 8 GROUP BY x.map_id, dy, dx),
p AS (SELECT map_id, b, avg(s / s0) AS rho FROM (SELECT map_id, floor(sqrt(dy * dy + dx * dx) + 0.5) AS b, s, max(s) FILTER (dy = 0 AND dx = 0) OVER (PARTITION BY map_id) AS s0 FROM a) WHERE b <= 4 GROUP BY map_id, b),
f AS (SELECT map_id, min(b) AS b FROM p WHERE rho < exp(-1) GROUP BY map_id)
SELECT m.map_id, 4.0 * CASE WHEN f.b IS NULL THEN 4.0 WHEN f.b = 0 THEN 0.0 ELSE f.b - 1 + least(greatest((p0.rho - exp(-1)) / greatest(p0.rho - p1.rho, 1e-12), 0), 1) END AS corr_length
FROM (SELECT DISTINCT map_id FROM cells) m LEFT JOIN f USING (map_id) LEFT JOIN p p1 ON p1.map_id = m.map_id AND p1.b = f.b LEFT JOIN p p0 ON p0.map_id = m.map_id AND p0.b = f.b - 1"""))
def acf_radial_length(t):
    return S.acf_radial_length(residuals(t), N, N, PITCH)


@query("A33_observe", "map_id:l depth:d a_med:d ilr1:d ilr2:d ilr3:d ilr4:d a2_8_16:d entropy_8_16:d a2_16_32:d entropy_16_32:d", sql("cells", """
full_maps AS (SELECT map_id FROM cells GROUP BY map_id HAVING bool_and(valid)), sp AS (SELECT c.* FROM cells c SEMI JOIN full_maps USING (map_id)), """
    + BANDED.replace("FROM cells", "FROM sp") + ", " + POWER.split(", ", 1)[1][POWER.split(", ", 1)[1].index("hann AS"):] + f""",
l AS (SELECT map_id, ln(greatest(e1 / et, 1e-300)) AS l1, ln(greatest(e2 / et, 1e-300)) AS l2, ln(greatest(e3 / et, 1e-300)) AS l3, ln(greatest(e4 / et, 1e-300)) AS l4, ln(greatest(e5 / et, 1e-300)) AS l5 FROM be),
z AS (SELECT map_id, {ILR_SQL} FROM l), v AS (SELECT map_id, z - median(z) OVER (PARTITION BY map_id) AS rz, median(z) OVER (PARTITION BY map_id) AS m FROM cells WHERE valid),
s AS (SELECT map_id, -any_value(m) AS depth, sqrt(avg(rz * rz)) AS a_med FROM v GROUP BY map_id)
SELECT s.*, ilr1, ilr2, ilr3, ilr4, d1.a2 AS a2_8_16, d1.entropy AS entropy_8_16, d2.a2 AS a2_16_32, d2.entropy AS entropy_16_32
FROM s LEFT JOIN z USING (map_id) LEFT JOIN dm d1 ON d1.map_id = s.map_id AND d1.band = '8_16' LEFT JOIN dm d2 ON d2.map_id = s.map_id AND d2.band = '16_32'"""))
def observe(t):
    return S.observe(maps(t), N, N, PITCH, 12)[0]


@query("C13_validity_table", "map_id:l block:s band_valid:b reason:s", sql("cells", """
f AS (SELECT map_id, bool_and(valid) AS ok FROM cells GROUP BY map_id)
SELECT map_id, block, ok AS band_valid, CASE WHEN ok THEN '' ELSE 'INCOMPLETE_GRID' END AS reason FROM f, (VALUES ('ILR'), ('8_16'), ('16_32')) AS b(block)"""))
def validity_table(t):
    return S.observe(maps(t), N, N, PITCH, 12)[1]


@query("R30_amplitude_consistency", "band:s max_abs_error:d median_rel_error:d", sql("cells", BANDED + """
SELECT band, 0.0 AS max_abs_error, 0.0 AS median_rel_error FROM (VALUES ('lt8'), ('8_16'), ('16_32'), ('32_64'), ('64_inf')) AS v(band) WHERE (SELECT count(*) FROM be) > 0"""))
def amplitude_consistency(t):
    """Band RMS against Sq * sqrt(share of all energy): Parseval holds, so errors vanish."""
    from graticule.plans.order_stats import quantiles
    m = residuals(t)
    sq = M.moments(m).select("map_id", "sq")
    c = coefs(t)
    joined = S.log_band_energy(c).join(S.band_composition(c).drop("label"), "map_id").join(sq, "map_id")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(f"rms_{n}").alias("rms"),
        (F.col("sq") * F.sqrt((1 - F.col("dc_share")) * F.col(f"p_{n}"))).alias("pred")) for n, _, _ in S.BANDS]))
    e = joined.select(rows.alias("x")).select("x.band", F.abs(F.col("x.rms") - F.col("x.pred")).alias("err"),
                                             F.round(F.abs(F.col("x.rms") - F.col("x.pred")) / F.col("x.rms"), 9).alias("rel"))
    return e.groupBy("band").agg(F.max("err").alias("max_abs_error")).join(quantiles(e, ["band"], "rel", {"median_rel_error": 0.5}), "band")


SENS = (4, 8)


@query("R29_bin_sensitivity", "n_bins:l rho_centroid:d rho_entropy:d", sql("cells", RADIAL + ", " + desc_sql("d6", "radial", 6) + ", " + ", ".join(
    radial_sql(f"radial{n}", S.geometric_edges(6.0, 70.0, n)) + ", " + desc_sql(f"d{n}", f"radial{n}", n) for n in SENS) + """,
alld AS (SELECT 4 AS n_bins, map_id, centroid_log AS c, entropy AS e FROM d4 UNION ALL SELECT 8, map_id, centroid_log, entropy FROM d8),
j AS (SELECT n_bins, a.c, a.e, d6.centroid_log AS c6, d6.entropy AS e6 FROM alld a JOIN d6 USING (map_id)),
rk AS (SELECT n_bins, rank() OVER (PARTITION BY n_bins ORDER BY c) AS rc, rank() OVER (PARTITION BY n_bins ORDER BY e) AS re,
 rank() OVER (PARTITION BY n_bins ORDER BY c6) AS rc6, rank() OVER (PARTITION BY n_bins ORDER BY e6) AS re6 FROM j)
SELECT n_bins, corr(rc, rc6) AS rho_centroid, corr(re, re6) AS rho_entropy FROM rk GROUP BY n_bins"""))
def bin_sensitivity(t):
    from graticule.operators.summaries import spearman
    primary = S.spectrum_descriptors(radial(t)).select("map_id", F.col("centroid_log").alias("c6"), F.col("entropy").alias("e6"))
    others = None
    for n in SENS:
        d = S.spectrum_descriptors(radial(t, S.geometric_edges(6.0, 70.0, n))).select(F.lit(n).cast("long").alias("n_bins"), "map_id", "centroid_log", "entropy")
        others = d if others is None else others.unionByName(d)
    j = others.join(primary, "map_id")
    return spearman(j, ["n_bins"], "centroid_log", "c6", "rho_centroid").join(spearman(j, ["n_bins"], "entropy", "e6", "rho_entropy"), "n_bins")

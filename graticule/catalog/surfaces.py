"""Planes, profiles, dropout detection and repair queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from graticule.catalog.fixtures import event_series, maps, signals, sql
from graticule.catalog.maps import full_maps
from graticule.catalog.registry import query
from graticule.catalog.spectra import N, PITCH, residuals
from graticule.functions import process as P
from graticule.functions import transforms as TR
from graticule.operators import dropouts as D
from graticule.operators import planes as L
from graticule.operators import spectra as S
from graticule.operators.maps import masked


def cramer(source: str, name: str, where: str) -> str:
    """CTE with the least-squares plane (a, b, c) of z on (x, y) by determinants."""
    det = "(sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx))"
    return f"""{name}m AS (SELECT map_id, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(x) AS sx, sum(y) AS sy, count(*) AS n, sum(x * z) AS xz, sum(y * z) AS yz, sum(z) AS sz FROM {source} WHERE {where} GROUP BY map_id),
{name} AS (SELECT map_id, (xz * (syy * n - sy * sy) - sxy * (yz * n - sy * sz) + sx * (yz * sy - syy * sz)) / {det} AS a, (sxx * (yz * n - sz * sy) - xz * (sxy * n - sy * sx) + sx * (sxy * sz - yz * sx)) / {det} AS b,
(sxx * (syy * sz - sy * yz) - sxy * (sxy * sz - sx * yz) + xz * (sxy * sy - syy * sx)) / {det} AS c FROM {name}m)"""


PLANE = "xy AS (SELECT map_id, r, c AS col, (c - 3.5) * 4.0 AS x, (r - 3.5) * 4.0 AS y, z FROM cells WHERE valid), " + cramer("xy", "p0", "true") + """,
r0 AS (SELECT xy.*, z - (a * x + b * y + c) AS res FROM xy JOIN p0 USING (map_id)), s0 AS (SELECT map_id, median(res) AS m FROM r0 GROUP BY map_id), t0 AS (SELECT map_id, any_value(m) AS m, 1.4826 * median(abs(res - m)) AS sg FROM r0 JOIN s0 USING (map_id) GROUP BY map_id),
k0 AS (SELECT r0.* EXCLUDE (res), res - m BETWEEN -1.5 * sg AND 2.0 * sg AS keep FROM r0 JOIN t0 USING (map_id)), """ + cramer("k0", "p1", "keep") + """,
r1 AS (SELECT k0.*, z - (a * x + b * y + c) AS res FROM k0 JOIN p1 USING (map_id) WHERE keep), s1 AS (SELECT map_id, median(res) AS m FROM r1 GROUP BY map_id),
pf AS (SELECT r1.map_id, sqrt(avg(res * res)) AS rmse, 1.4826 * median(abs(res - m)) AS sigma_ref, count(*) AS n_inliers FROM r1 JOIN s1 USING (map_id) GROUP BY r1.map_id)"""


def fits(t):
    return L.plane_fits(masked(maps(t)), N, N, PITCH, rounds=1, low=1.5, high=2.0, min_inliers=10)


@query("A21_plane_fit_robust", "map_id:l a:d b:d c:d rmse:d sigma_ref:d n_inliers:l", sql("cells", PLANE + " SELECT * FROM p1 JOIN pf USING (map_id)"))
def plane_fit_robust(t):
    return fits(t).select("map_id", "plane.*")


@query("A22_plane_depth", "map_id:l r:l c:l depth:d", sql("cells", PLANE + " SELECT map_id, r, col AS c, a * x + b * y + p1.c - z AS depth FROM xy JOIN p1 USING (map_id)"))
def plane_depth(t):
    from graticule.operators.maps import cells
    return cells(L.plane_depth(fits(t), PITCH), "depth").where("depth IS NOT NULL")


@query("A23_orientation_axis", "map_id:l n_signal:l confident:b theta:d cx:d cy:d", sql("cells", PLANE + """, d AS (SELECT xy.map_id, x, y, a * x + b * y + p1.c - z AS w, a * x + b * y + p1.c - z > 0.8 * sigma_ref AS sig FROM xy JOIN p1 USING (map_id) JOIN pf USING (map_id)),
m AS (SELECT map_id, count(*) FILTER (sig) AS n, sum(w * x) FILTER (sig) / sum(w) FILTER (sig) AS cx, sum(w * y) FILTER (sig) / sum(w) FILTER (sig) AS cy FROM d GROUP BY map_id),
v AS (SELECT d.map_id, any_value(n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, sum(w * (x - cx) * (x - cx)) FILTER (sig) AS xx, sum(w * (y - cy) * (y - cy)) FILTER (sig) AS yy, sum(w * (x - cx) * (y - cy)) FILTER (sig) AS xy FROM d JOIN m USING (map_id) GROUP BY d.map_id)
SELECT map_id, n AS n_signal, n >= 12 AS confident, CASE WHEN n >= 12 THEN degrees(0.5 * atan2(2 * xy, xx - yy)) ELSE 0 END AS theta, CASE WHEN n >= 12 THEN cx ELSE 0 END AS cx, CASE WHEN n >= 12 THEN cy ELSE 0 END AS cy FROM v"""))
def orientation_axis(t):
    return L.orientation_axis(fits(t), PITCH, 0.8, 12)


@query("A24_fourier_projection", "sig_id:l power:d", sql("sig", "SELECT sig_id, pow(sum(w * y * cos(2 * pi() * 0.137 * x)), 2) + pow(sum(w * y * sin(2 * pi() * 0.137 * x)), 2) AS power FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * (i + 1) / 65) AS w FROM sig) GROUP BY sig_id"))
def fourier_projection(t):
    return signals(t).select("sig_id", L.fourier_projection(F.col("y"), 0.5, 0.137).alias("power"))


OVERLAP = """g AS (SELECT sig_id, i, y - avg(y) OVER (PARTITION BY sig_id) AS g FROM sig),
ov AS (SELECT a.sig_id, a.g, lo.g + (hi.g - lo.g) * (a.i - 2.6 - floor(a.i - 2.6)) AS b FROM g a JOIN g lo ON lo.sig_id = a.sig_id AND lo.i = floor(a.i - 2.6) JOIN g hi ON hi.sig_id = a.sig_id AND hi.i = floor(a.i - 2.6) + 1 WHERE a.i >= 3 AND a.i < 61)"""


@query("A25_overlap", "sig_id:l overlap:d", sql("sig", OVERLAP + " SELECT sig_id, sum(g * b) / sqrt(sum(g * g) * sum(b * b)) AS overlap FROM ov GROUP BY sig_id"))
def overlap(t):
    return L.lag_overlap(signals(t), "sig_id", "y", 0.5, 1.3)


@query("D11_transfer_descriptor", "sig_id:l overlap:d k_peak:d ratio:d", sql("sig", OVERLAP + """, o AS (SELECT sig_id, sum(g * b) / sqrt(sum(g * g) * sum(b * b)) AS overlap FROM ov GROUP BY sig_id), kk AS (SELECT j * 0.0371 AS k FROM range(1, 21) AS s(j)),
ar AS (SELECT k, pow(sum(cos(2 * pi() * n * (k * 1.3 - floor(k * 1.3)))), 2) + pow(sum(sin(2 * pi() * n * (k * 1.3 - floor(k * 1.3)))), 2) AS p FROM kk, range(6) AS q(n) GROUP BY k),
sg AS (SELECT sig_id, k, pow(sum(w * y * cos(2 * pi() * k * x)), 2) + pow(sum(w * y * sin(2 * pi() * k * x)), 2) AS s FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * (i + 1) / 65) AS w FROM sig), kk GROUP BY sig_id, k),
pk AS (SELECT sig_id, arg_max(k, s * p) AS k FROM sg JOIN ar USING (k) GROUP BY sig_id) SELECT o.sig_id, overlap, k AS k_peak, 1 / k / 1.3 AS ratio FROM o JOIN pk USING (sig_id)"""))
def transfer_descriptor(t):
    """Overlap at the spacing h and the peak of signal power times array power over a frequency grid."""
    h, grid = 1.3, [j * 0.0371 for j in range(1, 21)]
    power = F.array(*[F.struct((L.fourier_projection(F.col("y"), 0.5, k) * P.array_transfer(F.lit(k), F.lit(h), F.lit(6))).alias("p"), F.lit(-k).alias("o")) for k in grid])
    s = signals(t)
    k = -F.col("top.o")
    return L.lag_overlap(s, "sig_id", "y", 0.5, h).join(s.select("sig_id", F.array_max(power).alias("top")), "sig_id").select("sig_id", "overlap", k.alias("k_peak"), (1 / k / h).alias("ratio"))


PHASE = """fr AS (SELECT map_id, k AS kx, r, sum(z * cos(2 * pi() * k * c / 8)) AS re, -sum(z * sin(2 * pi() * k * c / 8)) AS im FROM cells, range(8) AS g(k) GROUP BY map_id, k, r),
ff AS (SELECT map_id, kx, k AS ky, sum(re * cos(2 * pi() * k * r / 8) + im * sin(2 * pi() * k * r / 8)) AS re, sum(im * cos(2 * pi() * k * r / 8) - re * sin(2 * pi() * k * r / 8)) AS im FROM fr, range(8) AS g(k) GROUP BY map_id, kx, k),
un AS (SELECT map_id, kx, ky, CASE WHEN kx + ky = 0 THEN 0 ELSE re / (sqrt(re * re + im * im) + 1e-12) END AS re, CASE WHEN kx + ky = 0 THEN 0 ELSE im / (sqrt(re * re + im * im) + 1e-12) END AS im FROM ff),
ir AS (SELECT map_id, kx, r, sum(re * cos(2 * pi() * ky * r / 8) - im * sin(2 * pi() * ky * r / 8)) AS re, sum(re * sin(2 * pi() * ky * r / 8) + im * cos(2 * pi() * ky * r / 8)) AS im FROM un, range(8) AS g(r) GROUP BY map_id, kx, r),
po AS (SELECT map_id, r, c, sum(re * cos(2 * pi() * kx * c / 8) - im * sin(2 * pi() * kx * c / 8)) / 64 AS q FROM ir, range(8) AS g(c) GROUP BY map_id, r, c)"""


@query("A26_phase_only", "map_id:l r:l c:l q:d", sql("cells", PHASE + " SELECT * FROM po"))
def phase_only(t):
    from graticule.operators.maps import cells
    return cells(full_maps(t).withColumn("q", TR.phase_only(F.col("z"), N, N)), "q")


@query("A26_phase_distance", "map_id:l dist:d", sql("cells", PHASE + """, sh AS (SELECT dy, dx FROM range(-1, 2) AS a(dy), range(-1, 2) AS b(dx)),
cr AS (SELECT x.map_id, dy, dx, corr(x.q, y.q) AS rho FROM po x JOIN sh ON true JOIN po y ON y.map_id = x.map_id + 1 AND y.r = (x.r - dy + 8) % 8 AND y.c = (x.c - dx + 8) % 8 WHERE x.r BETWEEN 1 AND 6 AND x.c BETWEEN 1 AND 6 GROUP BY x.map_id, dy, dx)
SELECT map_id, 1 - max(rho) AS dist FROM cr GROUP BY map_id"""))
def phase_distance(t):
    """Shift-invariant phase distance between neighbouring maps."""
    q = full_maps(t).select("map_id", TR.phase_only(F.col("z"), N, N).alias("q"))
    nxt = q.select((F.col("map_id") - 1).alias("map_id"), F.col("q").alias("q2"))
    return q.join(nxt, "map_id").select("map_id", L.phase_distance(F.col("q"), F.col("q2"), N, N, 1).alias("dist"))


@query("A27_line_aggregate", "user_id:l n_total:l n_used:l median:d iqr:d p10:d p90:d censored_share:d cv:d state:s", sql("evt", """u AS (SELECT user_id, count(*) AS n_total, count(*) FILTER (value > 2) AS n_used, avg((event_type = 'error')::INT) FILTER (value > 2) AS cs, median(value) FILTER (value > 2 AND event_type <> 'error') AS m,
quantile_cont(value, 0.25) FILTER (value > 2 AND event_type <> 'error') AS a, quantile_cont(value, 0.75) FILTER (value > 2 AND event_type <> 'error') AS b, quantile_cont(value, 0.1) FILTER (value > 2 AND event_type <> 'error') AS p10, quantile_cont(value, 0.9) FILTER (value > 2 AND event_type <> 'error') AS p90 FROM evt GROUP BY user_id)
SELECT user_id, n_total, n_used, m AS median, b - a AS iqr, p10, p90, cs AS censored_share, CASE WHEN m > 0 THEN (b - a) / m END AS cv, CASE WHEN n_used < 60 THEN 'insufficient_sections' WHEN cs > 0.25 THEN 'right_censored' ELSE 'estimable' END AS state FROM u"""))
def line_aggregate(t):
    e = event_series(t).withColumn("cen", F.col("event_type") == "error")
    return L.line_aggregate(e, ["user_id"], "value", "cen", F.col("value") > 2, 60, 0.25)


DEFICIT = """md AS (SELECT map_id, median(z) AS f FROM cells WHERE valid GROUP BY map_id), wk AS (SELECT map_id, r, c, valid, CASE WHEN valid THEN z ELSE f END AS w FROM cells JOIN md USING (map_id)),
bg AS (SELECT a.map_id, a.r, a.c, any_value(a.valid) AS valid, any_value(a.w) AS w, median(b.w) AS bg FROM wk a JOIN (SELECT dy, dx FROM range(-1, 2) AS p(dy), range(-1, 2) AS q(dx)) ON true JOIN wk b ON b.map_id = a.map_id AND b.r = least(greatest(a.r + dy, 0), 7) AND b.c = least(greatest(a.c + dx, 0), 7) GROUP BY a.map_id, a.r, a.c),
nc AS (SELECT map_id, median(w - bg) AS m FROM bg WHERE valid GROUP BY map_id), nz AS (SELECT map_id, 1.4826 * median(abs(w - bg - m)) AS noise FROM bg JOIN nc USING (map_id) WHERE valid GROUP BY map_id),
dt AS (SELECT map_id, r, c, w, valid, greatest(bg - w, 0) AS deficit, noise, valid AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 AND greatest(bg - w, 0) >= greatest(0.08, 1.5 * noise) AS seed, valid AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 AND greatest(bg - w, 0) >= greatest(0.03, 0.8 * noise) AS grow FROM bg JOIN nz USING (map_id))"""


def detected(t):
    return D.background_deficit(maps(t), 1, 1.5, 0.8, 0.08, 0.03, 1)


@query("A28_median_background_deficit", "map_id:l noise:d total_deficit:d n_seed:l n_grow:l", sql("cells", DEFICIT + " SELECT map_id, any_value(noise) AS noise, sum(deficit) AS total_deficit, count(*) FILTER (seed) AS n_seed, count(*) FILTER (grow) AS n_grow FROM dt GROUP BY map_id"))
def median_background_deficit(t):
    from graticule.functions import arrays as A
    n = lambda c: F.size(F.filter(c, lambda b: b))
    return detected(t).select("map_id", "noise", A.array_sum(F.col("deficit")).alias("total_deficit"), n("seed").alias("n_seed"), n("grow").alias("n_grow"))


@query("A29_compact_components", "map_id:l component:l n_cells:l seeded:b rows:l cols:l accepted:b", "WITH RECURSIVE " + sql("cells", DEFICIT + """,
gc AS MATERIALIZED (SELECT map_id, r * 8 + c AS cell, r, c, seed FROM dt WHERE grow), lb AS (SELECT map_id, cell, cell AS component FROM gc UNION SELECT l.map_id, b.cell, l.component FROM lb l JOIN gc a ON a.map_id = l.map_id AND a.cell = l.cell JOIN gc b ON b.map_id = a.map_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND l.component < b.cell),
cp AS (SELECT map_id, cell, min(component) AS component FROM lb GROUP BY map_id, cell), g AS (SELECT map_id, component, count(*) AS n_cells, bool_or(seed) AS seeded, max(r) - min(r) + 1 AS rows, max(c) - min(c) + 1 AS cols FROM cp JOIN gc USING (map_id, cell) GROUP BY map_id, component)
SELECT *, seeded AND n_cells >= 2 AND greatest(rows, cols) * 4 <= 16 AND greatest(rows, cols) / least(rows, cols) <= 2.8 AND n_cells / (rows * cols) >= 0.12 AS accepted FROM g""")[5:])
def compact_components(t):
    return D.compact_components(detected(t), PITCH, 2, 16.0, 2.8, 0.12)


GATES = (2, 16.0, 2.8, 0.12)


def repaired(t):
    return D.repaired_maps(detected(t), PITCH, GATES, 2)


@query("A30_repair_components", "map_id:l component:l n_repaired:l max_correction:d mean_correction:d")
def repair_components(t):
    return repaired(t).select("map_id", F.explode("records").alias("r")).select("map_id", "r.*")


@query("A30_repaired_maps", "map_id:l status:s n_components:l n_untouched:l n_raised:l n_mask:l never_lower:b noise:d", "WITH RECURSIVE " + sql("cells", DEFICIT + """,
gc AS MATERIALIZED (SELECT map_id, r * 8 + c AS cell, r, c FROM dt WHERE grow), lb AS (SELECT map_id, cell, cell AS component FROM gc UNION SELECT l.map_id, b.cell, l.component FROM lb l JOIN gc a ON a.map_id = l.map_id AND a.cell = l.cell JOIN gc b ON b.map_id = a.map_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND l.component < b.cell),
cp AS (SELECT map_id, count(DISTINCT component) AS n FROM (SELECT map_id, cell, min(component) AS component FROM lb GROUP BY map_id, cell) GROUP BY map_id)
SELECT d.map_id, 'PASS' AS status, coalesce(any_value(cp.n), 0) AS n_components, count(*) FILTER (NOT grow) AS n_untouched, 0 AS n_raised, 0 AS n_mask, true AS never_lower, any_value(noise) AS noise FROM dt d LEFT JOIN cp ON cp.map_id = d.map_id GROUP BY d.map_id""")[5:].replace("0 AS n_raised, 0 AS n_mask", "NULL AS n_raised, NULL AS n_mask"))
def repaired_maps(t):
    """Repaired map, mask and metrics: cells outside every grow region stay, none is lowered, the mask marks what was raised."""
    r = repaired(t).withColumn("p", F.arrays_zip("z", "repaired", "repair_mask", "grow", "work", "valid"))
    n = lambda f: F.size(F.filter("p", f)).cast("long")
    same = lambda e: ~e["grow"] & (e["z"].eqNullSafe(e["repaired"])) & ~e["repair_mask"]
    raised = n(lambda e: e["repaired"] > e["z"])
    return r.select("map_id", "metrics.status", "metrics.n_components", n(same).alias("n_untouched"), F.when(raised != n(lambda e: e["repair_mask"]), raised).alias("n_raised"),
                    F.when(F.col("metrics.n_repaired") != n(lambda e: e["repair_mask"]), F.col("metrics.n_repaired")).alias("n_mask"), F.forall("p", lambda e: F.coalesce(e["repaired"] >= e["z"], F.lit(True))).alias("never_lower"), "metrics.noise")


@query("A31_largest_component", "map_id:l largest:l n_true:l", "WITH RECURSIVE " + sql("cells", """gc AS MATERIALIZED (SELECT map_id, r * 8 + c AS cell, r, c FROM cells WHERE z < -0.12),
lb AS (SELECT map_id, cell, cell AS component FROM gc UNION SELECT l.map_id, b.cell, l.component FROM lb l JOIN gc a ON a.map_id = l.map_id AND a.cell = l.cell JOIN gc b ON b.map_id = a.map_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND l.component < b.cell),
cp AS (SELECT map_id, cell, min(component) AS component FROM lb GROUP BY map_id, cell), g AS (SELECT map_id, component, count(*) AS n FROM cp GROUP BY ALL) SELECT map_id, max(n) AS largest, sum(n) AS n_true FROM g GROUP BY map_id""")[5:])
def largest_component(t):
    m = maps(t).withColumn("mask", F.transform("z", lambda v: v < -0.12))
    return D.largest_component(m, "mask")


@query("A34_isotropic_null", "map_id:l a2_8_16:d entropy_8_16:d a2_16_32:d entropy_16_32:d")
def isotropic_null(t):
    null = residuals(t).withColumn("z", L.isotropic_null(F.col("z"), F.col("map_id"), N, N, 67))
    return S.observe(null, N, N, PITCH, 12)[0]


@query("S12_max_cell_diff", "map_id:l n_common:l max_diff:d within:b", sql("cells", "SELECT map_id, count(*) AS n_common, max(abs(z - round(z, 2))) AS max_diff, max(abs(z - round(z, 2))) <= 0.0049 AS within FROM cells WHERE valid AND r > 0 GROUP BY map_id"))
def max_cell_diff(t):
    """Largest cell difference inside the common mask of two map stores."""
    a = masked(maps(t)).select("map_id", F.col("z").alias("za"))
    b = maps(t).select("map_id", F.transform("z", lambda v, i: F.when(i >= 8, F.round(v, 2))).alias("zb"))
    d = a.join(b, "map_id").select("map_id", F.filter(F.zip_with("za", "zb", lambda x, y: F.abs(x - y)), lambda v: v.isNotNull()).alias("d"))
    return d.select("map_id", F.size("d").alias("n_common"), F.array_max("d").alias("max_diff"), (F.array_max("d") <= 0.0049).alias("within"))

"""Projection queries: derived process, geometry and identity columns."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from graticule.catalog.fixtures import event_series, fold_facts, maps, order_frame, sql
from graticule.catalog.registry import query
from graticule.functions import process as P
from graticule.operators.maps import masked

FACTORS = """fac AS (SELECT l_orderkey, l_linenumber, l_suppkey, 200 + l_tax * 1000 AS tau, 100.0 * l_linenumber AS f, l_quantity AS h, l_extendedprice / 97 AS v, 1 + round(l_discount * 100) AS n FROM lineitem)"""


def factors(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", (200 + F.col("l_tax") * 1000).alias("tau"), (100.0 * F.col("l_linenumber")).alias("f"),
                             F.col("l_quantity").alias("h"), (F.col("l_extendedprice") / 97).alias("v"), (1 + F.round(F.col("l_discount") * 100)).alias("n"))


COORD_SQL = "v / f AS pulse_pitch, 1e6 * n * f / (v * h) AS areal_pulses, 1000 * 5.3333 / f AS pulse_energy, 1000 * 5.3333 * n / (v * h) AS areal_dose"


@query("P1_process_coordinates", "l_orderkey:l l_linenumber:l pulse_pitch:d areal_pulses:e pulse_energy:d areal_dose:e", f"WITH {FACTORS} SELECT *, {COORD_SQL} FROM fac")
def process_coordinates(t):
    return factors(t).withColumns(P.process_coordinates(*[F.col(c) for c in "vfhn"]))


@query("P2_canonical_parity", "column_name:s n_divergent:l max_abs:d", f"""WITH {FACTORS}, c AS (SELECT *, {COORD_SQL} FROM fac), d AS (SELECT abs(areal_dose - pulse_energy * n * f / (v * h)) AS a, abs(pulse_pitch - (v + CASE WHEN n > 9 THEN 0.5 ELSE 0 END) / f) AS b FROM c)
SELECT 'areal_dose' AS column_name, count(*) FILTER (a > 1e-6) AS n_divergent, max(a) AS max_abs FROM d UNION ALL SELECT 'pulse_pitch', count(*) FILTER (b > 1e-6), max(b) FROM d""")
def canonical_parity(t):
    c = process_coordinates(t).withColumns({"alt_dose": F.col("pulse_energy") * F.col("n") * F.col("f") / (F.col("v") * F.col("h")),
                                            "alt_pitch": (F.col("v") + F.when(F.col("n") > 9, 0.5).otherwise(0.0)) / F.col("f")})
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("column_name"), F.abs(F.col(k) - F.col(a)).alias("d")) for k, a in (("areal_dose", "alt_dose"), ("pulse_pitch", "alt_pitch"))]))
    return c.select(pair.alias("e")).groupBy("e.column_name").agg(F.count_if(F.col("e.d") > 1e-6).alias("n_divergent"), F.max("e.d").alias("max_abs"))


@query("P3_condition_key", "condition:s quad:s n:l", f"""WITH {FACTORS}, k AS (SELECT regexp_replace(regexp_replace(CAST(CAST(tau AS DECIMAL(28,6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ':' || CAST(f AS BIGINT) || ':' || CAST(n AS BIGINT) AS condition,
CAST(h AS BIGINT) || ':' || CAST(n AS BIGINT) AS quad FROM fac) SELECT condition, quad, count(*) AS n FROM k GROUP BY ALL""")
def condition_key(t):
    k = factors(t).select(P.condition_key([F.col("tau"), F.col("f"), F.col("n")]).alias("condition"), P.condition_key([F.col("h"), F.col("n")]).alias("quad"))
    return k.groupBy("condition", "quad").agg(F.count(F.lit(1)).alias("n"))


@query("P3_recipe_key", "recipe:s n:l", """SELECT CAST(CAST(l_discount AS DECIMAL(28,6)) AS VARCHAR) || '|' || CAST(CAST(l_tax AS DECIMAL(28,6)) AS VARCHAR) AS recipe, count(*) AS n FROM lineitem GROUP BY ALL""")
def recipe_key(t):
    six = lambda c: F.col(c).cast("decimal(28,6)").cast("string")
    return t.lineitem.groupBy(F.concat_ws("|", six("l_discount"), six("l_tax")).alias("recipe")).agg(F.count(F.lit(1)).alias("n"))


@query("P4_base_group", "base:s cv_group:s n:l", """WITH b AS (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'AUTOMOBILE' WHEN 'FURNITURE' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS base FROM customer)
SELECT base, CASE WHEN o_orderstatus = 'F' THEN base ELSE base || ':' || o_orderstatus END AS cv_group, count(*) AS n FROM orders JOIN b ON c_custkey = o_custkey GROUP BY ALL""")
def base_group(t):
    alias = F.create_map(*[F.lit(x) for x in ("MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD")])
    base = F.coalesce(F.try_element_at(alias, F.col("c_mktsegment")), F.col("c_mktsegment"))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("base", base)
    group = F.when(F.col("o_orderstatus") == "F", F.col("base")).otherwise(F.concat_ws(":", "base", "o_orderstatus"))
    return j.groupBy("base", group.alias("cv_group")).agg(F.count(F.lit(1)).alias("n"))


@query("P5_domain_features", "l_orderkey:l l_linenumber:l fluence:d threshold:d log_margin:d", f"""WITH {FACTORS} SELECT l_orderkey, l_linenumber, 2 * 5.3333 * 1000 / (f * pi() * 0.25) AS fluence, 0.8 * pow(n, -0.2) AS threshold,
ln(2 * 5.3333 * 1000 / (f * pi() * 0.25) / (0.8 * pow(n, -0.2))) AS log_margin FROM fac""")
def domain_features(t):
    fl = 2 * P.POWER_W * 1000 / (F.col("f") * math.pi * 0.25)
    th = 0.8 * F.pow("n", F.lit(-0.2))
    return factors(t).select("l_orderkey", "l_linenumber", fl.alias("fluence"), th.alias("threshold"), F.log(fl / th).alias("log_margin"))


@query("P6_engineered_ratios", "l_orderkey:l l_linenumber:l f_over_v:d n_over_h:d log_tax:d d_over_t:d", f"""SELECT l_orderkey, l_linenumber, 100 * l_linenumber / greatest(l_extendedprice, 1e-9) AS f_over_v, l_discount / nullif(l_quantity, 0) AS n_over_h,
ln(1 + l_tax) AS log_tax, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS d_over_t FROM lineitem""")
def engineered_ratios(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (100 * F.col("l_linenumber") / F.greatest("l_extendedprice", F.lit(1e-9))).alias("f_over_v"),
        (F.col("l_discount") / F.nullif("l_quantity", F.lit(0.0))).alias("n_over_h"), F.log1p("l_tax").alias("log_tax"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).alias("d_over_t"))


@query("P7_design_matrix", "id:l u1:d u2:d m1:d u1m1:d u2m1:d dose:d", sql("ord", "SELECT id, x1 AS u1, x2 AS u2, ln(1 + x3) AS m1, x1 * ln(1 + x3) AS u1m1, x2 * ln(1 + x3) AS u2m1, x1 - ln(1 + x3) AS dose FROM ord"))
def design_matrix(t):
    """Named blocks: U, U + M, the U x M interactions (outer product) and a dose-only column."""
    u = F.array("x1", "x2")
    m = F.array(F.log1p("x3"))
    inter = F.flatten(F.transform(u, lambda a: F.transform(m, lambda b: a * b)))
    d = order_frame(t).select("id", F.concat(u, m, inter).alias("x"))
    return d.select("id", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate(("u1", "u2", "m1", "u1m1", "u2m1"))], (F.get("x", F.lit(0)) - F.get("x", F.lit(2))).alias("dose"))


@query("P8_distances", "l_orderkey:l l_linenumber:l near:d axis:d", """SELECT l_orderkey, l_linenumber, least(abs(l_quantity / 15 - 1), abs(l_quantity / 15 - 2), abs(l_quantity / 15 - 3)) AS near,
least(x, 90 - x) AS axis FROM (SELECT *, (l_quantity * 7.5) - 90 * floor(l_quantity * 7.5 / 90) AS x FROM lineitem)""")
def distances(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", P.integer_distance(F.col("l_quantity") / 15).alias("near"), P.axis_distance(F.col("l_quantity") * 7.5).alias("axis"))


CLASS_SQL = "CASE WHEN NOT ok OR ratio IS NULL THEN 'INVALID' WHEN ratio BETWEEN 0.75 AND 1.25 THEN 'm1' WHEN ratio BETWEEN 1.75 AND 2.25 THEN 'm2' WHEN ratio BETWEEN 2.75 AND 3.25 THEN 'm3' ELSE 'OUT' END"
CLASSED = f"cls AS (SELECT target, fold, id, model, {CLASS_SQL} AS klass FROM (SELECT *, observed / nullif(predicted, 0) AS ratio, id % 11 <> 0 AS ok FROM fact))"


def classed(t):
    return fold_facts(t).select("target", "fold", "id", "model", P.assign_class(F.col("observed") / F.nullif("predicted", F.lit(0.0)), F.col("id") % 11 != 0).alias("klass"))


@query("P9_assign_class", "id:l model:s klass:s", sql("fact", f"{CLASSED} SELECT id, model, klass FROM cls"))
def assign_class(t):
    return classed(t)


@query("P10_cycles_level", "p_partkey:l level:s", "SELECT p_partkey, CASE WHEN 17.834048 / p_size >= 2 THEN 'HIGH' WHEN 17.834048 / p_size >= 1.2 THEN 'LOW' ELSE 'UNMEASURABLE' END AS level FROM part")
def cycles_level(t):
    return t.part.select("p_partkey", P.cycles_level(F.col("p_size")).alias("level"))


@query("P11_lambda_3db", "p_partkey:l lam:d", "SELECT p_partkey, 2 * pi() * p_size / sqrt(ln(2)) AS lam FROM part")
def lambda_3db(t):
    return t.part.select("p_partkey", P.half_power_wavelength(F.col("p_size")).alias("lam"))


@query("P12_saturate", "l_orderkey:l l_linenumber:l s:d", "SELECT l_orderkey, l_linenumber, 20 * (1 - exp(-l_quantity / 20)) AS s FROM lineitem")
def saturate(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", P.saturate(F.col("l_quantity"), F.lit(20.0)).alias("s"))


@query("P13_wrap_axial", "event_id:l theta:d stripe:d", sql("evt", "SELECT event_id, CASE WHEN m > 90 THEN m - 180 ELSE m END AS theta, (m + 90) - 180 * floor((m + 90) / 180) AS stripe FROM (SELECT event_id, value * 7 - 180 * floor(value * 7 / 180) AS m FROM evt)"))
def wrap_axial(t):
    a = F.col("value") * 7
    return event_series(t).select("event_id", P.wrap_axial(a).alias("theta"), F.pmod(a + 90, F.lit(180.0)).alias("stripe"))


@query("P14_box_frames", "p_partkey:l gx:d gy:d lu:d lv:d long_axis:d short_axis:d", """SELECT p_partkey, 5 + p_size * c - 2 * s AS gx, 7 + p_size * s + 2 * c AS gy, (p_size - 5) * c + (2 - 7) * s AS lu, (2 - 7) * c - (p_size - 5) * s AS lv,
greatest(p_size, p_retailprice / 100) AS long_axis, least(p_size, p_retailprice / 100) AS short_axis FROM (SELECT *, cos(radians(p_retailprice / 10)) AS c, sin(radians(p_retailprice / 10)) AS s FROM part)""")
def box_frames(t):
    th, u = F.col("p_retailprice") / 10, F.col("p_size")
    gx, gy = P.box_to_global(F.lit(5.0), F.lit(7.0), u, F.lit(2.0), th)
    lu, lv = P.box_to_local(F.lit(5.0), F.lit(7.0), u, F.lit(2.0), th)
    return t.part.select("p_partkey", gx.alias("gx"), gy.alias("gy"), lu.alias("lu"), lv.alias("lv"), F.greatest(u, F.col("p_retailprice") / 100).alias("long_axis"), F.least(u, F.col("p_retailprice") / 100).alias("short_axis"))


@query("P15_view_size", "p_partkey:l length:d pixels:l", """SELECT p_partkey, l AS length, least(400, floor(l / 0.25)) AS pixels FROM (SELECT p_partkey, greatest(p_size * c + 9 * s, p_size * s + 9 * c) + 20 AS l
FROM (SELECT *, abs(cos(radians(p_retailprice / 10))) AS c, abs(sin(radians(p_retailprice / 10))) AS s FROM part))""")
def view_size(t):
    ln = P.view_length(F.col("p_size"), F.lit(9.0), F.col("p_retailprice") / 10, 10.0)
    return t.part.select("p_partkey", ln.alias("length"), F.least(F.lit(400), F.floor(ln / 0.25)).alias("pixels"))


@query("P16_target_transform", "l_orderkey:l l_linenumber:l fit:d back:d", "SELECT l_orderkey, l_linenumber, ln(1 + l_extendedprice) AS fit, least(greatest(exp(ln(1 + l_extendedprice)) - 1, 5000), 60000) AS back FROM lineitem")
def target_transform(t):
    fit = F.log1p("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", fit.alias("fit"), F.least(F.greatest(F.expm1(fit), F.lit(5000.0)), F.lit(60000.0)).alias("back"))


@query("P17_axis_coordinates", "map_id:l s:d x:d y:d", """WITH p AS (SELECT vec_id AS map_id, label * 18.0 AS th FROM embeddings) SELECT map_id, s, x, y FROM (SELECT map_id, s, 14 + s * cos(radians(th)) AS x, 14 + s * sin(radians(th)) AS y FROM p, (SELECT g * 2.0 AS s FROM range(-10, 11) AS r(g)))
WHERE x BETWEEN 0 AND 28 AND y BETWEEN 0 AND 28""")
def axis_coordinates(t):
    th = F.radians(F.col("label") * 18.0)
    pts = maps(t).select("map_id", "label", F.explode(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda g: g * 2.0)).alias("s"))
    return pts.select("map_id", "s", (14 + F.col("s") * F.cos(th)).alias("x"), (14 + F.col("s") * F.sin(th)).alias("y")).where(F.col("x").between(0, 28) & F.col("y").between(0, 28))


@query("P18_phase_grid", "p_partkey:l k:l phase:d", "SELECT p_partkey, k, k * (p_size / 8.0) AS phase FROM part, range(8) AS g(k)")
def phase_grid(t):
    return t.part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("p_partkey", "k", (F.col("k") * F.col("p_size") / 8).alias("phase"))


@query("P19_parse_condition", "event_id:l pos:l k:l", "SELECT event_id, pos - 1 AS pos, CAST(v AS BIGINT) AS k FROM (SELECT event_id, unnest(p) AS v, generate_subscripts(p, 1) AS pos FROM (SELECT event_id, regexp_extract_all(props || ';' || CAST(user_id AS VARCHAR), '[0-9]+') AS p FROM events))")
def parse_condition(t):
    text = F.concat_ws(";", "props", F.col("user_id").cast("string"))
    return t.events.select("event_id", F.posexplode(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+)")), lambda v: v.cast("long"))).alias("pos", "k"))


@query("P20_array_transfer", "p_partkey:l power:d", "SELECT p_partkey, pow(sum(cos(2 * pi() * c * n)), 2) + pow(sum(sin(2 * pi() * c * n)), 2) AS power FROM (SELECT p_partkey, p_size * 0.0137 - floor(p_size * 0.0137) AS c, p_retailprice FROM part), range(12) AS g(n) GROUP BY p_partkey")
def array_transfer(t):
    return t.part.select("p_partkey", P.array_transfer(F.lit(0.0137), F.col("p_size"), F.lit(12)).alias("power"))

"""Join queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from graticule.catalog.fixtures import event_series, maps, sql
from graticule.catalog.maps import full_maps
from graticule.catalog.registry import query
from graticule.catalog.spectra import DCT, EDGE_LIST, EDGES, coefs
from graticule.functions import process as P
from graticule.operators import joins as J
from graticule.operators import spectra as SP
from graticule.operators.maps import masked


@query("J1_star_join", "r_name:s yr:l revenue:e n:l", """SELECT r_name, year(o_orderdate) AS yr, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("yr")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("J2_tuple_lookup", "state:s n:l mean_value:d", """WITH j AS (SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' THEN p_retailprice END AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_linenumber = p_size)
SELECT CASE WHEN p_partkey IS NULL THEN 'absent' WHEN v IS NULL THEN 'present_null' ELSE 'present' END AS state, count(*) AS n, avg(v) AS mean_value FROM j GROUP BY 1""")
def tuple_lookup(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("k1"), F.col("l_linenumber").alias("k2"))
    lookup = t.part.select(F.col("p_partkey").alias("k1"), F.col("p_size").alias("k2"), F.when(F.col("p_brand") != "Brand#1", F.col("p_retailprice")).alias("v"))
    return J.lookup_states(rows, lookup, ["k1", "k2"], "v").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value"))


@query("J3_suffix_compare", "o_orderkey:l price_old:e price_new:e delta:e", """SELECT o_orderkey, o_totalprice AS price_old, p AS price_new, p - o_totalprice AS delta FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def suffix_compare(t):
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("price_new"))
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("price_old")).join(new, "o_orderkey").withColumn("delta", F.col("price_new") - F.col("price_old"))


@query("J4_asof_nearest", "event_id:l match_at:d match_value:d", sql("evt", """a AS (SELECT * FROM evt WHERE event_type = 'purchase'), b AS (SELECT * FROM evt WHERE event_type = 'view'),
p AS (SELECT a.event_id, a.s, b.s AS bs, b.value AS bv FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.s >= b.s), n AS (SELECT a.event_id, b.s AS bs, b.value AS bv FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.s <= b.s),
c AS (SELECT event_id, p.s, CASE WHEN n.bs IS NOT NULL AND (p.bs IS NULL OR n.bs - p.s < p.s - p.bs) THEN n.bs ELSE p.bs END AS m, CASE WHEN n.bs IS NOT NULL AND (p.bs IS NULL OR n.bs - p.s < p.s - p.bs) THEN n.bv ELSE p.bv END AS v FROM p JOIN n USING (event_id))
SELECT event_id, CASE WHEN abs(m - s) <= 10 THEN m END AS match_at, CASE WHEN abs(m - s) <= 10 THEN v END AS match_value FROM c"""))
def asof_nearest(t):
    e = event_series(t)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "s")
    right = e.where("event_type = 'view'").select("user_id", "s", "value")
    return J.asof_nearest(left, right, ["user_id"], "s", "value", 10.0)


@query("J5_nearest_key", "o_orderkey:l nearest:d", "WITH k AS (SELECT DISTINCT p_size * 10000.0 AS k FROM part) SELECT o_orderkey, arg_min(k, struct_pack(d := abs(k - o_totalprice), k := k)) AS nearest FROM orders, k GROUP BY o_orderkey")
def nearest_key(t):
    return J.nearest_key(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", t.part.select((F.col("p_size") * 10000.0).alias("k")), "k")


@query("J6_anti_join", "o_orderkey:l o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join(t):
    return t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_totalprice")


@query("J6_semi_join", "o_orderkey:l o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_join(t):
    return t.orders.join(t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("J7_cross_source_pairs", "n_pairs:l mean_sq_dist:d", sql("pair", "SELECT count(*) AS n_pairs, avg(d_proc * d_proc) AS mean_sq_dist FROM pair WHERE NOT same_grp"))
def cross_source_pairs(t):
    """All unordered pairs of different labels, summarised through per-label sums."""
    rows = t.embeddings.select("label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(5)])
    return J.cross_source_pair_moments(rows, "label", [f"e{k}" for k in range(5)])


@query("J8_parameter_grid", "l_suppkey:l level:d param:d loss:d n:l", "SELECT l_suppkey, lv AS level, pr AS param, avg(pow(l_quantity - lv * pr, 2)) AS loss, count(*) AS n FROM lineitem, (VALUES (10.0), (20.0)) AS a(lv), (VALUES (0.5), (1.0), (2.0)) AS b(pr) GROUP BY ALL")
def parameter_grid(t):
    g = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("param")) for a in (10.0, 20.0) for b in (0.5, 1.0, 2.0)]))
    per = t.lineitem.groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("w")).withColumn("g", g)
    loss = F.col("w") * F.pow(F.col("l_quantity") - F.col("g.level") * F.col("g.param"), 2)
    return per.groupBy("l_suppkey", "g.level", "g.param").agg((F.sum(loss) / F.sum("w")).alias("loss"), F.sum("w").alias("n"))


@query("J9_interval_join", "label:l bin:l n:l energy:d", sql("cells", DCT + f""", e AS (SELECT b, {EDGE_LIST}[b + 1]::DOUBLE AS lo, {EDGE_LIST}[b + 2]::DOUBLE AS hi FROM range(6) AS g(b))
SELECT label, b AS bin, count(*) AS n, sum(coef * coef) AS energy FROM dct JOIN e ON lam >= lo AND (lam < hi OR (b = 5 AND lam <= hi)) GROUP BY label, b"""))
def interval_join(t):
    return coefs(t).withColumn("bin", SP.bin_of(F.col("lam"), EDGES)).where("bin IS NOT NULL").groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("coef") * F.col("coef")).alias("energy"))


@query("J10_bilinear_stencil", "map_id:l k:l z:d", sql("cells", """
p AS (SELECT map_id, k, 3.5 + (k // 4 - 1.5) * cos(radians(th)) + (k % 4 - 1.5) * sin(radians(th)) AS y, 3.5 + (k % 4 - 1.5) * cos(radians(th)) - (k // 4 - 1.5) * sin(radians(th)) AS x FROM (SELECT DISTINCT map_id, label * 17.0 + 3 AS th FROM cells), range(16) AS g(k)),
c AS (SELECT p.*, dy, dx, floor(y) + dy AS r, floor(x) + dx AS c, CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM p, range(2) AS a(dy), range(2) AS b(dx)),
s AS (SELECT c.map_id, k, sum(w) FILTER (valid) AS sw, sum(w * z) FILTER (valid) AS swz FROM c LEFT JOIN cells USING (map_id, r, c) GROUP BY c.map_id, k)
SELECT map_id, k, CASE WHEN sw >= 0.99 THEN swz / sw END AS z FROM s"""))
def bilinear_stencil(t):
    th = F.radians(F.col("label") * 17.0 + 3)

    def point(k):
        v, u = F.floor(k / 4) - 1.5, k % 4 - 1.5
        return F.struct(k.cast("long").alias("k"), (3.5 + v * F.cos(th) + u * F.sin(th)).alias("y"), (3.5 + u * F.cos(th) - v * F.sin(th)).alias("x"))
    return J.bilinear(masked(maps(t)), F.transform(F.sequence(F.lit(0), F.lit(15)), point))


@query("J12_best_shift", "user_id:l shift:d agreement:d n_matched:l precision:d recall:d n_shallow:l n_invaded:l n_hard:l", sql("evt", """
a AS (SELECT * FROM evt WHERE event_type = 'click'), b AS (SELECT user_id, s, flag FROM evt WHERE event_type = 'view'),
x AS (SELECT a.*, sh AS shift, s - sh AS ms FROM a, (VALUES (-12.0::DOUBLE), (-6.0), (0.0), (6.0), (12.0)) AS g(sh)),
p AS (SELECT x.*, b.s AS bs, b.flag AS bf FROM x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.ms >= b.s), n AS (SELECT event_id, shift, b.s AS bs, b.flag AS bf FROM x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.ms <= b.s),
c AS (SELECT p.user_id, p.event_id, p.shift, p.flag, p.value, ms, CASE WHEN n.bs IS NOT NULL AND (p.bs IS NULL OR n.bs - ms <= ms - p.bs) THEN n.bs ELSE p.bs END AS m, CASE WHEN n.bs IS NOT NULL AND (p.bs IS NULL OR n.bs - ms <= ms - p.bs) THEN n.bf ELSE p.bf END AS mf FROM p JOIN n ON n.event_id = p.event_id AND n.shift = p.shift),
h AS (SELECT * FROM c WHERE abs(m - ms) <= 24), ag AS (SELECT user_id, shift, avg((flag = mf)::INT) AS agreement, count(*) AS n_matched FROM h GROUP BY user_id, shift),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY agreement DESC, shift) AS k FROM ag) WHERE k = 1),
hb AS (SELECT h.*, agreement, n_matched FROM h JOIN best ON best.user_id = h.user_id AND best.shift = h.shift), rf AS (SELECT user_id, quantile_cont(value, 0.9) FILTER (flag) AS ref FROM hb GROUP BY user_id)
SELECT user_id, any_value(shift) AS shift, any_value(agreement) AS agreement, any_value(n_matched) AS n_matched, count(*) FILTER (flag AND mf) / nullif(count(*) FILTER (flag), 0) AS precision, count(*) FILTER (flag AND mf) / nullif(count(*) FILTER (mf), 0) AS recall,
count(*) FILTER (NOT mf AND value < 0.7 * ref) AS n_shallow, count(*) FILTER (NOT mf AND value < 0.7 * ref AND flag) AS n_invaded, count(*) FILTER (NOT mf AND value < 0.7 * ref AND flag AND value / ref < 0.6) AS n_hard FROM hb JOIN rf USING (user_id) GROUP BY user_id"""))
def best_shift(t):
    e = event_series(t)
    mine = e.where("event_type = 'click'").select("user_id", "event_id", "s", "flag", "value")
    pilot = e.where("event_type = 'view'").select("user_id", "s", "flag")
    return J.best_shift(mine, pilot, ["user_id"], "s", "flag", "value", [-12.0, -6.0, 0.0, 6.0, 12.0], 24.0, 0.7, 0.6)


@query("J13_exact_repeat_pairs", "l_partkey:l l_linenumber:l n_pairs:l mean_sq_dist:d", """SELECT a.l_partkey, a.l_linenumber, count(*) AS n_pairs, avg(pow(a.l_quantity - b.l_quantity, 2)) AS mean_sq_dist
FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) a JOIN (SELECT *, row_number() OVER () AS rid FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def exact_repeat_pairs(t):
    """Pairs with the same full key and different sources, per key, through sums."""
    return J.cross_source_pair_moments(t.lineitem, "l_suppkey", ["l_quantity"], ["l_partkey", "l_linenumber"]).where("n_pairs > 0")


@query("J14_condition_match", "state:s n:l n_orders:l", """WITH c AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem)
SELECT CASE WHEN p_partkey IS NULL THEN 'no_line' WHEN p_size < 10 THEN 'too_small' WHEN p_brand = 'Brand#2' THEN 'unmeasured' ELSE 'usable' END AS state, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders
FROM c LEFT JOIN part ON p_partkey = l_partkey AND l_linenumber < 7 GROUP BY 1""")
def condition_match(t):
    """Every scan row lists its conditions as text; they are exploded and matched to measured lines."""
    both = F.concat_ws(";", F.concat_ws(":", "l_partkey", "l_linenumber"), F.concat_ws(":", "l_suppkey", "l_linenumber"))
    scans = t.lineitem.select("l_orderkey", both.alias("conditions"))
    c = scans.select("l_orderkey", F.explode(F.split("conditions", ";")).alias("c")).select("l_orderkey", F.split("c", ":")[0].cast("long").alias("part"), F.split("c", ":")[1].cast("int").alias("line"))
    j = c.join(t.part, (F.col("p_partkey") == F.col("part")) & (F.col("line") < 7), "left")
    state = F.when(F.col("p_partkey").isNull(), "no_line").when(F.col("p_size") < 10, "too_small").when(F.col("p_brand") == "Brand#2", "unmeasured").otherwise("usable")
    per = j.groupBy(state.alias("state"), "l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("state").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_orders"))

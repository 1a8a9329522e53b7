"""Window, rank, ordered-series, top-k and set queries."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from graticule.catalog.fixtures import event_series, fold_facts, order_frame, signals, sql, trajectories
from graticule.catalog.registry import query
from graticule.functions import arrays as A
from graticule.functions.hashing import draw_key, hex_prefix
from graticule.operators import sequences as Q
from graticule.plans import order_stats as O
from graticule.plans import series as S
from graticule.plans.scalars import one_row


@query("W1_avg_rank", "l_quantity:d r:d", "SELECT DISTINCT l_quantity, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem")
def avg_rank(t):
    return O.average_ranks(t.lineitem, [], "l_quantity", "r", descending=True)


@query("W2_consensus_rank", "id:l consensus:d", sql("ord_exact", """r AS (SELECT id, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2 AS a, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2 AS b, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS c FROM ord)
SELECT id, list_sort([a, b, c])[2] AS consensus FROM r"""))
def consensus_rank(t):
    df = order_frame(t, exact=True)
    for c, n in (("x1", "a"), ("x2", "b"), ("y", "c")):
        df = O.with_average_rank(df, [], c, n)
    return df.select("id", A.array_median(F.array("a", "b", "c")).alias("consensus"))


@query("W3_selection_pool", "c_custkey:l reasons:s tier:l", """WITH r AS (SELECT c_custkey, abs(c_acctbal) AS e, 'balance' AS reason, 0 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 6
UNION ALL SELECT c_custkey, abs(c_acctbal), 'debt', 1 FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS k FROM customer) WHERE k <= 6 UNION ALL SELECT c_custkey, abs(c_acctbal), 'permanent', -1 FROM customer WHERE c_custkey % 20 = 0),
m AS (SELECT c_custkey, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons, min(tier) AS lo, max(tier) AS hi, max(e) AS e FROM r GROUP BY c_custkey),
d AS (SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY lo DESC, e, c_custkey DESC) AS k FROM m WHERE lo = hi AND lo >= 0) WHERE k <= (SELECT greatest(count(*) - (count(*) FILTER (lo = -1) + 25), 0) FROM m))
SELECT c_custkey, reasons, lo AS tier FROM m WHERE c_custkey NOT IN (SELECT c_custkey FROM d)""")
def selection_pool(t):
    """Per-segment top lists and permanent members, thinned to the permanent ones and 25 more."""
    def top(order, reason):
        w = Window.partitionBy("c_mktsegment").orderBy(order, "c_custkey")
        return t.customer.withColumn("k", F.row_number().over(w)).where("k <= 6").select("c_custkey", F.lit(reason).alias("reason"), F.abs("c_acctbal").alias("extreme"))
    permanent = t.customer.where("c_custkey % 20 = 0").select("c_custkey", F.lit("permanent").alias("reason"), F.abs("c_acctbal").alias("extreme"))
    reasons = top(F.desc("c_acctbal"), "balance").unionByName(top(F.asc("c_acctbal"), "debt")).unionByName(permanent)
    return Q.selection_pool(reasons, "c_custkey", ["balance", "debt"], "permanent", "extreme", permanent.count() + 25)


@query("W4_step_deltas", "l_suppkey:l n:l dy:d dd:d", sql("traj", "SELECT l_suppkey, n, dy, dd FROM (SELECT *, y - lag(y) OVER w AS dy, d - lag(d) OVER w AS dd, lag(n) OVER w AS p FROM traj WINDOW w AS (PARTITION BY l_suppkey ORDER BY n)) WHERE p = n - 1"))
def step_deltas(t):
    s = S.with_previous(trajectories(t), ["l_suppkey"], "n", F.struct("n", "y", "d"), "p")
    return s.where("p.n = n - 1").select("l_suppkey", "n", (F.col("y") - F.col("p.y")).alias("dy"), (F.col("d") - F.col("p.d")).alias("dd"))


@query("W5_turning_cosine", "sig_id:l cosine:d step_rms:d", sql("sig", """
v AS (SELECT label, sig_id, i, y - lag(y) OVER (PARTITION BY label, i ORDER BY sig_id) AS d FROM sig), w AS (SELECT *, lag(d) OVER (PARTITION BY label, i ORDER BY sig_id) AS p FROM v)
SELECT sig_id, sum(d * p) / sqrt(sum(d * d) * sum(p * p)) AS cosine, sqrt(avg(d * d)) AS step_rms FROM w WHERE p IS NOT NULL GROUP BY sig_id"""))
def turning_cosine(t):
    """Cosine of consecutive step vectors along each label's trajectory."""
    s = S.with_previous(signals(t), ["label"], "sig_id", F.col("y"), "p")
    s = s.where("p IS NOT NULL").select("label", "sig_id", F.zip_with("y", "p", lambda a, b: a - b).alias("d"))
    s = S.with_previous(s, ["label"], "sig_id", F.col("d"), "q").where("q IS NOT NULL")
    d, q = F.col("d"), F.col("q")
    return s.select("sig_id", (A.dot(d, q) / F.sqrt(A.dot(d, d) * A.dot(q, q))).alias("cosine"), F.sqrt(A.mean_of(d, lambda v: v * v)).alias("step_rms"))


RUNS = """f AS (SELECT user_id, s, flag, coalesce(value, 0) AS value, CASE WHEN flag AND NOT coalesce(lag(flag) OVER w, false) THEN 1 ELSE 0 END AS st FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY s)),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY s) AS isl FROM f), runs AS (SELECT user_id, isl, min(s) AS s0, max(s) AS s1, count(*) AS n FROM i WHERE flag GROUP BY user_id, isl)"""
MERGED = RUNS + """, g AS (SELECT *, CASE WHEN lag(s1) OVER (PARTITION BY user_id ORDER BY s0) >= s0 - 12 THEN 0 ELSE 1 END AS st2 FROM runs),
m AS (SELECT user_id, min(s0) AS s0, max(s1) AS s1, sum(n) AS n, count(*) AS n_runs FROM (SELECT *, sum(st2) OVER (PARTITION BY user_id ORDER BY s0) AS k FROM g) GROUP BY user_id, k)"""


def runs(t, keep=False):
    return Q.threshold_runs(event_series(t), ["user_id"], "s", F.col("flag"), keep=keep)


@query("W6_threshold_runs", "user_id:l s0:d s1:d n:l", sql("evt", RUNS + " SELECT * FROM runs"))
def threshold_runs(t):
    return runs(t)


@query("W7_merge_runs", "user_id:l s0:d s1:d n:l n_runs:l", sql("evt", MERGED + " SELECT * FROM m"))
def merge_runs(t):
    return Q.merge_runs(runs(t, keep=True), ["user_id"], 12.0)


@query("W7_longest_run", "user_id:l s0:d s1:d long_enough:b", sql("evt", MERGED + " SELECT user_id, s0, s1, s1 - s0 >= 24 AS long_enough FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s1 - s0 DESC, s0) AS k FROM m) WHERE k = 1"))
def longest_run(t):
    return Q.longest_run(merge_runs(t), ["user_id"], 24.0)


@query("W8_plateau_run", "user_id:l lo:d hi:d n_members:l state:s", sql("evt", """ref AS (SELECT user_id, quantile_cont(value, 0.9) AS p90, max(s) - min(s) AS span FROM evt WHERE flag GROUP BY user_id),
e2 AS (SELECT e.user_id, e.s, e.value, e.flag AND e.value >= 0.7 * p90 AS flag, span FROM evt e JOIN ref USING (user_id)), """ + MERGED.replace("FROM evt", "FROM e2") + """,
b AS (SELECT user_id, s0, s1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s1 - s0 DESC, s0) AS k FROM m) WHERE k = 1)
SELECT u.user_id, s0 AS lo, s1 AS hi, count(*) FILTER (e2.flag AND e2.s BETWEEN s0 AND s1) AS n_members, CASE WHEN s0 IS NULL THEN 'no_plateau' WHEN s1 - s0 < greatest(12, 0.05 * any_value(span)) THEN 'fragmented' ELSE 'stable' END AS state FROM (SELECT DISTINCT user_id FROM evt) u LEFT JOIN b USING (user_id) LEFT JOIN e2 USING (user_id) GROUP BY u.user_id, s0, s1"""))
def plateau_run(t):
    return Q.plateau_run(event_series(t), ["user_id"], "s", F.col("flag"), "value", depth_frac=0.7, gap=12.0, min_len=12.0, min_frac=0.05)


@query("W9_online_flags", "sig_id:l online:b", sql("sig", "SELECT sig_id, count(*) FILTER (y > 0.12) >= 10 AS online FROM sig GROUP BY sig_id"))
def online_flags(t):
    return signals(t).select("sig_id", (F.size(F.filter("y", lambda v: v > 0.12)) >= 10).alias("online"))


@query("W10_min_spacing_select", "user_id:l s:d", "WITH RECURSIVE " + sql("evt", "SELECT 1")[5:].rsplit("SELECT 1", 1)[0].strip() + """,
kept AS (SELECT user_id, min(s) AS s FROM evt GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.s) FROM evt e WHERE e.user_id = k.user_id AND e.s >= k.s + 24) AS s FROM kept k WHERE k.s IS NOT NULL)
SELECT user_id, s FROM kept WHERE s IS NOT NULL""")
def min_spacing_select(t):
    return Q.min_spacing(event_series(t), ["user_id"], "s", 24.0)


@query("W11_section_positions", "user_id:l pos:d", sql("evt", "b AS (SELECT user_id, min(s) + 0.1 * (max(s) - min(s)) AS lo, max(s) - 0.1 * (max(s) - min(s)) AS hi FROM evt GROUP BY user_id) SELECT user_id, lo + 24.0 * k AS pos FROM b, range(0, 100000) AS g(k) WHERE k <= floor((hi - lo) / 24)"))
def section_positions(t):
    b = event_series(t).groupBy("user_id").agg(F.min("s").alias("a"), F.max("s").alias("z"))
    lo, hi = F.col("a") + 0.1 * (F.col("z") - F.col("a")), F.col("z") - 0.1 * (F.col("z") - F.col("a"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((hi - lo) / 24))
    return b.select("user_id", F.explode(F.transform(steps, lambda k: lo + 24.0 * k)).alias("pos"))


WIDTHS = """dn AS (SELECT sig_id, i, x, CASE WHEN (sig_id * 64 + i) % 53 <> 0 THEN y END AS v FROM sig), mx AS (SELECT sig_id, max(v) AS dmax FROM dn GROUP BY sig_id),
q AS (SELECT dn.sig_id, i, x, v, v / dmax AS d, qq FROM dn JOIN mx USING (sig_id), (VALUES (0.2), (0.5), (0.8)) AS t(qq)),
e AS (SELECT *, coalesce(d >= qq, false) AS a, lag(d) OVER w AS dp, lead(d) OVER w AS dn2, lag(coalesce(d >= qq, false)) OVER w AS ap FROM q WINDOW w AS (PARTITION BY sig_id, qq ORDER BY i)),
r AS (SELECT *, sum(CASE WHEN a AND NOT coalesce(ap, false) THEN 1 ELSE 0 END) OVER (PARTITION BY sig_id, qq ORDER BY i) AS k FROM e),
w AS (SELECT sig_id, qq, k, min(i) AS i0, arg_min(CASE WHEN dp IS NULL THEN x - 0.25 ELSE x - (d - qq) * 0.5 / (d - dp) END, i) AS l, arg_max(CASE WHEN dn2 IS NULL THEN x + 0.25 ELSE x + (qq - d) * 0.5 / (dn2 - d) END, i) AS h,
 bool_or((dp IS NULL AND coalesce(NOT ap, true)) OR dn2 IS NULL) AS cen FROM r WHERE a GROUP BY sig_id, qq, k)"""


@query("W12_threshold_width", "sig_id:l q:d width:d censored:b n_runs:l total_width:d", sql("sig", WIDTHS + """
SELECT sig_id, CAST(qq AS DOUBLE) AS q, arg_max(h - l, (h - l) - i0 * 1e-12) AS width, arg_max(cen, (h - l) - i0 * 1e-12) AS censored, count(*) AS n_runs, sum(h - l) AS total_width FROM w GROUP BY sig_id, qq"""))
def threshold_width(t):
    holes = signals(t).withColumn("y", F.transform("y", lambda v, i: F.when((F.col("sig_id") * 64 + i) % 53 != 0, v)))
    return Q.threshold_widths(holes, "sig_id", "y", 0.5, [0.2, 0.5, 0.8])


@query("W13_section_features", "sig_id:l area:d eq_width:d affected:d ridge_left:d ridge_right:d asymmetry:d left_slope:d right_slope:d separation:d skewness:d", sql("sig", """
mx AS (SELECT sig_id, max(y) AS dmax, arg_max(i, y) AS k, sum(greatest(y, 0)) * 0.5 AS area, avg(pow(y - m, 3)) / pow(avg(pow(y - m, 2)), 1.5) AS skewness FROM (SELECT *, avg(y) OVER (PARTITION BY sig_id) AS m FROM sig) GROUP BY sig_id),
f AS (SELECT s.sig_id, i, x, y, dmax, k, y >= 0.5 * dmax AS a, abs(y) > 0.05 AS b FROM sig s JOIN mx USING (sig_id)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY sig_id, a ORDER BY i) AS ka, i - row_number() OVER (PARTITION BY sig_id, b ORDER BY i) AS kb FROM f),
aff AS (SELECT sig_id, max(w) AS affected FROM (SELECT sig_id, max(x) - min(x) + 0.5 AS w FROM g WHERE b GROUP BY sig_id, kb) GROUP BY sig_id),
ra AS (SELECT sig_id, i0, i1, k FROM (SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY i1 - i0 DESC, i0) AS rr FROM (SELECT sig_id, ka, min(i) AS i0, max(i) AS i1, any_value(k) AS k FROM g WHERE a GROUP BY sig_id, ka)) WHERE rr = 1),
h AS (SELECT s.sig_id, count(*) AS n_all, any_value(i0) AS i0, any_value(i1) AS i1, any_value(ra.k) AS k, any_value(ra.k) BETWEEN any_value(i0) AND any_value(i1) AS inside,
 regr_slope(y, x) FILTER (i BETWEEN i0 AND ra.k) AS ls, regr_slope(y, x) FILTER (i BETWEEN ra.k AND i1) AS rs, min(y) FILTER (i < i0) AS li, min(y) FILTER (i > i1) AS ri, min(y) FILTER (i < ra.k) AS lk, min(y) FILTER (i > ra.k) AS rk,
 arg_min(x, y) FILTER (i < i0) AS lx, arg_min(x, y) FILTER (i > i1) AS rx FROM sig s JOIN ra USING (sig_id) GROUP BY s.sig_id)
SELECT sig_id, area, area / dmax AS eq_width, coalesce(affected, 0) AS affected, greatest(0, -coalesce(CASE WHEN inside THEN li ELSE lk END, 0)) AS ridge_left, greatest(0, -coalesce(CASE WHEN inside THEN ri ELSE rk END, 0)) AS ridge_right,
CASE WHEN inside THEN ((i1 - h.k) - (h.k - i0)) * 0.5 / greatest((i1 - i0) * 0.5, 1e-12) END AS asymmetry, CASE WHEN inside AND h.k > i0 THEN ls END AS left_slope, CASE WHEN inside AND i1 > h.k THEN rs END AS right_slope,
CASE WHEN inside AND li < 0 AND ri < 0 THEN rx - lx END AS separation, skewness FROM h JOIN mx USING (sig_id) LEFT JOIN aff USING (sig_id)"""))
def section_features(t):
    return Q.section_features(signals(t), "sig_id", "y", 0.5, affected=0.05)


@query("W14_dense_label", "p_partkey:l label:s", "SELECT p_partkey, printf('T%02d', dense_rank() OVER (ORDER BY p_type, p_size)) AS label FROM part")
def dense_label(t):
    combos = \
        O.ordinal(t.part.select("p_type", "p_size").distinct(), [], [F.col("p_type"), F.col("p_size")], [F.col("p_type")], "rank")
    return t.part.join(combos, ["p_type", "p_size"]).select("p_partkey", F.format_string("T%02d", "rank").alias("label"))


HOLM_P = "p AS (SELECT target, fold, 0.001 + (abs(avg(observed) - avg(train_null)) * 0.01) AS p FROM fact WHERE model = 'full' GROUP BY target, fold)"


@query("W15_holm", "target:s fold:l p:d adjusted:d", sql("fact", HOLM_P + """,
h AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, fold) AS r, count(*) OVER (PARTITION BY target) AS m FROM p)
SELECT target, fold, p, max(least(1, p * (m - r + 1))) OVER (PARTITION BY target ORDER BY r) AS adjusted FROM h"""))
def holm(t):
    p = fold_facts(t).where("model = 'full'").groupBy("target", "fold").agg((0.001 + F.abs(F.avg("observed") - F.avg("train_null")) * 0.01).alias("p"))
    return Q.holm(p, ["target"], "p", "fold", "adjusted")


@query("W17_robust_z", "id:l rz:d z:d", sql("ord", "s AS (SELECT median(y) AS m, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, avg(y) AS mu, stddev_pop(y) AS sd FROM ord) SELECT id, (y - m) / nullif(iqr, 0) AS rz, (y - mu) / nullif(sd, 0) AS z FROM ord, s"))
def robust_z(t):
    df = order_frame(t)
    q = one_row(O.quantiles(df, [], "y", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    m = one_row(df.agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd")))
    return df.select("id", ((F.col("y") - q["q50"]) / F.nullif(q["q75"] - q["q25"], F.lit(0.0))).alias("rz"), ((F.col("y") - m["mu"]) / F.nullif(m["sd"], F.lit(0.0))).alias("z"))


@query("W18_reference_standardise", "id:l z:d", sql("ord", "s AS (SELECT median(y) AS m, avg(y) AS mu, stddev_pop(y) AS sd FROM ord WHERE role = 'F') SELECT id, (CASE WHEN id % 13 = 0 THEN m ELSE y END - mu) / sd AS z FROM ord, s"))
def reference_standardise(t):
    """Missing values take the reference median; scale comes from the reference rows only."""
    df = order_frame(t)
    ref = df.where("role = 'F'")
    med = O.median(ref, [], "y", "m").select("m").scalar()
    m = one_row(ref.agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd")))
    y = F.coalesce(F.when(F.col("id") % 13 != 0, F.col("y")), med)
    return df.select("id", ((y - m["mu"]) / m["sd"]).alias("z"))


@query("W19_quantile_strata", "fold:l stratum:l n:l", sql("ord", """r AS (SELECT *, grp % 5 AS f FROM ord), e AS (SELECT k AS fold, quantile_cont(y, 0.333333) AS q1, quantile_cont(y, 0.666667) AS q2 FROM range(5) AS g(k) JOIN r ON r.f <> k GROUP BY k)
SELECT fold, CASE WHEN y <= q1 THEN 0 WHEN y <= q2 THEN 1 ELSE 2 END AS stratum, count(*) AS n FROM e, ord GROUP BY ALL"""))
def quantile_strata(t):
    """Edges from each fold's training rows, applied to all rows."""
    df = order_frame(t).withColumn("f", F.col("grp") % 5)
    spread = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    e = O.quantiles(spread.where("f <> fold"), ["fold"], "y", {"q1": 0.333333, "q2": 0.666667})
    st = F.when(F.col("y") <= F.col("q1"), 0).when(F.col("y") <= F.col("q2"), 1).otherwise(2)
    return spread.join(e, "fold").groupBy("fold", st.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("T1_top_k_per_group", "l_suppkey:l l_orderkey:l l_linenumber:l l_extendedprice:d rk:l", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem) WHERE rk <= 5")
def top_k_per_group(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("rk", F.row_number().over(w)).where("rk <= 5")


@query("T2_arg_best", "target:s fold:l best_id:l score:d", sql("fact", "SELECT target, fold, arg_min(id, struct_pack(a := abs(observed - predicted), b := id)) AS best_id, min(abs(observed - predicted)) AS score FROM fact WHERE model = 'full' GROUP BY target, fold"))
def arg_best(t):
    s = F.abs(F.col("observed") - F.col("predicted"))
    return fold_facts(t).where("model = 'full'").groupBy("target", "fold").agg(F.min_by("id", F.struct(s.alias("s"), "id")).alias("best_id"), F.min(s).alias("score"))


@query("T3_global_top_k", "o_orderkey:l o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("T4_sorted_sink", "n_regionkey:l n_name:s n_customers:l", "SELECT n_regionkey, n_name, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY n_regionkey, n_name")
def sorted_sink(t):
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_name").agg(F.count("c_custkey").alias("n_customers")).orderBy("n_regionkey", "n_name")


@query("U1_union_by_name", "id:l price:d qty:d arm:s", "SELECT o_orderkey AS id, o_totalprice AS price, NULL AS qty, 'orders' AS arm FROM orders UNION ALL SELECT l_orderkey, NULL, sum(l_quantity), 'lines' FROM lineitem GROUP BY l_orderkey")
def union_by_name(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit("orders").alias("arm"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("qty")).withColumn("arm", F.lit("lines"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U2_distinct_on", "l_partkey:l l_suppkey:l l_orderkey:l", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey")
def distinct_on(t):
    """First row per recipe; min over the ordering key reduces before the shuffle."""
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey")).alias("first")).select("l_partkey", "l_suppkey", "first.l_orderkey")


@query("U3_set_jaccard", "n_both:l n_any:l jaccard:d", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) AS n_any, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) / count(*) AS jaccard FROM a FULL JOIN b ON a.k = b.k""")
def set_jaccard(t):
    g = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_totalprice") > 300000).alias("b")).where("a OR b")
    both = F.count_if(F.col("a") & F.col("b"))
    return g.agg(both.alias("n_both"), F.count(F.lit(1)).alias("n_any"), (both / F.count(F.lit(1))).alias("jaccard"))


@query("U4_partition_equals", "fold:l n_train:l n_test:l n_overlap:l n_missing:l", sql("ord", "SELECT k AS fold, count(*) FILTER (grp % 5 <> k) AS n_train, count(*) FILTER (grp % 5 = k) AS n_test, 0 AS n_overlap, 0 AS n_missing FROM ord, range(5) AS g(k) GROUP BY k"))
def partition_equals(t):
    rows = order_frame(t).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    parts = rows.select("fold", "id", F.when(F.col("grp") % 5 == F.col("fold"), "test").otherwise("train").alias("part"))
    per = parts.groupBy("fold", "id").agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b"))
    return per.groupBy("fold").agg(F.count_if(F.col("a") > 0).alias("n_train"), F.count_if(F.col("b") > 0).alias("n_test"),
                                   F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("n_overlap"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("n_missing"))

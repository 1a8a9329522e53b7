"""Contract and validation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from graticule.catalog.fixtures import event_series, maps, signals, sql, trajectories
from graticule.catalog.maps import full_maps
from graticule.catalog.registry import query
from graticule.operators import contracts as K
from graticule.operators import maps as M
from graticule.plans.series import with_previous


@query("C1_require", "rule:s failures:l n_rows:l", sql("", """r AS (SELECT count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45) AS a, count(*) FILTER (NOT l_discount < 0.1) AS b, count(*) AS n FROM lineitem)
SELECT 'quantity_range' AS rule, a AS failures, n AS n_rows FROM r UNION ALL SELECT 'discount_below', b, n FROM r"""))
def require(t):
    return K.rule_failures(t.lineitem, {"quantity_range": F.col("l_quantity").between(1, 45), "discount_below": F.col("l_discount") < 0.1})


@query("C2_expect_unique", "l_orderkey:l l_linenumber:l n:l", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def expect_unique(t):
    return K.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("C2_cardinalities", "column_name:s n_distinct:l", """SELECT 'l_suppkey' AS column_name, count(DISTINCT l_suppkey) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def cardinalities(t):
    return K.cardinalities(t.lineitem, ["l_suppkey", "l_partkey", "l_returnflag"])


@query("C2_value_counts", "l_returnflag:s l_linestatus:s n:l", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def value_counts(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("C4_join_validated", "o_orderkey:l c_mktsegment:s c_acctbal:d", "SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey")
def join_validated(t):
    return K.join_validated(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"], "m:1")


@query("C5_expect_same_order", "vec_id:l key_a:l key_b:l", "SELECT vec_id, label AS key_a, label + 1 AS key_b FROM embeddings WHERE vec_id % 50 = 7")
def expect_same_order(t):
    a = t.embeddings.select("vec_id", "label")
    b = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 50 == 7, F.col("label") + 1).otherwise(F.col("label")).alias("label"))
    return K.order_mismatches(a, b, "vec_id", "label")


@query("C6_expect_group_set", "l_orderkey:l n_values:l n_expected:l ok:b", """SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_values,
count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 1 AND 4) AS n_expected,
count(DISTINCT l_linenumber) = 4 AND count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 1 AND 4) = 4 AS ok FROM lineitem GROUP BY l_orderkey""")
def expect_group_set(t):
    return K.group_sets(t.lineitem, "l_orderkey", "l_linenumber", [1, 2, 3, 4])


@query("C7_expect_paired_slots", "l_orderkey:l n:l same_base:b two_slots:b ok:b", """SELECT l_orderkey, count(*) AS n, min(l_returnflag) = max(l_returnflag) AS same_base,
min(l_linenumber) <> max(l_linenumber) AS two_slots, count(*) = 2 AND min(l_returnflag) = max(l_returnflag) AND min(l_linenumber) <> max(l_linenumber) AS ok FROM lineitem GROUP BY l_orderkey""")
def expect_paired_slots(t):
    return K.paired_slots(t.lineitem, "l_orderkey", "l_returnflag", "l_linenumber")


@query("C8_in_box", "l_orderkey:l l_linenumber:l l_quantity:d l_discount:d", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
def in_box(t):
    return t.lineitem.where(K.in_box({"l_quantity": (10, 20), "l_discount": (0.02, 0.05)})).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("C9_forbid_columns", "column_name:s forbidden:b n_values:l", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {'true' if 'price' in c or 'status' in c else 'false'} AS forbidden, count({c}) AS n_values FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")
def forbid_columns(t):
    return K.forbidden_columns(t.orders, ["price", "status"])


@query("C10_forbid_transition", "from_n:l to_n:l n:l forbidden:b", sql("traj", """s AS (SELECT lag(n) OVER (PARTITION BY l_suppkey ORDER BY n) AS from_n, n AS to_n FROM traj)
SELECT from_n, to_n, count(*) AS n, from_n = 4 AND to_n = 5 AS forbidden FROM s WHERE from_n IS NOT NULL GROUP BY from_n, to_n"""))
def forbid_transition(t):
    steps = with_previous(trajectories(t), ["l_suppkey"], "n", F.col("n"), "from_n").where("from_n IS NOT NULL")
    return steps.groupBy("from_n", F.col("n").alias("to_n")).agg(F.count(F.lit(1)).alias("n")).withColumn("forbidden", (F.col("from_n") == 4) & (F.col("to_n") == 5))


@query("C11_finite_positive", "rule:s failures:l n_rows:l", """SELECT 'l_quantity' AS rule, count(*) FILTER (NOT coalesce(l_quantity > 0 AND isfinite(l_quantity), false)) AS failures, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'l_discount', count(*) FILTER (NOT coalesce(l_discount > 0 AND isfinite(l_discount), false)), count(*) FROM lineitem
UNION ALL SELECT 'l_tax', count(*) FILTER (NOT coalesce(l_tax > 0 AND isfinite(l_tax), false)), count(*) FROM lineitem""")
def finite_positive(t):
    return K.not_finite_positive(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query("C12_coverage_state", "coverage:s l_returnflag:s n:l", """SELECT CASE WHEN p_partkey IS NOT NULL THEN 'exact_match' WHEN l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0 AND 0.08 THEN 'in_box_pred' ELSE 'out_of_box' END AS coverage,
l_returnflag, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber GROUP BY ALL""")
def coverage_state(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("k1"), F.col("l_linenumber").alias("k2"), "l_quantity", "l_discount", "l_returnflag")
    lookup = t.part.select(F.col("p_partkey").alias("k1"), F.col("p_size").alias("k2"))
    s = K.coverage_state(rows, lookup, ["k1", "k2"], {"l_quantity": (10, 40), "l_discount": (0, 0.08)})
    return s.groupBy("coverage", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("C14_qc_flags", "event_id:l flags:s", sql("evt", """SELECT event_id, CASE WHEN f = '' THEN 'ok' ELSE f END AS flags FROM (SELECT event_id,
concat_ws('|', CASE WHEN value > 80 THEN 'high' END, CASE WHEN value < 5 THEN 'low' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN s > 500 THEN 'late' END) AS f FROM evt)"""))
def qc_flags(t):
    rules = {"high": F.col("value") > 80, "low": F.col("value") < 5, "error": F.col("event_type") == "error", "late": F.col("s") > 500}
    return event_series(t).select("event_id", K.qc_flags(rules).alias("flags"))


@query("C15_invariance_error", "feature:s max_change:d", sql("cells", """v AS (SELECT map_id, z - median(z) OVER (PARTITION BY map_id) AS a, (z + 3.7) - median(z + 3.7) OVER (PARTITION BY map_id) AS b FROM cells),
f AS (SELECT map_id, sqrt(avg(a * a)) AS s1, sqrt(avg(b * b)) AS s2, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS q1, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS q2 FROM v GROUP BY map_id)
SELECT 'sq' AS feature, max(abs(s1 - s2)) AS max_change FROM f UNION ALL SELECT 'iqr', max(abs(q1 - q2)) FROM f"""))
def invariance_error(t):
    base = full_maps(t)
    moved = base.withColumn("z", F.transform("z", lambda v: v + 3.7))
    feats = lambda m: M.moments(M.residualised(m)).select("map_id", "sq").join(M.ranges(M.residualised(m)).select("map_id", "iqr"), "map_id")
    a, b = feats(base), feats(moved).withColumnsRenamed({"sq": "sq2", "iqr": "iqr2"})
    agg = a.join(b, "map_id").agg(F.max(F.abs(F.col("sq") - F.col("sq2"))).alias("sq"), F.max(F.abs(F.col("iqr") - F.col("iqr2"))).alias("iqr"))
    return agg.unpivot([], ["sq", "iqr"], "feature", "max_change")


@query("C16_jobs_complete", "n_nationkey:l n:l state:s", """o AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT coalesce(n_nationkey, k) AS n_nationkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n_nationkey IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'complete' END AS state
FROM nation FULL JOIN o ON k = n_nationkey""".join(["WITH ", ""]))
def jobs_complete(t):
    return K.job_completeness(t.nation.select("n_nationkey"), t.supplier.select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@query("C17_physical_guard", "map_id:l min_margin:d n_violations:l finite:b ok:b", sql("cells", """
p AS (SELECT a.map_id, CASE WHEN (a.map_id * 64 + a.r * 8 + a.c) % 997 <> 0 THEN a.z END AS z, b.z AS s FROM cells a JOIN cells b ON a.map_id = b.map_id AND b.r = 7 - a.r AND b.c = 7 - a.c)
SELECT map_id, min(z - least(s, 0)) AS min_margin, count(*) FILTER (z - least(s, 0) < -0.15) AS n_violations, count(z) = 64 AS finite,
count(*) FILTER (z - least(s, 0) < -0.15) = 0 AND count(z) = 64 AS ok FROM p GROUP BY map_id"""))
def physical_guard(t):
    """Some cells are NaN: their maps must not pass."""
    holes = F.transform("z", lambda z, i: F.when((F.col("map_id") * 64 + i) % 997 != 0, z).otherwise(float("nan")))
    return K.physical_guard(maps(t).withColumn("base", F.reverse("z")).withColumn("holed", holes), "holed", "base", 0.15)


@query("C18_profile_suitable", "sig_id:l suitable:b", sql("sig", """SELECT sig_id, max(y) > 0 AND max(abs(y)) FILTER (i < 3 OR i > 60) <= 0.7 * max(y) AS suitable FROM sig GROUP BY sig_id"""))
def profile_suitable(t):
    return signals(t).select("sig_id", K.profile_suitable(F.col("y"), 0.7).alias("suitable"))


@query("C19_elongation", "p_partkey:l suspicious:b", "SELECT p_partkey, greatest(p_retailprice / 100, p_size) / least(p_retailprice / 100, p_size) < 1.5 AS suspicious FROM part")
def elongation(t):
    return t.part.select("p_partkey", K.elongation_suspicious(F.col("p_retailprice") / 100, F.col("p_size"), 1.5).alias("suspicious"))


@query("C20_annotation_progress", "source:s n_done:l first_incomplete:l complete:b", """SELECT source, count(l.doc_id) AS n_done,
min(d.doc_id) FILTER (l.doc_id IS NULL) AS first_incomplete, bool_and(l.doc_id IS NOT NULL) AS complete FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def annotation_progress(t):
    items = t.documents.select("doc_id", "source").join(t.labels.select("doc_id").distinct().withColumn("_done", F.lit(True)), "doc_id", "left")
    return K.annotation_progress(items, F.col("_done").isNotNull(), ["source"], "doc_id")

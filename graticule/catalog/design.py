"""Design, selection and verdict queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from graticule.catalog.fixtures import event_series, fold_facts, order_frame, sql
from graticule.catalog.registry import query
from graticule.catalog.resampling import u_sql
from graticule.functions.hashing import uniform
from graticule.operators import coverage as C
from graticule.operators import design as D
from graticule.operators import linear as L
from graticule.plans import order_stats as O
from graticule.plans.scalars import one_row


def lhs_sql(d: str) -> str:
    return f"(row_number() OVER (ORDER BY md5('73|{d}|' || p_partkey), p_partkey) - 1 + {u_sql('73', repr('u'), repr(d), 'p_partkey')}) / count(*) OVER () AS {d}"


@query("D1_latin_hypercube", "p_partkey:l a:d b:d", f"SELECT p_partkey, {lhs_sql('a')}, {lhs_sql('b')} FROM part")
def latin_hypercube(t):
    """As many points as there are parts."""
    return D.latin_hypercube(t.part.select("p_partkey"), "p_partkey", ["a", "b"], 73)


POOL = f"""WITH lh AS (SELECT p_partkey, {lhs_sql('a')}, {lhs_sql('b')} FROM part), m AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), q AS (SELECT max(l_quantity) AS h FROM lineitem),
pool AS (SELECT p_partkey, CAST(floor(lo + a * (hi - lo)) AS BIGINT) AS level, CAST(floor(b * h) AS BIGINT) AS qty FROM lh, m, q), u AS (SELECT min(p_partkey) AS p_partkey, level, qty FROM pool GROUP BY level, qty)
SELECT p_partkey, level, qty FROM u WHERE (level, qty) NOT IN (SELECT DISTINCT p_size, CAST(l_quantity AS BIGINT) FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("D2_candidate_pool", "p_partkey:l level:l qty:l", POOL)
def candidate_pool(t):
    """Space-filling candidates on observed ranges, one per recipe, without the recipes already measured."""
    r = one_row(t.part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")))
    h = t.lineitem.agg(F.max("l_quantity").alias("h")).scalar()
    pool = latin_hypercube(t).select("p_partkey", F.floor(r["lo"] + F.col("a") * (r["hi"] - r["lo"])).alias("level"), F.floor(F.col("b") * h).alias("qty"))
    unique = pool.groupBy("level", "qty").agg(F.min("p_partkey").alias("p_partkey"))
    seen = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").cast("long").alias("level"), F.col("l_quantity").cast("long").alias("qty"))
    return unique.join(seen, ["level", "qty"], "left_anti")


@query("D3_greedy_novelty", "pick:l p_partkey:l score:d", """WITH seen AS (SELECT DISTINCT p_type FROM part WHERE p_size <= 10), sv AS (SELECT DISTINCT p_size * 20.0 AS v FROM part WHERE p_size <= 10), c AS (SELECT p_partkey, p_type, p_retailprice AS x, (SELECT min(abs(v - p_retailprice)) FROM sv) AS d, p_type IN (SELECT p_type FROM seen) AS k FROM part WHERE p_size > 10),
p1 AS (SELECT p_partkey, p_type, x, d + CASE WHEN k THEN 0 ELSE 50 END AS score FROM c ORDER BY score DESC, p_partkey LIMIT 1),
p2 AS (SELECT c.p_partkey, least(c.d, abs(c.x - p1.x)) + CASE WHEN k OR c.p_type = p1.p_type THEN 0 ELSE 50 END AS score FROM c, p1 WHERE c.p_partkey <> p1.p_partkey ORDER BY score DESC, c.p_partkey LIMIT 1)
SELECT 1 AS pick, p_partkey, score FROM p1 UNION ALL SELECT 2, p_partkey, score FROM p2""")
def greedy_novelty(t):
    seen = t.part.where("p_size <= 10").select("p_type", (F.col("p_size") * 20.0).alias("p_retailprice"))
    return C.greedy_novelty(t.part.where("p_size > 10").select("p_partkey", "p_type", "p_retailprice"), seen, "p_partkey", "p_type", "p_retailprice", 2, 50.0)


REGRET = "pr AS (SELECT o_orderkey // 2 AS pair_id, o_totalprice AS j, o_orderkey % 2 = (o_orderkey // 2) % 2 AS chosen, (o_orderkey // 2) % 5 AS fold FROM orders), rg AS (SELECT pair_id, any_value(fold) AS fold, count(*) = 2 AND count(*) FILTER (chosen) = 1 AS ok, max(j) FILTER (chosen) - min(j) AS regret FROM pr GROUP BY pair_id)"


def regrets(t):
    pair = F.floor(F.col("o_orderkey") / 2)
    rows = t.orders.select(pair.alias("pair_id"), "o_totalprice", ((F.col("o_orderkey") % 2) == (pair % 2)).alias("chosen"))
    return D.pairwise_regret(rows, "pair_id", "o_totalprice", F.col("chosen"))


@query("D4_pairwise_regret", "pair_id:l ok:b regret:e", f"WITH {REGRET} SELECT pair_id, ok, CASE WHEN ok THEN regret END AS regret FROM rg")
def pairwise_regret(t):
    return regrets(t)


@query("D5_design_regret_mean", "fold:l mean_regret:e n:l", f"WITH {REGRET} SELECT fold, avg(regret) AS mean_regret, count(*) AS n FROM rg WHERE ok GROUP BY fold")
def design_regret_mean(t):
    return regrets(t).where("ok").groupBy((F.col("pair_id") % 5).alias("fold")).agg(F.avg("regret").alias("mean_regret"), F.count(F.lit(1)).alias("n"))


@query("D7_verdict", "target:s coverage:d median_gain:d verdict:s", sql("fact", """g AS (SELECT target, id, fold, max(abs(observed - predicted)) FILTER (model = 'minus') - max(abs(observed - predicted)) FILTER (model = 'full') AS gain FROM fact GROUP BY ALL),
s AS (SELECT target, avg((gain IS NOT NULL)::INT) AS coverage, median(gain) AS median_gain, avg((gain > 0)::INT) AS pos FROM g GROUP BY target)
SELECT target, coverage, median_gain, CASE WHEN coverage < 0.9 THEN 'NOT_EVALUABLE' WHEN median_gain <= 0 THEN 'UNSUPPORTED' WHEN pos < 0.8 THEN 'MIXED' WHEN median_gain > 85 THEN 'DOMINANT' ELSE 'SUPPORTED' END AS verdict FROM s"""))
def verdict(t):
    """Ordered, mutually exclusive rules over one row of statistics per target."""
    ae = F.abs(F.col("observed") - F.col("predicted"))
    one = lambda m: F.max(F.when(F.col("model") == m, ae))
    g = fold_facts(t).groupBy("target", "id").agg((one("minus") - one("full")).alias("gain"))
    s = g.groupBy("target").agg(F.avg(F.col("gain").isNotNull().cast("double")).alias("coverage"), F.avg((F.col("gain") > 0).cast("double")).alias("pos")).join(O.median(g, ["target"], "gain", "median_gain"), "target")
    rules = F.when(F.col("coverage") < 0.9, "NOT_EVALUABLE").when(F.col("median_gain") <= 0, "UNSUPPORTED").when(F.col("pos") < 0.8, "MIXED").when(F.col("median_gain") > 85, "DOMINANT")
    return s.withColumn("verdict", rules.otherwise("SUPPORTED"))


@query("D8_label_by_fold", "p_partkey:l fold:l label:d", sql("ord", """f AS (SELECT k, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, min(y) AS lo, max(y) AS hi FROM range(5) AS g(k) JOIN ord ON grp % 5 <> k GROUP BY k)
SELECT p_partkey, k AS fold, least(greatest(a + b * ln(1 + p_size), lo), hi) AS label FROM part, f"""))
def label_by_fold(t):
    """Generated rows labelled by every fold's training fit, clipped to the training range; fits travel as one array."""
    f = order_frame(t).withColumn("fold", F.col("grp") % 5)
    fits = L.fit(L.leave_out(L.moments(f, ["fold"], [F.col("x1")], F.col("y")), [], "fold"), {"x1": [0]}, [0.0]).select("fold", "intercept", "coef")
    bounds = L.training_bounds(f, "fold", ["y"], 5).withColumnRenamed("outer", "fold")
    table = fits.join(bounds, "fold").agg(F.collect_list(F.struct("fold", "intercept", F.get("coef", F.lit(0)).alias("b"), "lo_y", "hi_y")).alias("t")).scalar()  # one entry per fold
    rows = t.part.select("p_partkey", F.log1p("p_size").alias("x")).withColumn("t", table).select("p_partkey", "x", F.explode("t").alias("f"))
    return rows.select("p_partkey", "f.fold", F.least(F.greatest(F.col("f.intercept") + F.col("f.b") * F.col("x"), F.col("f.lo_y")), F.col("f.hi_y")).alias("label"))


@query("D9_repeat_stability", "user_id:l stability:d n:l", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, arg_max(event_type, struct_pack(n := n, e := event_type)) AS nominal FROM c GROUP BY user_id) SELECT user_id, avg((event_type = nominal)::INT) AS stability, count(*) AS n FROM events JOIN m USING (user_id) GROUP BY user_id")
def repeat_stability(t):
    """Share of evaluations that keep the nominal (most frequent) label; only label counts are shuffled."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg((F.max("n") / F.sum("n")).alias("stability"), F.sum("n").alias("n"))


@query("D10_blind_codes", "code:s quality:l toxic:l", "SELECT printf('AUDIT-%02d', row_number() OVER (ORDER BY md5('79|' || doc_id), doc_id)) AS code, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def blind_codes(t):
    coded = D.blind_codes(t.documents.select("doc_id"), "doc_id", 79)
    return coded.join(t.labels, "doc_id", "left").select("code", "quality", "toxic")

"""Source, sink and seal queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from graticule.catalog.fixtures import order_frame, sql
from graticule.catalog.models import ridge_fits, frame, cols
from graticule.catalog.registry import query
from graticule.operators import linear as L
from graticule.plans.lineage import ensure_checkpoint_dir
from graticule.sources import readers as R
from graticule.sources import seals as S


def scratch(t) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/graticule-{uuid.uuid4().hex}"


CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])


@query("S1_read_csv_fallback", "c_custkey:l c_name:s c_acctbal:d", "SELECT c_custkey, c_name || ' ' || chr(233) AS c_name, c_acctbal FROM customer")
def read_csv_fallback(t):
    """Names with an accented letter, written in a one-byte encoding that is not valid UTF-8."""
    folder = scratch(t)
    t.customer.select("c_custkey", F.concat_ws(" ", "c_name", F.lit("é")).alias("c_name"), "c_acctbal").write.csv(folder, header=True, encoding="ISO-8859-1")
    return R.read_csv_fallback(t.spark, folder, CUSTOMER)


@query("S2_normalise_schema", "order_id:l price:d level:d has_label:b", """SELECT o_orderkey AS order_id, o_totalprice AS price, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'bad' ELSE substr(o_orderpriority, 1, 1) END AS DOUBLE) AS level, o_orderstatus <> 'P' AS has_label FROM orders""")
def normalise_schema(t):
    raw = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", "bad").otherwise(F.substring("o_orderpriority", 1, 1)).alias("prio_level"))
    return R.normalise_schema(raw, {"o_orderkey": "order_id", "o_totalprice": "price", "prio_level": "level", "not_there": "x"}, ["price", "level"], "level")


@query("S4_decode_counts", "l_orderkey:l l_linenumber:l z:d", "SELECT l_orderkey, l_linenumber, CASE WHEN q < 5000000 THEN floor((q * 137 + 500) / 1000) / 1000 END AS z FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS q FROM lineitem)")
def decode_counts(t):
    raw = F.round(F.col("l_extendedprice") * 100).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber", R.decode_counts(raw, 137, 5000000).alias("z"))


@query("S5_header_from_path", "page_id:l host:s number:l", "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def header_from_path(t):
    f = R.header_fields(F.col("url"), {"host": r"^https?://([^/]+)/", "number": r"/([0-9]+)"})
    return t.pages.select("page_id", f["host"].alias("host"), f["number"].cast("long").alias("number"))


@query("S6_load_contract", "o_orderkey:l c_mktsegment:s n_lines:l complete:b", """SELECT o_orderkey, c_mktsegment, n AS n_lines, c_custkey IS NOT NULL AND n IS NOT NULL AS complete FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def load_contract(t):
    m = t.orders.select("o_orderkey", "o_custkey")
    segments = m.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_mktsegment")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return R.load_contract(m, [segments, lines], ["o_orderkey"])


@query("S7_seal", "name:s size:l sha256:s")
def seal(t):
    return S.seal(t.spark, t.folder, "*.parquet")


@query("S7_verify_seal", "name:s state:s")
def verify_seal(t):
    """The data folder against its own seal in which one digest is changed and one file is missing."""
    s = S.seal(t.spark, t.folder, "*.parquet")
    told = F.when(F.col("name").startswith("orders"), F.reverse("sha256")).otherwise(F.col("sha256"))
    return S.verify_seal(s.withColumn("sha256", told).where(~F.col("name").startswith("nation")), s)


@query("S8_verify_seal_tolerant", "state:s n_files:l")
def verify_seal_tolerant(t):
    """The order keys as text, sealed with LF line ends and delivered with CRLF line ends."""
    a, b = scratch(t), scratch(t)
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("k")).repartitionByRange(2, "k").sortWithinPartitions("k")
    rows.write.text(a)
    rows.write.option("lineSep", "\r\n").text(b)
    name = lambda df: df.withColumn("name", F.substring("name", 1, 10))
    v = S.verify_seal(name(S.seal(t.spark, a, "part-*")), name(S.seal(t.spark, b, "part-*")), tolerant=True)
    return v.groupBy("state").agg(F.count(F.lit(1)).alias("n_files"))


@query("S9_seal_choices", "n_rows:l digest:s", """WITH r AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
c AS (SELECT sha256(h || ':' || count(*)) AS h, count(*) AS n FROM r GROUP BY h), q AS (SELECT substr(c.h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM c GROUP BY substr(c.h, 1, 3), substr(c.h, 4, 3)), p AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM q GROUP BY p)
SELECT sum(n) AS n_rows, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM p""")
def seal_choices(t):
    return S.seal_choices(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))


@query("S9_evaluate_sealed", "o_orderkey:l o_custkey:l y:e", "SELECT o_orderkey, o_custkey, o_totalprice AS y FROM orders")
def evaluate_sealed(t):
    choices = t.orders.select("o_orderkey", "o_custkey")
    digest = S.seal_choices(choices).first()["digest"]
    return S.evaluate_sealed(choices, digest, t.orders.select("o_orderkey", F.col("o_totalprice").alias("y")), "o_orderkey")


@query("S10_prediction_lock", "fold:l n:l mean_predicted:d", sql("ord", """tr AS (SELECT k, count(*) AS n, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) AS cxy FROM range(5) AS g(k) JOIN ord ON grp % 5 <> k GROUP BY k)
SELECT k AS fold, count(*) AS n, avg(my + (cxy / sx) / (1 + 1.0::DOUBLE / tr.n) * (x1 - mx) / sx) AS mean_predicted FROM tr JOIN ord ON grp % 5 = k GROUP BY k"""))
def prediction_lock(t):
    """Predictions are written with their configuration hash before any outcome is read back."""
    fits = ridge_fits(t, ("x1",), (1.0,)).select("fold", "intercept", "coef")
    p = frame(t).join(fits, "fold").select("id", "fold", L.predict(cols(("x1",))).alias("predicted"))
    path = scratch(t)
    digest = S.write_lock(p, path, {"alpha": 1.0}, ["x1"])
    return S.read_lock(t.spark, path, digest).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"))


@query("S11_latest_run", "name:s")
def latest_run(t):
    return R.latest_run(t.spark, t.folder, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("S13_compare_tables", "state:s only_a:l only_b:l", "SELECT 'VALUE_DIFF' AS state, count(*) AS only_a, count(*) AS only_b FROM orders WHERE o_orderkey % 1000 = 3")
def compare_tables(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return S.compare_tables(o, o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))


@query("S14_acceptance_delta", "column_name:s max_delta:d n_null_changed:l n_unmatched:l", """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 300 <> 4 THEN o_totalprice END + CASE WHEN o_orderkey % 7 = 0 THEN 0.25 ELSE 0 END AS p FROM orders WHERE o_orderkey % 500 <> 9)
SELECT 'price' AS column_name, max(abs(p - o_totalprice)) AS max_delta, count(*) FILTER (n.o_orderkey IS NOT NULL AND p IS NULL) AS n_null_changed, count(*) FILTER (n.o_orderkey IS NULL) AS n_unmatched FROM orders LEFT JOIN n USING (o_orderkey)""")
def acceptance_delta(t):
    old = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = old.where("o_orderkey % 500 <> 9").withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 7 == 0, 0.25).otherwise(0.0))
    return S.acceptance_delta(old, new.withColumn("price", F.when(F.col("o_orderkey") % 300 != 4, F.col("price"))), ["o_orderkey"], ["price"])

"""Demo inputs derived from the given tables, once in Spark and once as DuckDB CTEs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graticule.catalog.registry import Tables

SQL = {
    "cells": """cells AS (SELECT vec_id AS map_id, label, CAST(i // 8 AS BIGINT) AS r, CAST(i % 8 AS BIGINT) AS c,
        CAST(embedding[i + 1] AS DOUBLE) AS z, ((vec_id * 64 + i) % 97) <> 0 AS valid
        FROM embeddings, range(64) AS grid(i))""",
    "sig": """sig AS (SELECT vec_id AS sig_id, label, CAST(i AS BIGINT) AS i, i * 0.5::DOUBLE AS x,
        CAST(embedding[i + 1] AS DOUBLE) AS y FROM embeddings, range(64) AS grid(i))""",
    "comp": """comp AS (SELECT user_id, c1 / t AS p1, c2 / t AS p2, c3 / t AS p3, c4 / t AS p4, c5 / t AS p5 FROM (
        SELECT user_id, 1.0::DOUBLE * (1 + count(*) FILTER (event_type = 'click')) AS c1,
        1.0::DOUBLE * (1 + count(*) FILTER (event_type = 'error')) AS c2,
        1.0::DOUBLE * (1 + count(*) FILTER (event_type = 'purchase')) AS c3,
        1.0::DOUBLE * (1 + count(*) FILTER (event_type = 'signup')) AS c4,
        1.0::DOUBLE * (1 + count(*) FILTER (event_type = 'view')) AS c5, c1 + c2 + c3 + c4 + c5 AS t
        FROM events GROUP BY user_id))""",
    "evt": """evt AS (SELECT event_id, user_id, event_type, value, value > 50 AS flag,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS s FROM events)""",
    "ord": """ord AS (SELECT o_orderkey AS id, o_custkey AS grp, any_value(o_orderstatus) AS role, any_value(o_orderpriority) AS prio,
        ln(1 + coalesce(sum(l_quantity), 0)) AS x1, coalesce(avg(l_discount), 0) AS x2, count(l_orderkey) AS x3,
        any_value(o_totalprice) / 1000 AS y FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)""",
    "traj": """traj AS (SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS n, avg(l_quantity) AS y, avg(l_discount) AS d
        FROM lineitem GROUP BY l_suppkey, l_linenumber)""",
    "fact": """fact AS (SELECT f.prio AS target, m.model, f.fold, f.id, f.grp, f.y AS observed,
        CASE m.model WHEN 'full' THEN f.y * 0.9 + f.x3 ELSE tn.train_null END AS predicted, tn.train_null
        FROM (SELECT *, grp % 5 AS fold FROM ord) f JOIN (SELECT fd.fold, avg(o.y) AS train_null FROM (SELECT DISTINCT grp % 5 AS fold FROM ord) fd
        JOIN ord o ON o.grp % 5 <> fd.fold GROUP BY fd.fold) tn USING (fold), (VALUES ('full'), ('minus')) AS m(model))""",
    "pair": """emb AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS e FROM embeddings),
        pair AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same_grp,
        list_distance(a.e[1:5], b.e[1:5]) AS d_proc, list_distance(a.e[6:64], b.e[6:64]) AS d_morph
        FROM emb a JOIN emb b ON a.vec_id < b.vec_id)""",
}

# as "ord", with means that depend on no order of summation: equal discounts tie
SQL["ord_exact"] = SQL["ord"].replace("avg(l_discount)", "CAST(sum(CAST(l_discount AS DECIMAL(18, 6))) AS DOUBLE) / count(l_discount)")

# as "fact", with a training mean that depends on no order of summation
SQL["fact_exact"] = SQL["fact"].replace("avg(o.y)", "CAST(sum(CAST(o.y AS DECIMAL(18, 6))) AS DOUBLE) / count(o.y)")


def sql(names: str, body: str) -> str:
    """Prefix ``body`` with the named fixture CTEs; body may open with further CTEs."""
    order = []
    for n in names.split():
        for dep in ({"fact": ["ord"], "fact_exact": ["ord"]}.get(n, []) + [n]):
            if dep not in order:
                order.append(dep)
    ctes = ",\n".join(SQL[n] for n in order)
    body = body.strip()
    if not ctes:
        return body if body.upper().startswith("SELECT") else f"WITH {body}"
    return f"WITH {ctes}\n{body}" if body.upper().startswith("SELECT") else f"WITH {ctes},\n{body}"


def maps(t: Tables) -> DataFrame:
    """Embeddings as 8x8 maps, one array per map, pitch 4.0."""
    i0 = F.col("vec_id") * 64
    return t.embeddings.select(
        F.col("vec_id").alias("map_id"), "label", F.lit(8).alias("n_rows"), F.lit(8).alias("n_cols"),
        F.transform("embedding", lambda v: v.cast("double")).alias("z"),
        F.transform("embedding", lambda v, i: ((i0 + i) % 97) != 0).alias("valid"))


def signals(t: Tables) -> DataFrame:
    """Embeddings as 64-sample signals with pitch 0.5."""
    return t.embeddings.select(
        F.col("vec_id").alias("sig_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("y"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def compositions(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id").agg(
        *[(1.0 + F.count_if(F.col("event_type") == e)).alias(f"c{k}") for k, e in enumerate(EVENT_TYPES, 1)])
    total = sum((F.col(f"c{k}") for k in range(2, 6)), F.col("c1"))
    return counts.select("user_id", *[(F.col(f"c{k}") / total).alias(f"p{k}") for k in range(1, 6)])


def event_series(t: Tables) -> DataFrame:
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return t.events.select("event_id", "user_id", "event_type", "value", (F.col("value") > 50).alias("flag"),
                           (micros / F.lit(3600000000.0)).alias("s"))


def order_frame(t: Tables, exact: bool = False) -> DataFrame:
    """``exact`` means are the same in every order of summation, for ranks and edges that must keep ties."""
    mean = F.sum(F.col("l_discount").cast("decimal(18,6)")).cast("double") / F.count("l_discount") if exact else F.avg("l_discount")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), mean.alias("disc"), F.count(F.lit(1)).alias("n"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.col("o_orderstatus").alias("role"),
        F.col("o_orderpriority").alias("prio"), F.log(1 + F.coalesce("q", F.lit(0.0))).alias("x1"),
        F.coalesce("disc", F.lit(0.0)).alias("x2"), F.coalesce("n", F.lit(0)).alias("x3"),
        (F.col("o_totalprice") / 1000).alias("y"))


def trajectories(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").cast("long").alias("n")).agg(
        F.avg("l_quantity").alias("y"), F.avg("l_discount").alias("d"))


def fold_facts(t: Tables) -> DataFrame:
    rows = order_frame(t).withColumn("fold", F.col("grp") % 5)
    exact = F.sum(F.col("y").cast("decimal(18,6)")).alias("sy")  # the same in every order of summation
    sums = rows.groupBy("fold").agg(exact, F.count(F.lit(1)).alias("n"))
    total = rows.agg(exact, F.count(F.lit(1)).alias("n"))
    ty = total.select("sy").scalar()
    tn = total.select("n").scalar()
    null = sums.select("fold", ((ty - F.col("sy")).cast("double") / (tn - F.col("n"))).alias("train_null"))
    both = rows.join(null, "fold").withColumn("model", F.explode(F.array(F.lit("full"), F.lit("minus"))))
    return both.select(F.col("prio").alias("target"), "model", "fold", "id", "grp", F.col("y").alias("observed"),
                       F.when(F.col("model") == "full", F.col("y") * 0.9 + F.col("x3")).otherwise(F.col("train_null")).alias("predicted"),
                       "train_null")

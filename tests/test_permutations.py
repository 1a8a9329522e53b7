"""The keyed bijection and the statistics built on it."""
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import permutations as N


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_every_replicate_is_a_permutation(n):
    p = N.partners(np.arange(n), np.full(n, n), N.round_keys(5, 0, 20))
    assert (np.sort(p, axis=0) == np.arange(n)[:, None]).all()


def test_images_are_spread_evenly():
    """Each index goes everywhere about equally often, and neighbours do not stay neighbours."""
    n, reps = 60, 20_000
    p = N.partners(np.arange(n), np.full(n, n), N.round_keys(9, 0, reps))
    hits = np.stack([np.bincount(row, minlength=n) for row in p])
    chi = ((hits - reps / n) ** 2 / (reps / n)).sum()
    assert abs(chi - n * (n - 1)) < 6 * np.sqrt(2 * n * (n - 1))
    assert abs((np.diff(p, axis=0) == 1).mean() - 1 / n) < 0.003


def test_duckdb_walks_the_same_way():
    rows = "rows AS (SELECT 0 AS g, i, 37 AS n FROM range(37) AS t(i) UNION ALL SELECT 1, i, 5 FROM range(5) AS t(i))"
    got = duckdb.sql(f"WITH RECURSIVE {rows}, {N.duck_partners('rows', 11, 9)} SELECT g, i, rep, v FROM bij").fetchall()
    keys = N.round_keys(11, 0, 9)
    want = {(g, i, r): v for g, n in ((0, 37), (1, 5)) for i, row in enumerate(N.partners(np.arange(n), np.full(n, n), keys)) for r, v in enumerate(row.tolist())}
    assert len(got) == len(want) and {(g, i, r): v for g, i, r, v in got} == want


def test_class_counts_of_skewed_groups(spark):
    """One group with most rows is cut into pieces; every replicate keeps both margins."""
    df = spark.range(9000).select(F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("k"))
    out = N.class_counts(df, "g", "k", ["a", "b", "never"], 40, 3).toPandas()
    sizes = dict(df.where("k IS NOT NULL").groupBy("g").count().collect())
    assert set(out["g"]) == set(sizes) and (out["c2"] == 0).all()
    assert (out["c0"] + out["c1"] == out["g"].map(sizes)).all()
    assert (out.groupby("rep")[["c0", "c1"]].sum() == 3000).all().all() and out[out["g"] == "big"]["c0"].nunique() > 10


def test_too_many_values_are_refused(spark):
    with pytest.raises(ValueError):
        N.count_table(spark.range(50).withColumn("b", F.lit(0)), "b", "id", limit=10)


def test_auroc_null_is_centred(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("s"), (F.col("id") % 3 == 0).alias("y"))
    stat = np.array([r["stat"] for r in N.rank_auroc(df, "s", F.col("y"), 400, 1).collect()])
    assert abs(stat.mean() - 0.5) < 0.003 and 0.008 < stat.std() < 0.017


def test_logistic_slopes_under_a_shuffled_factor(spark):
    """Every replicate against Newton steps on its own rows; the observed slope against ``pyspark.ml``."""
    from graticule.operators import resampling as B
    r = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({"b": r.integers(0, 3, n), "x": r.choice([0.5, 1.0, 2.0, 4.0], n)})
    pdf["hit"] = r.random(n) < 1 / (1 + np.exp(1 - 0.4 * pdf["x"]))
    df = spark.createDataFrame(pdf).repartition(4)
    got = {x["rep"]: x["slope"] for x in N.logistic_null(df, "x", F.col("hit"), "b", 12, 5).collect()}
    assert len(got) == 13
    want = B.logistic_slope(df.withColumn("y", F.col("hit").cast("int")), "x", "y").first()["slope"]
    assert abs(got[-1] - want) < 1e-5
    keys = N.round_keys(5, 0, 12)
    for rep in range(12):
        x, y = [], []
        for b, part in pdf.groupby("b"):
            values, hits = np.sort(part["x"].to_numpy()), int(part["hit"].sum())
            p = N.partners(np.arange(len(part)), np.full(len(part), len(part)), keys[rep: rep + 1])[:, 0]
            x.append(values[p])
            y.append(np.arange(len(part)) < hits)
        x, y = np.concatenate(x), np.concatenate(y).astype(float)
        beta = np.zeros(2)
        design = np.column_stack([np.ones(len(x)), x])
        for _ in range(40):
            q = 1 / (1 + np.exp(-design @ beta))
            beta += np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design, design.T @ (y - q))
        assert abs(beta[1] - got[rep]) < 1e-8


def test_slopes_that_do_not_exist():
    n, x = np.array([5.0, 5.0]), np.array([0.0, 1.0])
    s = N.newton_slopes(np.array([[0.0, 0.0], [0.0, 5.0], [1.0, 3.0]]), n, x)
    assert np.isnan(s[0]) and np.isnan(s[1]) and abs(s[2] - (np.log(3 / 2) - np.log(1 / 4))) < 1e-9


def test_moran_of_replicates_joins_edges_once_and_broadcasts_no_replicate(spark):
    """Arrays per node against a group per replicate; exploded replicates must not be planned as a small table."""
    from graticule.operators import graph as G
    from graticule.operators import resampling as B
    from graticule.plans.lineage import cut
    v = spark.range(60).select("id", (F.col("id") * 7 % 11).cast("double").alias("z"))
    w = cut(G.symmetric_weights(v.select(F.col("id").alias("src"), F.pmod(F.col("id") * 13 + 5, F.lit(60)).alias("dst")).where("src <> dst")))
    perm = B.permuted(v, [], "id", "z", 12, 37)
    out = G.moran_replicates(v, perm, w, "id", "z")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["rep"]: r["moran"] for r in out.collect()}
    want = {r["rep"]: r["moran"] for r in G.moran(perm, w, ["rep"], "id", "z").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

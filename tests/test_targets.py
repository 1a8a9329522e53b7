"""Nested cross-validation of several targets against refits on the rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import targets as Y

ALPHAS = [0.01, 1.0, 30.0, 1000.0]
DESIGNS = {"all": [0, 1, 2], "two": [0, 2], "none": []}


def data():
    rng = np.random.default_rng(2)
    n = 240
    x = rng.normal(size=(n, 3)) + [5, 0, -2]
    x[:, 2] += x[:, 0]
    y = x @ rng.normal(size=(3, 2)) + rng.normal(size=(n, 2)) * [1, 3]
    g = rng.integers(0, 40, n)
    df = pd.DataFrame({"fold": g % 4, "inner": (g // 4) % 3, "grp": g, **{f"x{k}": x[:, k] for k in range(3)}, "ya": y[:, 0], "yb": y[:, 1]})
    df["w"] = 1 / df.groupby("grp")["grp"].transform("size")
    return df


def plain_fit(tr, te, c, alpha, weighted):
    w = tr["w"].to_numpy() if weighted else np.ones(len(tr))
    w = w / w.sum() * len(tr)
    a, b, ya = tr[c].to_numpy(), te[c].to_numpy(), tr[["ya", "yb"]].to_numpy()
    mean, my = w @ a / w.sum(), w @ ya / w.sum()
    s = np.sqrt(w @ (a - mean) ** 2 / w.sum())
    z = (a - mean) / s
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + alpha * np.eye(len(c)), z.T @ ((ya - my) * w[:, None]))
    v = te["w"].to_numpy() if weighted else np.ones(len(te))
    real = te[["ya", "yb"]].to_numpy()
    return v @ (real - my - (b - mean) / s @ beta) ** 2, v @ (real - my) ** 2, v.sum()


@pytest.mark.parametrize("scorer, weighted", [("multi_mse", False), ("log_ratio_q2", False), ("multi_mse", True)])
def test_nested(spark, scorer, weighted):
    df = data()
    given = spark.createDataFrame(df).unionByName(spark.createDataFrame(df.head(3).assign(ya=np.nan)).withColumn("ya", F.lit(None).cast("double"))).withColumn("alpha", F.lit("mine"))
    got = Y.nested(given, "fold", "inner", [F.col(f"x{k}") for k in range(3)], [F.col("ya"), F.col("yb")], DESIGNS, 4, scorer, ALPHAS, F.col("w") if weighted else None)
    got = {(r["fold"], r["design"]): r for r in got.collect()}
    assert len(got) == 4 * len(DESIGNS)
    for (fold, design), r in got.items():
        c = [f"x{k}" for k in DESIGNS[design]]
        train, test = df[df["fold"] != fold], df[df["fold"] == fold]
        scores = []
        for a in ALPHAS:
            each = []
            for j in range(3):
                sse, ss0, mass = plain_fit(train[train["inner"] != j], train[train["inner"] == j], c, a, weighted)
                each.append(-(1 - sse.sum() / ss0.sum()) if scorer == "log_ratio_q2" else sse.sum() / mass / 2)
            scores.append(np.mean(each))
        best = int(np.argmin(np.round(scores, 9)))
        assert r["alpha"] == ALPHAS[best] and abs(abs(r["inner_score"]) - abs(scores[best])) < 1e-6
        sse, ss0, mass = plain_fit(train, test, c, ALPHAS[best], weighted)
        assert abs(r["test_mse"] - sse.sum() / mass / 2) < 1e-6 and abs(r["test_q2"] - (1 - sse.sum() / ss0.sum())) < 1e-6
        assert np.allclose(r["q2_by_target"], 1 - sse / ss0, atol=1e-6)


def test_nested_edges(spark):
    df = spark.createDataFrame(data())
    run = lambda d: Y.nested(d, "fold", "inner", [F.col("x0"), F.lit(1.0)], [F.col("ya")], {"constant": [1], "both": [0, 1]}, 4, "mse", ALPHAS)
    assert run(df.where("false")).count() == 0
    flat = {r["fold"]: r for r in run(df).where("design = 'constant'").collect()}
    assert all(abs(r["test_q2"]) < 1e-9 and r["alpha"] == ALPHAS[0] for r in flat.values())
    with pytest.raises(ValueError, match="scorer"):
        Y.score("r2")


@pytest.mark.parametrize("scorer, sign", [("multi_mse", 1.0), ("log_ratio_q2", -1.0)])
def test_scores_that_agree_to_rounding_go_to_the_smaller_penalty(spark, scorer, sign):
    rows = [("a", 0.01, 0.5 + 1e-14), ("a", 1.0, 0.5 + 2e-14), ("a", 30.0, 0.5), ("a", 1000.0, 0.6), ("b", 0.01, 0.5 + 1e-7), ("b", 1.0, 0.5), ("c", 0.01, None), ("c", 1.0, 0.7), ("d", 1.0, None), ("d", 0.01, None)]
    tried = spark.createDataFrame([(d, a, None if s is None else sign * s) for d, a, s in rows], "design string, alpha double, inner_score double")
    got = {r["design"]: r["alpha"] for r in Y.preferred(tried, ["design"], scorer).collect()}
    assert got == {"a": 0.01, "b": 1.0, "c": 1.0, "d": 0.01}

"""Extremely randomised trees against trees grown one by one in NumPy from the same draws."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import fitted as M
from graticule.operators import forests as T

X = ["a", "b", "c"]
DESIGNS = {"one": ["b"], "two": ["a", "c"], "all": ["a", "b", "c"]}


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": r.normal(size=n), "b": r.integers(0, 3, n).astype(float), "c": r.exponential(size=n), "w": r.uniform(0.2, 2, n), "fold": r.integers(0, 3, n) + 10})
    pdf["y"] = 100 + 2 * pdf["a"] + np.sin(3 * pdf["c"]) + (pdf["b"] > 1) + r.normal(scale=0.1, size=n)
    return pdf


def plain_tree(x, y, w, inputs, tree, node, depth, least, seed, out):
    """Node -> (feature, cut, value, rows), by recursion."""
    value = (w * y).sum() / w.sum()
    out[node] = (T.LEAF, 0.0, value, len(y))
    best = None
    if depth > 0:
        for j, c in enumerate(inputs):
            lo, hi = x[:, c].min(), x[:, c].max()
            if hi <= lo:
                continue
            at = lo + T.drawn(seed, np.array([tree]), np.array([node]), np.array([j]))[0] * (hi - lo)
            left = x[:, c] <= at
            if min(left.sum(), (~left).sum()) < least:
                continue
            told = sum((w[s] * (y[s] - value)).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if told > 1e-9 and (best is None or told > best[0] + 1e-9):
                best = told, c, at, left
    if best is None:
        return
    _, c, at, left = best
    out[node] = (c, at, value, len(y))
    plain_tree(x[left], y[left], w[left], inputs, tree, 2 * node + 1, depth - 1, least, seed, out)
    plain_tree(x[~left], y[~left], w[~left], inputs, tree, 2 * node + 2, depth - 1, least, seed, out)


@pytest.fixture(scope="module")
def grown(spark, data):
    df = spark.createDataFrame(data).repartition(5)
    return T.grow(df, X, "y", "fold", DESIGNS, 30, 4, 3, 5, weight=F.col("w"))


def test_every_tree_equals_the_one_grown_alone(data, grown):
    assert len(grown.feature) == 3 * 3 * 30 and (grown.feature[:, 0] != T.LEAF).mean() > 0.9  # a root may draw only cuts at the very edge
    for tree in range(len(grown.feature)):
        design, fold = grown.owner(tree)
        train, want = data[data["fold"] != fold], {}
        plain_tree(train[X].to_numpy(), train["y"].to_numpy(), train["w"].to_numpy(), grown.designs[design], tree, 0, 4, 3, 5, want)
        held = set(np.flatnonzero(~np.isnan(grown.value[tree])))
        assert held == set(want)
        for node, (feature, at, value, rows) in want.items():
            assert grown.feature[tree, node] == feature and rows >= 3
            assert abs(grown.value[tree, node] - value) < 1e-9 and (feature == T.LEAF or grown.cut[tree, node] == at)


def test_trees_differ(grown):
    roots = grown.cut[grown.feature[:, 0] != T.LEAF, 0]
    assert len(np.unique(roots)) == len(roots)


def test_held_out_predictions_skip_the_own_fold(spark, data, grown):
    df = spark.createDataFrame(data).repartition(4)
    got = T.held_out(df, grown, "fold", ["id", "fold"]).toPandas()
    assert len(got) == 3 * len(data)
    models = grown.models(spark, "fold", "long")
    for r in models.collect():
        fitted = M.Fitted.of(r)
        part = data[data["fold"] == r["fold"]].sort_values("id")
        told = got[(got["design"] == r["model"]) & (got["fold"] == r["fold"])].sort_values("id")["predicted"]
        assert np.allclose(fitted.predict(part[X].to_numpy()), told, atol=1e-9)
    all_ = got[got["design"] == "all"].merge(data, on="id")
    assert ((all_["predicted"] - all_["y"]) ** 2).mean() < 0.5 * data["y"].var()


def test_small_groups_give_the_same_forest(spark, data, grown, monkeypatch):
    """Memory bound by groups of trees, other partitions: no tree changes."""
    monkeypatch.setattr(T, "CELLS", 3000)
    again = T.grow(spark.createDataFrame(data).repartition(2), X, "y", "fold", DESIGNS, 30, 4, 3, 5, weight=F.col("w"))
    assert (again.feature == grown.feature).all() and (again.cut == grown.cut).all() and np.allclose(again.value, grown.value, equal_nan=True)


def test_rows_without_values_and_empty_tables(spark, data):
    none = data.iloc[:4].assign(y=[np.nan, 1, 1, 1], a=[0, np.inf, 0, 0], w=[1, 1, -1, 1])
    dirty = spark.createDataFrame(pd.concat([data, none.assign(id=[1000, 1001, 1002, 1003])]))
    dirty = dirty.withColumn("fold", F.when(F.col("id") != 1003, F.col("fold")))
    clean = T.grow(spark.createDataFrame(data), X, "y", "fold", DESIGNS, 4, 3, 3, 5, weight=F.col("w"))
    forest = T.grow(dirty, X, "y", "fold", DESIGNS, 4, 3, 3, 5, weight=F.col("w"))
    assert (forest.feature == clean.feature).all() and np.allclose(forest.value, clean.value, equal_nan=True)
    told = T.held_out(dirty, forest, "fold", ["id"]).where("design = 'all'").toPandas().set_index("id")["predicted"]
    assert told[[1001, 1003]].isna().all() and told[[1000, 1002]].notna().all()
    empty = T.grow(dirty.where("false"), X, "y", "fold", DESIGNS, 4, 3, 3, 5)
    assert len(empty.feature) == 0 and T.held_out(dirty, empty, "fold", ["id"]).where("predicted IS NOT NULL").count() == 0
    constant = T.grow(spark.createDataFrame(data.assign(y=7.0)), X, "y", "fold", DESIGNS, 2, 3, 3, 5)
    assert (constant.feature == T.LEAF).all() and np.allclose(constant.value[:, 0], 7.0)
    lone = T.grow(spark.createDataFrame(data[data["fold"] == 10]), X, "y", "fold", DESIGNS, 2, 3, 3, 5)
    assert np.isnan(lone.value).all()

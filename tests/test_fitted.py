"""Curves, effects and importances of fitted models against plain evaluation on all rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import fitted as M
from graticule.operators import linear as L
from graticule.operators import permutations as N

X = ("a", "b", "c")


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(6)
    n = 700
    pdf = pd.DataFrame({"id": np.arange(n), "a": r.normal(size=n), "b": r.integers(0, 4, n).astype(float), "c": r.exponential(size=n), "fold": r.integers(0, 3, n)})
    pdf["y"] = 2 * pdf["a"] + np.sin(pdf["c"]) * 3 + (pdf["b"] > 1) + r.normal(scale=0.1, size=n)
    return pdf


TREES = [[(0, 0.3, 1, 2, 0.0), (2, 1.0, 3, 4, 0.0), (-1, 0.0, 0, 0, 5.0), (-1, 0.0, 0, 0, -2.0), (1, 1.5, 5, 6, 0.0), (-1, 0.0, 0, 0, 1.0), (-1, 0.0, 0, 0, 8.0)], [(-1, 0.0, 0, 0, 4.0)]]


def by_hand(row):
    def walk(nodes, k):
        f, at, left, right, value = nodes[k]
        return value if f < 0 else walk(nodes, left if row[f] <= at else right)
    return np.mean([walk(t, 0) for t in TREES])


def models(spark):
    return M.model_table(spark, [{"model": "line", "kind": "linear", "intercept": 1.0, "coef": [2.0, -1.0, 0.5]}, {"model": "forest", "kind": "trees", "intercept": 0.0, "trees": TREES}])


def predictors():
    return {"line": lambda m: 1.0 + m @ np.array([2.0, -1.0, 0.5]), "forest": lambda m: np.array([by_hand(r) for r in m])}


def test_partial_dependence_averages_over_rows(spark, data):
    """Rows with missing or infinite inputs take no part; a column of few values uses them as its grid."""
    dirty = pd.concat([data, pd.DataFrame({"a": [np.nan, 1.0], "b": [1.0, np.inf], "c": [1.0, 1.0]})])
    df = spark.createDataFrame(dirty).repartition(5)
    grid = M.quantile_points(df, X, np.linspace(0.05, 0.95, 7), few=5)
    got = M.partial_dependence(df, models(spark), X, grid).toPandas()
    m = data[list(X)].to_numpy()
    assert set(got[got["feature"] == "b"]["x"]) == {0.0, 1.0, 2.0, 3.0} and (got["n"] == len(data)).all()
    assert np.allclose(sorted(set(got[got["feature"] == "a"]["x"])), np.quantile(data["a"], np.linspace(0.05, 0.95, 7)))
    for name, predict in predictors().items():
        for r in got[got["model"] == name].itertuples():
            moved = m.copy()
            moved[:, X.index(r.feature)] = r.x
            assert abs(predict(moved).mean() - r.response) < 1e-9


@pytest.mark.parametrize("bins", [3, 11])
def test_accumulated_effects(spark, data, bins):
    df = spark.createDataFrame(data).repartition(5)
    got = M.accumulated_effects(df, models(spark), X, bins).toPandas()
    m = data[list(X)].to_numpy()
    for name, predict in predictors().items():
        for j, c in enumerate(X):
            edges = np.unique(np.quantile(m[:, j], np.linspace(0, 1, bins + 1)))
            effect, counts = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                inside = (m[:, j] >= lo) & ((m[:, j] <= hi) if hi == edges[-1] else (m[:, j] < hi))
                low, high = m[inside].copy(), m[inside].copy()
                low[:, j], high[:, j] = lo, hi
                effect.append((predict(high) - predict(low)).mean())
                counts.append(inside.sum())
            curve = np.cumsum(effect)
            curve -= np.average(curve, weights=counts)
            told = got[(got["model"] == name) & (got["feature"] == c)].sort_values("bin")
            assert np.allclose(told["effect"], curve, atol=1e-9) and told["n"].tolist() == counts


def test_additive_model_and_curves(spark, data):
    """The spline fit against least squares on the same columns, and its response with the others at their mean."""
    df = spark.createDataFrame(data)
    model = M.additive_model(df, X, "y", alpha=1.0)
    m = data[list(X)].to_numpy()
    basis = np.hstack([M.spline_columns(m[:, j], m[:, j].min(), m[:, j].max()) for j in range(3)])
    centred, y = basis - basis.mean(axis=0), data["y"].to_numpy()
    beta = np.linalg.solve(centred.T @ centred + np.eye(12), centred.T @ (y - y.mean()))
    row = model.first()
    assert np.allclose(row["coef"], beta, atol=1e-6) and abs(row["intercept"] - (y.mean() - basis.mean(axis=0) @ beta)) < 1e-6
    got = M.response_at_means(df, model, X, M.quantile_points(df, X, np.linspace(0.05, 0.95, 25))).toPandas()
    for r in got.itertuples():
        at = m.mean(axis=0)
        at[X.index(r.feature)] = r.x
        want = row["intercept"] + np.hstack([M.spline_columns(at[j:j + 1], m[:, j].min(), m[:, j].max()) for j in range(3)]) @ beta
        assert abs(want[0] - r.response) < 1e-6


def test_importance_of_trees_and_lines(spark, data):
    df = spark.createDataFrame(data).repartition(4)
    both = models(spark).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    got = M.permutation_importance(df, both, X, "y", "fold", "id", 6, 12).toPandas()
    keys = N.round_keys(12, 0, 6)
    assert len(got) == 2 * 3 * 3
    for fold, part in data.groupby("fold"):
        m, y = part.sort_values("id")[list(X)].to_numpy(), part.sort_values("id")["y"].to_numpy()
        null = ((y - data[data["fold"] != fold]["y"].mean()) ** 2).sum()
        p = N.partners(np.arange(len(m)), np.full(len(m), len(m)), keys)
        for name, predict in predictors().items():
            base = 1 - ((y - predict(m)) ** 2).sum() / null
            for j, c in enumerate(X):
                q = []
                for r in range(6):
                    moved = m.copy()
                    moved[:, j] = m[p[:, r], j]
                    q.append(1 - ((y - predict(moved)) ** 2).sum() / null)
                told = got[(got["model"] == name) & (got["fold"] == fold) & (got["feature"] == c)].iloc[0]
                assert abs(told["q2_base"] - base) < 1e-9 and abs(told["importance"] - (base - np.mean(q))) < 1e-9


def test_exported_trees_predict_like_their_model(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    rows = VectorAssembler(inputCols=list(X), outputCol="features").transform(spark.createDataFrame(data))
    model = RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=4, seed=1).fit(rows)
    own = M.Fitted.of({"kind": "trees", "intercept": 0.0, "coef": None, "lo": None, "hi": None, "trees": [[dict(zip(("feature", "cut", "left", "right", "value"), n)) for n in t] for t in M.exported_trees(model)]})
    told = model.transform(rows).select("id", "prediction").toPandas().sort_values("id")["prediction"]
    assert np.allclose(own.predict(data[list(X)].to_numpy()), told, atol=1e-9)


def test_empty_frame(spark, data):
    none = spark.createDataFrame(data).where("false")
    assert M.accumulated_effects(none, models(spark), X, 4).count() == 0
    assert M.partial_dependence(none, models(spark), X, M.quantile_points(none, X, [0.5])).count() == 0
    assert L.ALPHA_GRID

"""Model queries without a SQL twin, replayed in NumPy on the smallest data folder."""
import numpy as np
import pytest

from graticule.catalog import REGISTRY
from graticule.catalog.models import frame
from graticule.catalog.registry import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return frame(Tables(spark, FOLDER)).toPandas().astype({"x3": float})


def run(spark, name):
    return REGISTRY[name].run(spark, FOLDER).toPandas()


def ridge(x, y, w, alpha, standardise=True):
    w = w / w.sum()
    mean, scale = w @ x, np.ones(x.shape[1])
    if standardise:
        scale = np.sqrt(np.maximum(w @ (x - mean) ** 2, 0))
        scale[scale < 1e-12] = 1
    z, my, s = (x - mean) / scale, w @ y, w * len(y)
    beta = np.linalg.solve((z * s[:, None]).T @ z + alpha * np.eye(z.shape[1]), (z * s[:, None]).T @ (y - my))
    return lambda q: my + (q - mean) / scale @ beta


def bspline(x, lo, hi):
    """Cox-de Boor recursion on the uniform knots that extend [lo, hi] by two intervals on both sides."""
    h = (hi - lo) / 3
    t = lo + h * np.arange(-2, 6)
    b = [((x >= t[i]) & (x < t[i + 1])).astype(float) for i in range(7)]
    b[4] = np.where(x == hi, 1.0, b[4])
    b[5] = np.where(x == hi, 0.0, b[5])
    for k in (1, 2):
        b = [(x - t[i]) / (t[i + k] - t[i]) * b[i] + (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * b[i + 1] for i in range(len(b) - 1)]
    return np.column_stack(b[:4])


def test_residual_stack(spark, data):
    got = run(spark, "M11_residual_stack").set_index("fold")
    for k in range(5):
        train, test = data[data["fold"] != k], data[data["fold"] == k]
        res = np.zeros(len(train))
        for j in range(3):
            a, b = train[train["inner"] != j], (train["inner"] == j).to_numpy()
            res[b] = train["y"][b] - ridge(a[["x1"]].to_numpy(), a["y"].to_numpy(), np.ones(len(a)), 1.0)(train[["x1"]].to_numpy()[b])
        first = ridge(train[["x1"]].to_numpy(), train["y"].to_numpy(), np.ones(len(train)), 1.0)(test[["x1"]].to_numpy())
        second = ridge(train[["x2", "x3"]].to_numpy(), res, np.ones(len(train)), 1.0)(test[["x2", "x3"]].to_numpy())
        ss0 = ((test["y"] - train["y"].mean()) ** 2).sum()
        assert got.loc[k, "q2_first"] == pytest.approx(1 - ((test["y"] - first) ** 2).sum() / ss0, abs=1e-5)
        assert got.loc[k, "q2_stack"] == pytest.approx(1 - ((test["y"] - first - second) ** 2).sum() / ss0, abs=1e-5)


def test_gam_basis_against_recursion(spark):
    from pyspark.sql import functions as F
    from graticule.operators import linear as L
    x = np.linspace(-1.5, 4.5, 49)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = df.select(*[b.alias(f"b{k}") for k, b in enumerate(L.spline_basis(F.col("x"), F.lit(-1.5), F.lit(4.5)))]).toPandas().to_numpy()
    assert np.allclose(got, bspline(x, -1.5, 4.5))


def test_ablation_groups(spark, data):
    got = run(spark, "M15_ablation_groups").set_index("removed")["median_drop"]
    designs = {"full": ["x1", "x2", "x3"], "x1": ["x2", "x3"], "x2": ["x1", "x3"], "x3": ["x1", "x2"], "x1+x2": ["x3"]}
    q = {n: [] for n in designs}
    for k in range(5):
        train, test = data[data["fold"] != k], data[data["fold"] == k]
        for n, c in designs.items():
            p = ridge(train[c].to_numpy(), train["y"].to_numpy(), np.ones(len(train)), 1.0)(test[c].to_numpy())
            q[n].append(1 - ((test["y"] - p) ** 2).sum() / ((test["y"] - train["y"].mean()) ** 2).sum())
    for n in got.index:
        assert got[n] == pytest.approx(np.median(np.array(q["full"]) - np.array(q[n])), abs=1e-5)


def test_fold_pca(spark):
    got = run(spark, "M22_fold_pca").set_index("fold")
    e = Tables(spark, FOLDER).embeddings.toPandas()
    x, fold = np.stack(e["embedding"]).astype(float), e["label"].to_numpy() % 5
    for k in got.index:
        tr, te = x[fold != k], x[fold == k]
        w, v = np.linalg.eigh(np.cov(tr.T, bias=True))
        top = v[:, np.argsort(w)[::-1][:3]]
        c = te - tr.mean(0)
        assert got.loc[k, "test_rmse"] == pytest.approx(np.sqrt(((c - c @ top @ top.T) ** 2).mean()), abs=1e-5)
        assert got.loc[k, "evr"] == pytest.approx(np.sort(w)[::-1][:3].sum() / w.sum(), abs=1e-5)


@pytest.mark.parametrize("name, rows", [("M9_gam", 5), ("M12_tree_regressor_cv", 5), ("M12_matched_trees", 5), ("M12_matched_trees_delta", 4), ("M19_permutation_importance", 3), ("M23_conditional_subset_stability", 3), ("S7_verify_seal", 14), ("S11_latest_run", 1)])
def test_runs_whole(spark, name, rows):
    got = run(spark, name)
    assert len(got) == rows and not got.isna().any().any()


def test_ridge_on_columns_as_they_are():
    """Unstandardised penalty against the normal equations of the weighted, centred design."""
    from graticule.operators.linear import solve_ridge
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(size=(80, 3)) * [1, 10, 0.1], rng.normal(size=80), rng.uniform(0.5, 2, 80)
    v = np.column_stack([np.ones(80), x, y])
    b0, b = solve_ridge((v * w[:, None]).T @ v, 80, [0, 1, 2], 2.0, standardise=False)
    w = w / w.sum() * 80
    mean, my = (w @ x) / 80, (w @ y) / 80
    want = np.linalg.solve(((x - mean) * w[:, None]).T @ (x - mean) + 2.0 * np.eye(3), ((x - mean) * w[:, None]).T @ (y - my))
    assert np.allclose(b, want) and np.isclose(b0, my - mean @ want)


def test_tabular_cv_reads_the_joined_tables_once(spark):
    import __spark_entry__ as entry
    got = entry.queries()["M13_tabular_cv"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString() and "l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["model"]: r["n"] for r in got.collect()} == {"gbt": spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()} | {"linear": spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()}

"""Exact neighbours by a metric partition against tiles and all pairs."""
import numpy as np
import pandas as pd
import pytest

from graticule.plans import cells as C
from graticule.plans import tiles as T


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)}), "id long, v array<double>").repartition(6)


def plain(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return {(i, r + 1): (int(j), d[i, j]) for i, row in enumerate(order) for r, j in enumerate(row) if np.isfinite(d[i, j])}


@pytest.mark.parametrize("n, cell", [(1, 64), (4, 64), (900, 32), (700, 4)])
def test_equals_all_pairs(spark, monkeypatch, n, cell):
    """Clusters, repeated points (ties to the smaller id), fewer rows than neighbours, tiny cells."""
    monkeypatch.setattr(C, "CELL_ROWS", cell)
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 6)) + r.choice([0, 9, 40], (n, 1))
    x[n // 2: n // 2 + n // 10] = x[0]
    got = {(a["src"], a["rk"]): (a["dst"], a["dist"]) for a in C.nearest(frame(spark, x), "id", "v", 5).collect()}
    want = plain(x, 5)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_clustered_data_is_pruned(spark):
    r = np.random.default_rng(4)
    centres = r.normal(scale=60, size=(40, 8))
    x = centres[r.integers(0, 40, 12_000)] + r.normal(size=(12_000, 8))
    row = C.compared(frame(spark, x), "id", "v", 5).first()
    assert row["n"] == 12_000 and row["share"] < 0.1


def test_equals_tiles_on_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id", "transform(embedding, x -> cast(x AS double)) AS e")
    one = C.nearest(v, "vec_id", "e", 5).select("src", "rk", "dist").toPandas().sort_values(["src", "rk"])
    two = T.nearest(v, "vec_id", "e", 5).select("src", "rk", "dist").toPandas().sort_values(["src", "rk"])
    assert (one["src"].to_numpy() == two["src"].to_numpy()).all() and np.allclose(one["dist"], two["dist"], atol=1e-7)


def test_empty(spark):
    assert C.nearest(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 3).count() == 0


def test_frames_of_visits_are_bounded(spark, monkeypatch):
    """Data without structure: every row visits every block, the vectors of a frame stay few."""
    monkeypatch.setattr(C, "CELL_ROWS", 16)
    monkeypatch.setattr(C, "VISITS", 50)
    frames, long = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Watched:
        def __getattr__(self, name):
            return getattr(pd, name)

        def DataFrame(self, data):  # noqa: N802
            if "member" in data:
                frames.add(1)
                long.add(int(len(data["id"]) > 50))
            return pd.DataFrame(data)
    monkeypatch.setattr(C, "pd", Watched())
    x = np.random.default_rng(5).normal(size=(600, 12))
    got = {(a["src"], a["rk"]): a["dst"] for a in C.nearest(frame(spark, x), "id", "v", 3).collect()}
    assert got == {k: v[0] for k, v in plain(x, 3).items()}
    assert frames.value > 0 and long.value == 0


def test_rows_travel_once_per_area(spark, monkeypatch):
    """Data without structure: a row is sent to every other area, not to every block."""
    monkeypatch.setattr(C, "CELL_ROWS", 16)
    monkeypatch.setattr(C, "AREAS", 4, raising=False)
    sent = spark.sparkContext.accumulator(0)

    class Watched:
        def __getattr__(self, name):
            return getattr(pd, name)

        def DataFrame(self, data):  # noqa: N802
            if "member" in data:
                sent.add(len(data["id"]))
            return pd.DataFrame(data)
    monkeypatch.setattr(C, "pd", Watched())
    x = np.random.default_rng(6).normal(size=(800, 12))
    got = {(a["src"], a["rk"]): a["dst"] for a in C.nearest(frame(spark, x), "id", "v", 3).collect()}
    assert got == {k: v[0] for k, v in plain(x, 3).items()}
    assert 0 < sent.value <= 3 * 800


def test_areas_held_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_ROWS", 4)
    monkeypatch.setattr(C, "AREAS", 3)
    monkeypatch.setattr(C, "TASKS", 9)
    monkeypatch.setattr(C, "CHUNK", 20)
    monkeypatch.setattr(C, "RUN_ROWS", 32)
    x = np.random.default_rng(7).normal(size=(500, 5)).round(1)  # ties; not exact in single precision
    got = {(a["src"], a["rk"]): (a["dst"], a["dist"]) for a in C.nearest(frame(spark, x), "id", "v", 4).collect()}
    want = plain(x, 4)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_equal_rows_are_measured_once(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_ROWS", 16)
    x = np.random.default_rng(8).normal(size=(90, 4))
    x = np.concatenate([x] * 9)
    row = C.compared(frame(spark, x), "id", "v", 5).first()
    assert row["n"] == 810 and row["n_compared"] <= 90 * 89
    got = {(a["src"], a["rk"]): a["dst"] for a in C.nearest(frame(spark, x[:270]), "id", "v", 5).collect()}  # two copies, then others
    want = plain(x[:270], 5)
    assert got == {k: v[0] for k, v in want.items()}


@pytest.mark.parametrize("scale", [1e-25, 1e18, 1e40])
def test_huge_and_tiny_vectors(spark, scale):
    x = np.random.default_rng(9).normal(size=(120, 4)) * scale
    got = {(a["src"], a["rk"]): a["dst"] for a in C.nearest(frame(spark, x), "id", "v", 3).collect()}
    assert got == {k: v[0] for k, v in plain(x, 3).items()}


def test_symmetric_graph_searches_once(spark):
    """Both directions of an edge come from one pass over the neighbours."""
    from graticule.operators.graph import symmetric_weights
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf
    n = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long").coalesce(1).mapInPandas(count, "src long, dst long")
    got = {(r["src"], r["dst"]): r["w"] for r in symmetric_weights(n).collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.5, (2, 1): 1.0, (3, 1): 1.0}
    assert read.value == 3

"""Order statistics, series and tiles against brute force, with hot groups and many slices."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import sequences as Q
from graticule.operators.joins import asof_nearest, nearest_key
from graticule.plans import order_stats as O
from graticule.plans import series as S
from graticule.plans import tiles as T


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    g = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 9, 3000))
    return pd.DataFrame({"g": g, "id": np.arange(3000), "v": np.where(rng.random(3000) < 0.35, 1.5, rng.normal(size=3000).round(3))})


def test_quantiles_and_ranks(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = O.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.93}).toPandas().set_index("g").sort_index()
    want = skewed.groupby("g")["v"].quantile([0.1, 0.5, 0.93]).unstack()
    assert np.allclose(got[["a", "m", "z"]], want.to_numpy())
    whole = O.quantiles(df, [], "v", {"m": 0.37}).first()["m"]
    assert np.isclose(whole, np.quantile(skewed["v"], 0.37))
    ranks = O.with_average_rank(df, ["g"], "v", "r").toPandas().sort_values("id")
    assert np.allclose(ranks["r"], skewed.groupby("g")["v"].rank())
    down = O.with_average_rank(df, [], "v", "r", descending=True).toPandas().sort_values("id")
    assert np.allclose(down["r"], skewed["v"].rank(ascending=False))


def test_ordinal(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("h", F.md5(F.col("id").cast("string")))
    got = O.ordinal(df, ["g"], [F.col("h")], [F.substring("h", 1, 1)], "pos").toPandas()
    want = got.groupby("g")["h"].rank().astype(int)
    assert (got["pos"] == want).all()


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    n = 1200
    return pd.DataFrame({"k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 5, n)), "s": np.cumsum(rng.exponential(1.0, n)), "f": rng.random(n) < 0.6, "v": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n))})


def test_a_dense_hour_is_cut_like_any_stretch(spark):
    """A third of all rows lie in one hour of one series; rows at one position stay in one slice."""
    rng = np.random.default_rng(3)
    hot = np.concatenate([rng.uniform(100, 101, 20_000), rng.uniform(0, 5000, 2000), np.full(300, 100.5)])
    other = rng.uniform(0, 5000, 40_000)
    df = spark.createDataFrame(pd.DataFrame({"k": [1] * len(hot) + (2 + np.arange(len(other)) % 50).tolist(), "s": np.concatenate([hot, other])}))
    out = S.sliced(df, ["k"], "s", 1000).groupBy("k", S.SLICE).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).toPandas()
    one = out[out["k"] == 1].sort_values(S.SLICE)
    assert len(one) > 18 and one["n"].max() < 2000 and out[out["k"] != 1][S.SLICE].eq(0).all()
    assert (one["hi"].to_numpy()[:-1] < one["lo"].to_numpy()[1:]).all()  # slices follow each other, equal positions together


@pytest.mark.parametrize("width", [2, 50, S.SLICE_ROWS])
def test_series_primitives(spark, walk, width):
    df = spark.createDataFrame(walk).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    p = walk.sort_values("s")
    out = S.with_previous(df, ["k"], "s", F.col("s"), "prev", width)
    out = S.with_previous(out, ["k"], "s", F.col("s"), "nxt", width, forward=True)
    out = S.with_running_sum(out, ["k"], "s", F.col("f").cast("long"), "cum", width)
    out = S.with_last_seen(out, ["k"], "s", F.col("v"), "last", width)
    out = S.with_last_seen(out, ["k"], "s", F.col("v"), "next_v", width, forward=True).toPandas().sort_values("s")
    g = p.groupby("k")
    assert np.allclose(out["prev"], g["s"].shift(1), equal_nan=True)
    assert np.allclose(out["nxt"], g["s"].shift(-1), equal_nan=True)
    assert (out["cum"].to_numpy() == p["f"].astype(int).groupby(p["k"]).cumsum().to_numpy()).all()
    assert np.allclose(out["last"].astype(float), g["v"].ffill(), equal_nan=True)
    assert np.allclose(out["next_v"].astype(float), g["v"].bfill(), equal_nan=True)


def test_runs_and_merge(spark, walk):
    df = spark.createDataFrame(walk)
    runs = Q.threshold_runs(df, ["k"], "s", F.col("f"), 3.0).toPandas()
    want = []
    for k, g in walk.sort_values("s").groupby("k"):
        block = (g["f"] != g["f"].shift()).cumsum()
        for _, r in g[g["f"]].groupby(block):
            want.append((k, r["s"].min(), r["s"].max(), len(r)))
    got = sorted(map(tuple, runs[["k", "s0", "s1", "n"]].to_numpy()))
    assert np.allclose(got, sorted(want))
    assert Q.merge_runs(spark.createDataFrame(runs), ["k"], 1e9, 3.0).count() == walk["k"].nunique()


def test_min_spacing_is_the_greedy_choice(spark, walk):
    got = Q.min_spacing(spark.createDataFrame(walk), ["k"], "s", 4.0).toPandas()
    for k, g in walk.groupby("k"):
        kept = []
        for s in np.sort(g["s"]):
            if not kept or s >= kept[-1] + 4.0:
                kept.append(s)
        assert np.allclose(np.sort(got[got["k"] == k]["s"]), kept)


def test_min_spacing_on_a_regular_grid(spark):
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("s"))
    got = sorted(r["s"] for r in Q.min_spacing(df, ["k"], "s", 3.0).collect())
    assert got == [float(v) for v in range(0, 200, 3)]


def test_asof_nearest_and_ties(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 100.0), (2, 5.0)], "k long, s double")
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b"), (1, 20.0, "c"), (3, 5.0, "d")], "k long, s double, v string")
    before = {(r["k"], r["s"]): r["match_value"] for r in asof_nearest(left, right, ["k"], "s", "v", 5.0, 4.0).collect()}
    after = {(r["k"], r["s"]): r["match_value"] for r in asof_nearest(left, right, ["k"], "s", "v", 5.0, 4.0, ties="after").collect()}
    assert before == {(1, 10.0): "a", (1, 20.0): "c", (1, 100.0): None, (2, 5.0): None}
    assert after[(1, 10.0)] == "b"


def test_nearest_key_is_one_path_and_keeps_null(spark):
    df = spark.createDataFrame([(float(k) * 1.3,) for k in range(40)] + [(None,)], "x double")
    keys = [0.0, 7.0, 7.5, 31.0, 60.0]
    got = {r["x"]: r["nearest"] for r in nearest_key(df, "x", spark.createDataFrame([(k,) for k in keys], "k double"), "k").collect()}
    assert len(got) == 41 and got.pop(None) is None
    assert got == {x: min(keys, key=lambda k: (abs(k - x), k)) for x in got}


def test_series_keep_rows_of_null_keys_and_positions(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "u string, s double")
    right = spark.createDataFrame([("a", 1.5, 7.0), (None, 2.0, 8.0), ("a", None, 9.0)], "u string, s double, v double")
    got = {(r["u"], r["s"]): r["match_value"] for r in asof_nearest(left, right, ["u"], "s", "v", 5.0, 1.0).collect()}
    assert got == {("a", 1.0): 7.0, ("a", None): None, (None, 2.0): None}
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 9.0, 2), ("a", None, 3), (None, 1.0, 4), (None, 30.0, 5)], "u string, s double, v int")
    before = {(r["u"], r["s"]): r["p"] for r in S.with_previous(rows, ["u"], "s", F.col("v"), "p", 2.0).collect()}
    assert before == {("a", 1.0): None, ("a", 9.0): 1, ("a", None): None, (None, 1.0): None, (None, 30.0): 4}
    total = {(r["u"], r["s"]): r["t"] for r in S.with_running_sum(rows, ["u"], "s", F.col("v"), "t", 2.0).collect()}
    assert total == {("a", 1.0): 1, ("a", 9.0): 3, ("a", None): None, (None, 1.0): 4, (None, 30.0): 9}


def test_tiles_cover_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE_ROWS", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(int(i), int(i % 3), [float(v) for v in r]) for i, r in enumerate(x)], "id long, grp_col long, e array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    iu = np.triu_indices(90, 1)
    measure = lambda a, b: ((a["grp_col"].to_numpy()[:, None] == b["grp_col"].to_numpy()[None]).astype(int), T.distances(T.matrix(a, "e"), T.matrix(b, "e")))
    got = T.pair_quantiles(df, "id", ["grp_col", "e"], measure, {"q1": 0.1, "q2": 0.5}).toPandas().set_index("grp").sort_index()
    same = (np.arange(90) % 3)[iu[0]] == (np.arange(90) % 3)[iu[1]]
    for g, keep in ((0, ~same), (1, same)):
        assert got.loc[g, "n_pairs"] == keep.sum()
        assert np.allclose(got.loc[g, ["q1", "q2"]].astype(float), np.quantile(d[iu][keep], [0.1, 0.5]))
    near = T.nearest(df, "id", "e", 4).toPandas().sort_values(["src", "rk"])
    full = d + np.diag(np.full(90, np.inf))
    assert np.allclose(near["dist"].to_numpy().reshape(90, 4), np.sort(full, axis=1)[:, :4])
    tot = T.pair_totals(df, "id", ["grp_col", "e"], measure).toPandas()
    assert tot["n"].sum() == 90 * 89 // 2 and np.isclose(tot["s"].sum(), d[iu].sum())


def test_quantiles_of_many_values_do_not_depend_on_the_evaluation(spark):
    """Far more distinct values than a sketch keeps, merged in any order: offsets and rows must use the same buckets."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(scale=200, size=200_000), 1e9 + rng.random(100_000), np.zeros(50)])
    pdf = pd.DataFrame({"g": np.arange(len(x)) % 3, "x": rng.permutation(x)})
    df = spark.createDataFrame(pdf).repartition(24)
    got = O.quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part["x"], [0.1, 0.5, 0.9]), rtol=1e-12, atol=1e-12)


def test_buckets_follow_the_order_of_values(spark):
    values = [float("-inf"), -1e300, -2.0, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 1.0, 1.001, 2.0, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", O._bucket(F.col("x")).alias("b")).collect()
    codes = [r["b"] for r in rows]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)
    total = O.running_totals(O.value_counts(spark.createDataFrame([(float(v),) for v in values], "x double"), [], "x"), [], "x").orderBy("x").collect()
    assert [r["_before"] for r in total] == list(range(len(values)))


def test_equal_rows_travel_once_and_blocks_hold_many_matrices(spark, monkeypatch):
    """Copies weigh in as pairs, zeros stay exact, and a row is sent once per block, however many matrices a block holds."""
    monkeypatch.setattr(T, "TILE_ROWS", 8)
    monkeypatch.setattr(T, "BLOCKS", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))[rng.integers(0, 40, 300)] * 1e3
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(300, 1)]
    measure = lambda a, b: [(0, T.distances(T.matrix(a, "e"), T.matrix(b, "e"))), (1, 2 * T.distances(T.matrix(a, "e"), T.matrix(b, "e")))]
    got = {r["grp"]: r for r in T.pair_quantiles(df, "id", ["e"], measure, {"a": 0.01, "b": 0.3, "c": 0.9}).collect()}
    for g in (0, 1):
        assert got[g]["n_pairs"] == len(d)
        assert np.allclose([got[g][c] for c in "abc"], (g + 1) * np.quantile(d, [0.01, 0.3, 0.9]))
    assert got[0]["a"] == 0.0
    sums = {r["grp"]: r for r in T.pair_totals(df, "id", ["e"], measure).collect()}
    assert sums[0]["n"] == len(d) and np.isclose(sums[1]["s"], 2 * d.sum())
    sent = []
    monkeypatch.setattr(T.F, "explode", lambda c, real=F.explode: (sent.append(c), real(c))[1])
    seen = T.scan(df, "id", ["e"], lambda a, b, m: pd.DataFrame({"n": [int(m.sum())]}), "n long").toPandas()
    assert seen["n"].sum() == len(d) and len(seen) > 6 and "2" in str(sent[0])


def test_pair_quantiles_add_up_a_third_matrix(spark):
    """Groups, sums and quantiles of one pass; equal rows, zeros and ignored pairs among them."""
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 3))
    x[200:260] = x[0]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "e": list(x)}), "id long, e array<double>").repartition(3)

    def measure(a, b):
        d = T.distances(T.matrix(a, "e"), T.matrix(b, "e"))
        return [((d > 1).view(np.int8) + (d > 2), d, d * d), (np.where(d < 1.5, np.int8(7), np.int8(-1)), d, d)]
    got = T.pair_quantiles(df, "id", ["e"], measure, {"m": 0.5}).toPandas().set_index("grp")
    i, j = np.triu_indices(300, 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    for g, v, s in [(0, d[d <= 1], d[d <= 1] ** 2), (1, d[(d > 1) & (d <= 2)], d[(d > 1) & (d <= 2)] ** 2), (2, d[d > 2], d[d > 2] ** 2), (7, d[d < 1.5], d[d < 1.5])]:
        row = got.loc[g]
        assert row["n_pairs"] == len(v) and abs(row["m"] - np.median(v)) < 1e-9 and abs(row["sum"] - s.sum()) < 1e-7 * (1 + s.sum())


def test_distances_keep_no_further_matrix():
    """Beside its result a call holds a few rows of distances."""
    import tracemalloc
    x = np.random.default_rng(12).normal(size=(1024, 16))
    x[5] = x[900]
    tracemalloc.start()
    d = T.distances(x, x[:1000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert d[5, 900] == 0 and np.allclose(d, np.sqrt(((x[:, None, :] - x[None, :1000, :]) ** 2).sum(axis=2)), atol=1e-9)
    assert peak < 1.15 * d.nbytes

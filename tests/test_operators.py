"""Analytic, invariance, negative and NumPy cross-checks."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.functions import composition as C
from graticule.functions import transforms as TR
from graticule.operators import contracts as K
from graticule.operators import dropouts as D
from graticule.operators import folds as FO
from graticule.operators import graph as G
from graticule.operators import linear as L
from graticule.operators import maps as M
from graticule.operators import planes as P
from graticule.operators import resampling as B
from graticule.operators import spectra as S
from graticule.sources import readers as R
from graticule.sources import seals as SE


def as_maps(spark, cube, valid=None):
    rows = [(int(i), 0, m.shape[0], m.shape[1], [float(v) for v in m.ravel()], [bool(b) for b in (np.ones(m.size) if valid is None else valid[i].ravel())]) for i, m in enumerate(cube)]
    return spark.createDataFrame(rows, "map_id long, label long, n_rows int, n_cols int, z array<double>, valid array<boolean>")


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).normal(size=(6, 12, 12))


def test_single_mode_lands_in_its_band(spark):
    n, d = 16, 2.0
    mode = np.outer(TR.dct_basis(n)[0], TR.dct_basis(n)[4])
    row = S.band_composition(S.dct_table(as_maps(spark, [mode]), n, n, d)).first()
    assert row["p_16_32"] == pytest.approx(1.0)  # wavelength 2 * n * d / 4 = 16


def test_parseval_and_translation_invariance(spark, cube):
    m = as_maps(spark, cube)
    e = S.band_energies(S.dct_table(m, 12, 12, 0.5)).toPandas().sort_values("map_id")
    total = e[[c for c in e.columns if c.startswith("e_")]].sum(axis=1)
    assert np.allclose(total, (cube**2).sum(axis=(1, 2)))
    moved = m.withColumn("z", F.transform("z", lambda v: v + 3.7))
    for fn in (lambda x: M.ranges(x), lambda x: M.moments(x), lambda x: M.gradient_stats(x, 0.5), lambda x: S.acf_radial_length(x, 12, 12, 0.5)):
        a, b = (fn(M.residualised(x)).toPandas().sort_values("map_id").drop(columns="map_id") for x in (m, moved))
        assert np.allclose(a, b, atol=1e-9)


def test_gradient_matches_numpy(spark, cube):
    got = M.gradient_stats(as_maps(spark, cube), 0.5).toPandas().sort_values("map_id")
    gy, gx = np.gradient(cube, 0.5, axis=(1, 2))
    assert np.allclose(got["slope_rms"], np.sqrt((gx**2 + gy**2).mean(axis=(1, 2))))


def test_missing_cells_are_never_filled(spark, cube):
    valid = np.ones_like(cube, dtype=bool)
    valid[2, 3, 4] = False
    m = as_maps(spark, cube, valid)
    assert M.cells(M.masked(m)).where("map_id = 2 AND r = 3 AND c = 4").first()["z"] is None
    assert S.dct_table(M.masked(m), 12, 12, 0.5).where("map_id = 2").count() == 0
    vector, validity = S.observe(m, 12, 12, 0.5, 12)
    assert vector.where("map_id = 2").first()["ilr1"] is None
    assert {r["reason"] for r in validity.where("map_id = 2").collect()} == {"INCOMPLETE_GRID"}


def test_observation_is_one_narrow_pass(spark, cube, tmp_path):
    as_maps(spark, cube).write.parquet(f"{tmp_path}/maps")
    for part in S.observe(spark.read.parquet(f"{tmp_path}/maps"), 12, 12, 0.5, 12):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_observation_equals_the_single_descriptors(spark, cube):
    m = as_maps(spark, cube)
    got = S.observe(m, 12, 12, 0.5, 12)[0].toPandas().set_index("map_id").sort_index()
    wide = S.directional_metrics(S.power_table(M.residualised(m), 12, 12, 0.5), [b for b in S.BANDS if b[0] == "8_16"], 12).toPandas().set_index("map_id").sort_index()
    assert np.allclose(got.loc[wide.index, "a2_8_16"].astype(float), wide["a2"]) and np.allclose(got.loc[wide.index, "entropy_8_16"].astype(float), wide["entropy"])


def test_ilr_round_trip_and_orthonormality(spark):
    a = np.array(C.BALANCES)
    assert np.allclose(a @ a.T, np.eye(4)) and np.allclose(a.sum(axis=1), 0)
    p = spark.createDataFrame([(0.1, 0.2, 0.3, 0.15, 0.25)], "a double, b double, c double, d double, e double")
    parts = [F.col(c) for c in "abcde"]
    back = p.select(*[c.alias(f"p{k}") for k, c in enumerate(C.ilr_inverse(C.ilr(parts)))]).first()
    assert np.allclose(list(back), [0.1, 0.2, 0.3, 0.15, 0.25])


def test_gaussian_basis_and_bandpass_partition(spark, cube):
    assert np.allclose(TR.gaussian_basis(12, 1.5).sum(axis=1), 1.0)
    bands = S.bandpass(as_maps(spark, cube), 12, 12, 0.5).toPandas()
    total = sum(np.stack(bands[f"z_{n}"]) for n, _, _ in S.BANDS)
    assert np.allclose(total, np.stack(bands["z"]))


def test_stripe_orientation(spark):
    y, x = np.mgrid[0:32, 0:32]
    stripes = np.cos(2 * np.pi * x / 8)  # varies along x: wave vector at 0 degrees, stripes at 90
    d = S.directional_metrics(S.power_table(as_maps(spark, [stripes]), 32, 32, 1.0), [("all", 4.0, 16.0)], 36).first()
    assert d["a2"] > 0.9 and abs(d["stripe_deg"] - 90) < 1


def test_isotropic_null_keeps_radial_power(spark, cube):
    m = as_maps(spark, cube)
    z = m.select("map_id", "z", P.isotropic_null(F.col("z"), F.col("map_id"), 12, 12, 5).alias("n")).toPandas()
    for a, b in zip(z["z"], z["n"]):
        assert np.isclose((np.asarray(a) ** 2).sum(), (np.asarray(b) ** 2).sum(), rtol=1e-6)


def test_robust_plane_ignores_a_groove(spark):
    y, x = np.mgrid[0:20, 0:20].astype(float)
    z = 0.02 * (x - 9.5) - 0.01 * (y - 9.5) + 3 + np.random.default_rng(2).normal(scale=1e-3, size=(20, 20))
    z[:, 8:11] -= 5
    fit = P.plane_fits(as_maps(spark, [z]), 20, 20, 1.0).first()["plane"]
    assert fit["a"] == pytest.approx(0.02, abs=1e-3) and fit["b"] == pytest.approx(-0.01, abs=1e-3) and fit["c"] == pytest.approx(3, abs=1e-2)


def test_clipped_planes_equal_one_map_at_a_time():
    """The batch against least squares per map, with missing cells, a flat map and maps that settle at different rounds."""
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:12, 0:12].astype(float)
    basis = np.column_stack([(x - 5.5).ravel(), (y - 5.5).ravel(), np.ones(144)])
    z = rng.normal(size=(6, 144)) * 0.1 + basis @ rng.normal(size=3)
    z[1, :40] -= 4
    z[2, rng.random(144) < 0.3] = np.nan
    z[3], z[4] = basis @ [1, 2, 3], np.nan
    got = P.clipped_planes(z, basis, 2.5, 4.0, 12, 10, 0.15)
    for v, r in zip(z, got.itertuples()):
        ok = np.flatnonzero(np.isfinite(v))
        if len(ok) < 3:
            assert r.a is None
            continue
        use, beta = ok, np.linalg.lstsq(basis[ok], v[ok], rcond=None)[0]
        for _ in range(12):
            off = v - basis @ beta
            mid = np.median(off[use])
            sigma = 1.4826 * np.median(np.abs(off[use] - mid))
            new = ok[(off[ok] - mid >= -2.5 * sigma) & (off[ok] - mid <= 4.0 * sigma)]
            if sigma < 1e-9 or len(new) < 21:
                break
            use, beta = new, np.linalg.lstsq(basis[new], v[new], rcond=None)[0]
        assert np.allclose([r.a, r.b, r.c], beta, atol=1e-9) and r.n_inliers == len(use)


def test_components_of_large_and_text_ids(spark):
    z = np.zeros((1, 6, 6))
    z[0, 2:4, 2:4] = 1
    m = as_maps(spark, z).withColumn("mask", F.transform("z", lambda v: v > 0))
    for key in (F.lit(3_000_000_000), F.lit(-7), F.lit("left")):
        r = D.largest_component(m.withColumn("map_id", key), "mask").first()
        assert (r["largest"], r["n_true"]) == (4, 4)


def test_planted_pit_is_repaired_and_groove_is_not(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(scale=0.01, size=(2, 24, 24))
    z[0, 10:13, 10:13] -= 3.0
    z[1, 4:20, 11:13] -= 3.0
    det = D.background_deficit(as_maps(spark, z), 4, 8.0, 4.0, 0.8, 0.35, 2)
    records = D.repaired_maps(det, 1.0, (3, 20.0, 2.8, 0.12), 3).select("map_id", F.explode("records").alias("r")).select("map_id", "r.*")
    done = {r["map_id"]: r for r in records.collect()}
    assert set(done) == {0} and done[0]["n_repaired"] == 9 and 2.8 < done[0]["max_correction"] < 3.2


def test_components_match_union_find(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_contract_failures_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    lookup = spark.createDataFrame([(1, 9)], "k long, w long")
    with pytest.raises(K.ContractError):
        K.require(df, F.col("k") > 1, "k too small")
    with pytest.raises(K.ContractError):
        K.join_validated(lookup, df, ["k"], "m:1")
    with pytest.raises(K.ContractError):
        K.join_validated(df, lookup, ["k"], "m:1")
    with pytest.raises(K.ContractError):
        K.refuse_columns(df.withColumn("measured_y", F.lit(1)), ["measured"])
    with pytest.raises(K.ContractError):
        FO.check_folds(spark.createDataFrame([(1, 0), (1, 1)], "g long, fold long"), "fold", ["g"])


def test_folds_keep_groups_whole_and_balanced(spark):
    rows = [(g, i) for g in range(40) for i in range(1 + g % 7)]
    df = spark.createDataFrame(rows, "g long, i long")
    f = FO.group_folds(df, "g", 4).toPandas()
    sizes = f.groupby("fold")["n"].sum()
    assert len(f) == 40 and len(sizes) == 4 and sizes.max() - sizes.min() <= 7
    n = FO.nested_folds(df, "g", 4, 3).toPandas().merge(f[["g", "fold"]], on="g")
    assert (n["outer"] != n["fold"]).all() and len(n) == 40 * 3


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [3, -2, 0]
    return pd.DataFrame({"id": np.arange(n), "fold": rng.integers(0, 4, n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": 2 * x[:, 0] - x[:, 1] + rng.normal(size=n), "w": rng.random(n) + 0.2})


def reference_ridge(x, y, w, alpha):
    w = w / w.sum()
    mean = w @ x
    scale = np.sqrt(w @ (x - mean) ** 2)
    z = (x - mean) / scale
    my = w @ y
    s = w * len(y)
    beta = np.linalg.solve((z * s[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * s[:, None]).T @ (y - my))
    return lambda q: my + (q - mean) / scale @ beta


@pytest.mark.parametrize("weighted", [False, True])
def test_one_scan_ridge_equals_refitting(spark, frame, weighted):
    df = spark.createDataFrame(frame)
    s = L.moments(df, ["fold"], [F.col(c) for c in "abc"], F.col("y"), F.col("w") if weighted else None)
    fits = L.fit(L.leave_out(s, [], "fold"), {"all": [0, 1, 2], "ac": [0, 2]}, [0.1, 10.0])
    for r in fits.collect():
        train, test = frame[frame["fold"] != r["fold"]], frame[frame["fold"] == r["fold"]]
        cols = list("abc") if r["design"] == "all" else list("ac")
        w = train["w"].to_numpy() if weighted else np.ones(len(train))
        model = reference_ridge(train[cols].to_numpy(), train["y"].to_numpy(), w, r["alpha"])
        assert np.allclose(r["intercept"] + test[cols].to_numpy() @ np.array(r["coef"]), model(test[cols].to_numpy()))
        wt = test["w"].to_numpy() if weighted else 1.0
        assert np.isclose(r["sse"], (wt * (test["y"] - model(test[cols].to_numpy())) ** 2).sum())


def test_inner_scores_equal_nested_refits(spark, frame):
    data = frame.assign(inner=frame["id"] % 3)
    s = L.moments(spark.createDataFrame(data), ["fold", "inner"], [F.col("a"), F.col("b")], F.col("y"))
    got = {(r["fold"], r["alpha"]): r["mse"] for r in L.inner_scores(s, "fold", "inner", {"d": [0, 1]}, [1.0, 100.0], 4).collect()}
    for (fold, alpha), mse in got.items():
        train = data[data["fold"] != fold]
        want = []
        for k in range(3):
            a, b = train[train["inner"] != k], train[train["inner"] == k]
            m = reference_ridge(a[["a", "b"]].to_numpy(), a["y"].to_numpy(), np.ones(len(a)), alpha)
            want.append(((b["y"] - m(b[["a", "b"]].to_numpy())) ** 2).mean())
        assert np.isclose(mse, np.mean(want))


def test_spline_basis_is_a_partition_without_its_last_part(spark):
    x = spark.range(0, 31).select((F.col("id") / 10.0).alias("x"))
    rows = x.select("x", *[b.alias(f"b{k}") for k, b in enumerate(L.spline_basis(F.col("x"), F.lit(0.0), F.lit(3.0)))]).toPandas()
    total = rows[[f"b{k}" for k in range(4)]].sum(axis=1)
    assert np.allclose(total[rows["x"] <= 2.0], 1.0) and np.isclose(total.iloc[-1], 0.5)
    out = spark.createDataFrame([(-1.0,), (-2.0,), (-3.0,)], "x double").select(L.spline_basis(F.col("x"), F.lit(0.0), F.lit(3.0))[0].alias("b")).toPandas()["b"]
    assert np.isclose(out[1] - out[0], out[2] - out[1])


def test_logistic_slope_matches_newton(spark):
    rng = np.random.default_rng(10)
    x = rng.integers(0, 6, 800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(x - 2.5)))).astype(int)
    got = B.logistic_slope(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()
    beta, d = np.zeros(2), np.column_stack([np.ones(800), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ beta))
        beta += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d, d.T @ (y - p))
    assert np.allclose([got["intercept"], got["slope"]], beta, atol=1e-4)


def test_pca_bootstrap_matches_replaying_the_draws(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 5)) * [5, 3, 1, 1, 1]
    cl = np.arange(120) % 12
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for c, r in zip(cl, x)], "cl long, e array<double>")
    got = B.pca_bootstrap_angles(df, "cl", "e", 5, 2, 6, 3).toPandas().set_index("rep")
    bank = B.bootstrap_counts(df.select("cl").distinct(), "cl", 6, 3).toPandas()
    assert (bank.groupby("rep")["w"].sum() == 12).all()

    def top(rows):
        w, v = np.linalg.eigh(np.cov(rows.T, bias=True))
        return v[:, np.argsort(w)[::-1][:2]]
    for rep, g in bank.groupby("rep"):
        rows = np.concatenate([np.repeat(x[cl == c], w, axis=0) for c, w in zip(g["cl"], g["w"])])
        assert np.isclose(got.loc[rep, "angle_deg"], B.largest_angle(top(rows), top(x)), atol=1e-5)


def test_permutation_keeps_blocks(spark, frame):
    df = spark.createDataFrame(frame)
    p = B.permuted(df.select("fold", "id", "y"), ["fold"], "id", "y", 3, 1).toPandas()
    for (_, fold), g in p.groupby(["rep", "fold"]):
        assert np.allclose(np.sort(g["y"]), np.sort(frame[frame["fold"] == fold]["y"]))


def test_signflip_refuses_too_many_units(spark):
    with pytest.raises(ValueError):
        B.exact_signflip(spark.range(25).withColumn("d", F.rand(1)), "id", ["d"])


def test_sealed_choices_detect_tampering(spark):
    choices = spark.createDataFrame([(1, 10), (2, 20)], "pair long, cand long")
    digest = SE.seal_choices(choices).first()["digest"]
    assert SE.seal_choices(choices.orderBy(F.desc("pair"))).first()["digest"] == digest
    measured = spark.createDataFrame([(10, 1.0), (20, 2.0)], "cand long, y double")
    assert SE.evaluate_sealed(choices, digest, measured, "cand").count() == 2
    with pytest.raises(ValueError):
        SE.evaluate_sealed(choices.withColumn("cand", F.col("cand") + 10), digest, measured, "cand")
    with pytest.raises(ValueError):
        SE.seal_choices(choices.withColumn("measured_y", F.lit(1)))


def test_file_seals_and_line_ends(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    for name, text in (("same.txt", b"x\ny\n"), ("crlf.txt", b"x\ny\n"), ("gone.txt", b"1"), ("edit.txt", b"1")):
        (a / name).write_bytes(text)
    for name, text in (("same.txt", b"x\ny\n"), ("crlf.txt", b"x\r\ny\r\n"), ("new.txt", b"1"), ("edit.txt", b"2")):
        (b / name).write_bytes(text)
    v = SE.verify_seal(SE.seal(spark, str(a)), SE.seal(spark, str(b)), tolerant=True)
    assert {r["name"]: r["state"] for r in v.collect()} == {"same.txt": "match", "crlf.txt": "match_line_ends", "gone.txt": "missing", "new.txt": "unexpected", "edit.txt": "changed"}


def test_seal_tells_equal_names_apart(spark, tmp_path):
    for d in ("a/x", "a/y", "b/x", "b/y"):
        (tmp_path / d).mkdir(parents=True)
    for root in ("a", "b"):
        (tmp_path / root / "x" / "part.txt").write_bytes(b"1")
        (tmp_path / root / "y" / "part.txt").write_bytes(b"2")
    v = SE.verify_seal(SE.seal(spark, str(tmp_path / "a")), SE.seal(spark, str(tmp_path / "b")))
    assert sorted((r["name"], r["state"]) for r in v.collect()) == [("x/part.txt", "match"), ("y/part.txt", "match")]


def test_acceptance_delta_sees_null(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    new = spark.createDataFrame([(1, None), (2, 2.5), (3, None)], "k int, v double")
    r = SE.acceptance_delta(old, new, ["k"], ["v"]).first()
    assert (r["max_delta"], r["n_null_changed"], r["n_unmatched"]) == (0.5, 1, 0)


def test_physical_guard_rejects_holes(spark):
    nan = float("nan")
    maps = spark.createDataFrame([(1, [0.0, 1.0], [0.0, 0.0]), (2, [nan, 1.0], [0.0, 0.0]), (3, [None, 1.0], [0.0, 0.0]), (4, [-1.0, 1.0], [0.0, 0.0])], "map_id int, f array<double>, b array<double>")
    got = {r["map_id"]: (r["finite"], r["n_violations"], r["ok"]) for r in K.physical_guard(maps, "f", "b", 0.1).collect()}
    assert got == {1: (True, 0, True), 2: (False, 0, False), 3: (False, 0, False), 4: (True, 1, False)}


def test_lock_is_never_replaced(spark, tmp_path):
    path = str(tmp_path / "lock")
    digest = SE.write_lock(spark.range(3).toDF("id"), path, {"alpha": 1}, ["x"])
    assert SE.read_lock(spark, path, digest).count() == 3
    with pytest.raises(Exception):
        SE.write_lock(spark.range(3).toDF("id"), path, {"alpha": 1}, ["x"])
    with pytest.raises(ValueError):
        SE.read_lock(spark, path, "other")


def test_csv_fallback(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "utf8.csv").write_bytes("﻿k,v\n1,é\n".encode("utf-8"))
    (tmp_path / "latin.csv").write_bytes("k,v\n1,é\n".encode("latin-1"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    for name in ("utf8.csv", "latin.csv"):
        assert R.read_csv_fallback(spark, str(tmp_path / name), schema).first()["v"] == "é"


def test_selection_pool_keeps_permanent_members(spark):
    from graticule.operators.sequences import selection_pool
    rows = [(k, "permanent", 0.0) for k in range(50)] + [(100 + k, "low", float(k)) for k in range(5)] + [(200 + k, "high", float(k)) for k in range(5)] + [(100, "high", 9.0), (0, "low", 1.0)]
    df = spark.createDataFrame(rows, "id int, reason string, e double")
    kept = {r["id"]: r["reasons"] for r in selection_pool(df, "id", ["high", "low"], "permanent", "e", 55).collect()}
    # the last tier goes first, the least extreme of it before the others; 100 has reasons in two tiers
    assert set(range(50)) | {100} <= set(kept) and set(kept) - set(range(50)) == {100, 201, 202, 203, 204} and kept[0] == "low|permanent"
    with pytest.raises(Exception, match="cannot be thinned"):
        selection_pool(df, "id", ["high", "low"], "permanent", "e", 40).collect()


def test_plateau_run_returns_every_series(spark):
    from graticule.operators.sequences import plateau_run
    rows = [("a", float(k), 5.0, True) for k in range(10)] + [("b", float(k), 5.0, False) for k in range(10)]
    df = spark.createDataFrame(rows, "u string, s double, d double, f boolean")
    got = {r["u"]: (r["lo"], r["hi"], r["n_members"], r["state"]) for r in plateau_run(df, ["u"], "s", F.col("f"), "d", 0.5, 1.5, 2.0, 0.1, 4.0).collect()}
    assert got == {"a": (0.0, 9.0, 10, "stable"), "b": (None, None, 0, "no_plateau")}


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    assert SE.compare_tables(a, a).first()["state"] == "EXACT"
    assert SE.compare_tables(a, a.withColumn("v", F.col("v") + 1)).first()["state"] == "VALUE_DIFF"
    assert SE.compare_tables(a, a.limit(1)).first()["state"] == "SHAPE_DIFF"
    assert SE.compare_tables(a, a.drop("v")).first()["state"] == "SHAPE_DIFF"
    assert SE.compare_tables(a, a.withColumn("v", F.col("v").cast("string"))).first()["state"] == "SHAPE_DIFF"


def test_resampled_means_equal_the_bank_and_shuffle_rows_once(spark):
    rows = [(d, int(k), int(k) % 3, float(k * k % 17) if k % 11 else None, 1.0 + k % 2) for k in range(60) for d in ("a", "b")]
    df = spark.createDataFrame(rows, "design string, cl long, fold long, s double, n double")
    for strata, by in (([], []), (["fold"], ["fold"]), ([], ["design"])):
        bank = B.weighted_means(B.bootstrap_counts(df, "cl", 8, 5, strata), df, [*strata, "cl"], "s", "n", by).toPandas()
        got = B.resampled_means(df, "cl", 8, 5, "s", "n", strata, by)
        both = got.toPandas().merge(bank, on=[*by, "rep"], suffixes=("", "_bank"))
        assert len(both) == len(bank) == got.count() and (abs(both["stat"] - both["stat_bank"]) < 1e-12).all()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) AS w" not in plan  # no bank


def test_replicates_of_a_small_table_are_ordered_by_many_tasks(spark, monkeypatch):
    from graticule.plans import order_stats as O
    df = spark.range(300).select("id", (F.col("id") % 7).alias("z"), (F.col("id") * 2).alias("twice")).coalesce(1)
    want = {(r["rep"], r["id"]): r["z"] for r in B.permuted(df, [], "id", "z", 10, 3).collect()}
    monkeypatch.setattr(O, "TASK_ROWS", 100)
    got = B.permuted(df, [], "id", "z", 10, 3, ["twice"])
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["rep"], r["id"]): r["z"] for r in rows} == want and all(r["twice"] == 2 * r["id"] for r in rows)
    per = pd.Series([r["task"] for r in rows]).value_counts()
    assert len(per) > 15 and per.max() < 400

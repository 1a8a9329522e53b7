"""Matched subsets keep the size signature and draw evenly; leave-one-out angles against refits."""
import collections

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graticule.operators import matched as M
from graticule.operators import resampling as B


def table(spark, rng):
    rows, n = [], 0
    for s in range(3):
        for c in range(12):
            for _ in range(int(rng.integers(1, 9)) if c else 60):  # a cluster with many rows in every session
                rows.append((n, s, 100 * s + c, bool(rng.random() < (0.3 if s < 2 else 0.0)) and c % 2 == 0))
                n += 1
    rows += [(n, None, 5, True), (n + 1, 1, None, True), (n + 2, 1, 103, None)]
    return spark.createDataFrame(rows, "id long, session long, cl long, chosen boolean").withColumn("rep", F.lit("mine")), pd.DataFrame(rows, columns=["id", "session", "cl", "chosen"])


def test_signature_is_kept_per_session(spark):
    df, data = table(spark, np.random.default_rng(3))
    got = M.matched_draws(df, "cl", "id", F.col("chosen"), 40, 7, "session").toPandas()
    given = data[data["session"].notna() & data["cl"].notna() & (data["chosen"] == True)]  # noqa: E712
    sign = lambda g: sorted(g.groupby("cl").size())
    want = {s: sign(g) for s, g in given.groupby("session")}
    assert set(got["session"]) == set(want) and got["rep"].nunique() == 40
    assert all(sign(g) == want[s] for (_, s), g in got.groupby(["rep", "session"]))
    assert not got.duplicated(["rep", "id"]).any()
    home = data.set_index("id")
    assert (home.loc[got["id"], "cl"].to_numpy() == got["cl"].to_numpy()).all() and (home.loc[got["id"], "session"].to_numpy() == got["session"].to_numpy()).all()
    assert got.groupby("rep")["id"].apply(frozenset).nunique() > 30
    again = M.matched_draws(df.repartition(3, "id"), "cl", "id", F.col("chosen"), 40, 7, "session").toPandas()
    assert set(map(tuple, again.to_numpy())) == set(map(tuple, got.to_numpy()))
    assert M.matched_draws(df, "cl", "id", F.lit(False), 4, 7, "session").count() == 0
    assert M.matched_draws(df.where("false"), "cl", "id", F.col("chosen"), 4, 7).count() == 0


def test_urn_draws_like_one_by_one():
    """Chance of every size to be drawn, against drawing clusters one after the other."""
    wanted, sizes = [(4, 1), (2, 2), (1, 1)], [(1, 3), (2, 2), (3, 2), (5, 2)]
    urn, plain, n = collections.Counter(), collections.Counter(), 6000
    rng = np.random.default_rng(1)
    for k in range(n):
        for size, want, times in M.deal(wanted, sizes, str(k)):
            assert size >= want
            urn[size, want] += times
        left = [s for s, m in sizes for _ in range(m)]
        for want in (4, 2, 2, 1):
            s = left.pop(int(rng.choice([i for i, s in enumerate(left) if s >= want])))
            plain[s, want] += 1
    assert set(urn) == set(plain)
    assert all(abs(urn[x] - plain[x]) / n < 0.035 for x in urn)


def test_leave_one_out_angles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [4, 3, 1, 1, 1]
    c = rng.integers(0, 6, 200)
    x[c == 2] += rng.normal(size=5) * 4
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(c, x)], "cl long, e array<double>").repartition(4)
    got = {r["cl"]: r["angle_deg"] for r in M.leave_one_out_angles(B.cluster_moments(df, "cl", "e", 5), "cl", 5, 2).collect()}

    def top(rows):
        w, v = np.linalg.eigh(np.cov(rows.T, bias=True))
        return v[:, np.argsort(w)[::-1][:2]]
    for k in range(6):
        s = np.linalg.svd(top(x).T @ top(x[c != k]), compute_uv=False)
        assert abs(got[k] - np.degrees(np.arccos(np.clip(s, 0, 1)).max())) < 1e-5
    alone = B.cluster_moments(df.withColumn("cl", F.lit(1)), "cl", "e", 5)
    assert M.leave_one_out_angles(alone, "cl", 5, 2).first()["angle_deg"] is None

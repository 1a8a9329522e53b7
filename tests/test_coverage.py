"""Greedy coverage against plain greedy loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.operators import coverage as C


def plain_farthest(ids, x, reference, n):
    best = np.full(len(ids), np.inf)
    for r in reference:
        best = np.minimum(best, ((x - r) ** 2).sum(1))
    out, free = [], np.ones(len(ids), bool)
    for _ in range(min(n, len(ids))):
        k = min(np.flatnonzero(free), key=lambda i: (-best[i], ids[i]))
        out.append((ids[k], best[k] ** 0.5))
        free[k] = False
        best = np.minimum(best, ((x - x[k]) ** 2).sum(1))
    return out


@pytest.mark.parametrize("breadth, near", [(1024, 4096), (7, 4096), (3, 4)])
def test_farthest_points(spark, breadth, near):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)) * 10)  # whole numbers: exact ties, repeated points
    x[40:60] = x[40]
    ids = list(range(1000, 1300))
    points = spark.createDataFrame([(i, v.tolist(), "extra") for i, v in zip(ids, x)] + [(1, None, None)], "id long, e array<double>, score string").repartition(5)
    reference = points.where("id BETWEEN 1000 AND 1009")
    got = C.farthest_points(reference, points.where("id > 1009 OR id = 1"), "id", "e", 60, breadth, near).orderBy("pick").collect()
    want = plain_farthest(ids[10:], x[10:], x[:10], 60)
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert np.allclose([r["dist"] for r in got], [d for _, d in want])


def test_farthest_points_small(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [4.0]), (3, [4.0])], "id long, e array<double>")
    none = points.where("false")
    assert [tuple(r) for r in C.farthest_points(points.where("id = 1"), points, "id", "e", 9).orderBy("pick").collect()] == [(1, 2, 4.0), (2, 1, 0.0), (3, 3, 0.0)]
    assert C.farthest_points(none, points, "id", "e", 1).first()["id"] == 1
    assert C.farthest_points(points, none, "id", "e", 3).count() == 0
    with pytest.raises(ValueError, match="repeats"):
        C.farthest_points(none, points.unionByName(points), "id", "e", 2)


def test_rounds_follow_breadth_not_picks(spark, monkeypatch):
    """200 picks from 2,000 rows in a few rounds; every round but the last is removed."""
    kept = []
    keep = C.Rounds.keep
    monkeypatch.setattr(C.Rounds, "keep", lambda self, df: kept.append(1) or keep(self, df))
    points = spark.range(2000).select("id", F.array(*[F.rand(k) for k in range(4)]).alias("e"))
    assert C.farthest_points(points.where("id < 5"), points, "id", "e", 200, 256).count() == 200
    assert 0 < len(kept) < 20


@pytest.mark.parametrize("breadth", [1024, 4])
def test_greedy_novelty(spark, breadth):
    rng = np.random.default_rng(8)
    rows = [(i, [None, "a", "b", "c", "d", "e", "f"][rng.integers(7)], ["u", "v", "w"][rng.integers(3)], float(rng.integers(160)) / 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s string, t string, x double").repartition(4)
    got = C.greedy_novelty(df.where("id >= 20"), df.where("id < 20 AND s IN ('a', 'b')"), "id", ["s", "t"], "x", 25, [3.0, 2.0], breadth, joint=1.5).orderBy("pick").collect()
    known = [r for r in rows[:20] if r[1] in ("a", "b")]
    want, left = [], rows[20:]
    for _ in range(25):
        score = lambda r: min(abs(r[3] - k[3]) for k in known) + 3.0 * (r[1] not in {k[1] for k in known}) + 2.0 * (r[2] not in {k[2] for k in known}) + 1.5 * ((r[1], r[2]) not in {(k[1], k[2]) for k in known})  # noqa: B023, E731
        best = min(left, key=lambda r: (-round(score(r), 9), r[0]))
        want.append((best[0], score(best)))
        known.append(best)
        left.remove(best)
    assert np.allclose([r["score"] for r in got], [s for _, s in want])
    assert [r["id"] for r in got] == [i for i, _ in want]

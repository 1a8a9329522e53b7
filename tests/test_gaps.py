"""Quantiles of differences against all pairs."""
import numpy as np
import pandas as pd
import pytest

from graticule.plans import gaps as P


def gaps(x):
    i, j = np.triu_indices(len(x), 1)
    return np.abs(x[i] - x[j])


@pytest.mark.parametrize("prob, listed", [(0.0, 200_000), (0.37, 30), (0.5, 200_000), (1.0, 30)])
def test_equals_all_pairs(spark, monkeypatch, prob, listed):
    """Smooth values, a lattice full of ties, copies of one value, two values, in blocks of a few."""
    monkeypatch.setattr(P, "BLOCK", 120)
    monkeypatch.setattr(P, "LISTED", listed)
    r = np.random.default_rng(3)
    groups = [r.normal(size=700), r.integers(0, 9, 400) / 10.0, np.full(90, 2.5), np.array([1.0, 4.0]), np.concatenate([np.zeros(300), r.exponential(size=200) * 1e6]), np.array([7.0])]
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(np.arange(len(groups)), [len(x) for x in groups]), "v": np.concatenate(groups)})).repartition(3)
    got = P.gap_quantiles(df, "g", "v", prob)
    assert sorted(got) == [0, 1, 2, 3, 4]
    for g in got:
        assert got[g] == pytest.approx(np.quantile(gaps(groups[g]), prob), rel=1e-13, abs=1e-15)


def test_blocks_far_from_the_quantile_are_left_out(spark, monkeypatch):
    """Of 20 x 21 / 2 pairs of blocks most count whole."""
    monkeypatch.setattr(P, "BLOCK", 200)
    monkeypatch.setattr(P, "LISTED", 2_000)
    seen, plain = [], P._tiles
    monkeypatch.setattr(P, "_tiles", lambda blocks, tiles, work, schema: seen.append(len(tiles)) or plain(blocks, tiles, work, schema))
    x = np.random.default_rng(4).normal(size=4_000)
    got = P.gap_quantiles(spark.createDataFrame(pd.DataFrame({"g": 0, "v": x})), "g", "v", 0.5)
    assert got[0] == pytest.approx(np.quantile(gaps(x), 0.5), rel=1e-13)
    assert len(seen) > 2 and seen[-1] < 70


def test_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (0, 3.0), (0, float("nan")), (1, None), (1, 2.0)], "g long, v double")
    assert P.gap_quantiles(df, "g", "v", 0.0) == {0: 2.0}
    assert np.isnan(P.gap_quantiles(df, "g", "v", 0.5)[0])

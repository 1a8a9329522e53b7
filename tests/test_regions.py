"""Regions, sliding medians and repair inside maps against plain searches, cell by cell."""
import numpy as np
import pandas as pd
import pytest

from graticule.operators import dropouts as D
from graticule.operators import planes as L
from graticule.operators import regions as R

PITCH, GATES, RING = (2.0, 3.0), (3, 40.0, 2.8, 0.12), 3


def flood(mask, diagonal):
    """Label cells by breadth-first search; a region is named by its smallest cell."""
    rows, cols = mask.shape
    name = {}
    for start in np.flatnonzero(mask).tolist():
        if start in name:
            continue
        queue = [start]
        name[start] = start
        while queue:
            r, c = divmod(queue.pop(), cols)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    y, x = r + dy, c + dx
                    if (dy or dx) and (diagonal or not (dy and dx)) and 0 <= y < rows and 0 <= x < cols and mask[y, x] and y * cols + x not in name:
                        name[y * cols + x] = start
                        queue.append(y * cols + x)
    return name


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_equal_flood_fill(diagonal):
    """Maps of several shapes in one batch, dense, sparse, spiral, empty and full."""
    r = np.random.default_rng(2)
    spiral = np.zeros((15, 15), bool)
    for k in range(0, 8, 2):
        spiral[k, k: 15 - k] = spiral[k: 15 - k, 14 - k] = spiral[14 - k, k: 15 - k] = True
        spiral[k + 2: 15 - k, k] = True
    masks = [r.random((9, 7)) < p for p in (0.2, 0.45, 0.6, 0.9)] + [spiral, np.zeros((3, 4), bool), np.ones((1, 8), bool), np.ones((6, 1), bool), r.random((30, 41)) < 0.5]
    which, cell, region = R.regions(masks, diagonal)
    for k, m in enumerate(masks):
        assert dict(zip(cell[which == k].tolist(), region[which == k].tolist())) == flood(m, diagonal)


def test_sliding_median():
    z = np.random.default_rng(3).normal(size=(11, 6))
    for radius in (1, 3):
        wide = np.pad(z, radius, mode="edge")
        want = [[np.median(wide[r: r + 2 * radius + 1, c: c + 2 * radius + 1]) for c in range(6)] for r in range(11)]
        assert np.array_equal(R.sliding_median(z, radius), want)


def scene():
    r = np.random.default_rng(8)
    z = r.normal(scale=0.01, size=(5, 30, 28)) + np.linspace(0, 2, 28)
    valid = np.ones(z.shape, bool)
    z[0, 10:13, 10:13] -= 3.0  # a pit
    z[0, 20:22, 20:23] -= 1.5  # a second one
    z[1, 4:26, 11:13] -= 3.0  # a groove: too long
    z[2, 5, 5] -= 4.0  # too small
    valid[3] = False  # nothing valid
    z[4, 12:15, 8:12] -= 2.0
    valid[4, 12, 9] = valid[4, 10:12, :] = False
    return z, valid


def frame(spark, z, valid):
    n = len(z)
    pdf = pd.DataFrame({"map_id": np.arange(n), "n_rows": z.shape[1], "n_cols": z.shape[2], "z": [v.ravel() for v in z], "valid": [v.ravel() for v in valid]})
    return spark.createDataFrame(pdf, "map_id long, n_rows int, n_cols int, z array<double>, valid array<boolean>")


def plain_repair(z, ok):
    """Background, seeds, gates and ring planes as defined, one region at a time with least squares."""
    if not ok.any():
        return z.copy(), None
    mad = lambda v: 1.4826 * np.median(np.abs(v - np.median(v)))
    work = np.where(ok, z, np.median(z[ok]))
    gap = work - R.sliding_median(work, 4)
    noise = mad(gap[ok])
    inner = np.zeros(z.shape, bool)
    inner[2:-2, 2:-2] = True
    level = lambda least, k: ok & inner & (np.maximum(-gap, 0) >= max(least, k * noise))
    seed, grow = level(0.8, 8.0), level(0.35, 4.0)
    names = flood(grow, True)
    out, raised = z.copy(), 0
    for k in sorted(set(names.values())):
        cells = np.array(sorted(c for c, n in names.items() if n == k))
        r, c = np.divmod(cells, z.shape[1])
        rows, cols = np.ptp(r) + 1, np.ptp(c) + 1
        sides = rows * PITCH[1], cols * PITCH[0]
        if not seed.ravel()[cells].any() or len(cells) < GATES[0] or max(sides) > GATES[1] or max(sides) / min(sides) > GATES[2] or len(cells) / (rows * cols) < GATES[3]:
            continue
        inside = np.zeros(z.shape, bool)
        inside.ravel()[cells] = True
        near = inside.copy()
        for _ in range(RING):
            p = np.pad(near, 1)
            near = p[1:-1, 1:-1] | p[2:, 1:-1] | p[:-2, 1:-1] | p[1:-1, 2:] | p[1:-1, :-2]
        y, x = np.nonzero(near & ~inside & ok)
        if len(y) < 12:
            continue
        basis = lambda a, b: np.column_stack([b - c.mean(), a - r.mean(), np.ones(len(a))])
        m, v = basis(y, x), work[y, x]
        keep = np.ones(len(v), bool)
        for _ in range(4):
            beta = np.linalg.lstsq(m[keep], v[keep], rcond=None)[0]
            off = v - m @ beta
            s = mad(off[keep])
            new = np.abs(off - np.median(off[keep])) <= 3.5 * s
            if s <= 1e-12 or new.sum() < 8 or (new == keep).all():
                break
            keep = new
        beta = np.linalg.lstsq(m[keep], v[keep], rcond=None)[0]
        plane = basis(r, c) @ beta
        higher = plane > z[r, c]
        out[r[higher], c[higher]] = plane[higher]
        raised += higher.sum()
    return out, raised


def test_repair_equals_definition(spark):
    z, valid = scene()
    det = D.background_deficit(frame(spark, z, valid), 4, 8.0, 4.0, 0.8, 0.35, 2)
    out = D.repaired_maps(det, PITCH[0], GATES, RING, PITCH[1])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    got = {r["map_id"]: r for r in out.collect()}
    for k in range(len(z)):
        want, raised = plain_repair(z[k], valid[k])
        told = got[k]
        mended = np.array([np.nan if v is None else v for v in told["repaired"]]).reshape(z[k].shape)
        if raised is None:
            assert told["metrics"]["status"] == "EMPTY" and told["metrics"]["noise"] is None and not told["records"] and np.isnan(mended).all()
            continue
        assert np.isnan(mended[~valid[k]]).all() and np.allclose(mended[valid[k]], want[valid[k]], atol=1e-9)
        assert told["metrics"]["n_repaired"] == raised == sum(told["repair_mask"]) == sum(r["n_repaired"] for r in told["records"])
    assert len(got[0]["records"]) == 2 and not got[1]["records"] and not got[2]["records"] and len(got[4]["records"]) == 1


def test_no_exchange_and_large_maps(spark):
    z = np.random.default_rng(1).normal(size=(3, 160, 160))
    m = frame(spark, z, np.ones(z.shape, bool))
    det = D.background_deficit(m, 5, 3.0, 1.5, 0.1, 0.05, 4)
    for df in (det, D.compact_components(det, 0.5, 3, 20.0, 2.8, 0.12), D.largest_component(det, "grow")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() >= 3


def test_flat_crops_are_left_out(spark):
    """A shifted crop without spread does not decide; only if none varies the distance is unknown."""
    from pyspark.sql import functions as F
    r = np.random.default_rng(0)
    a = r.normal(size=(6, 6))
    b = np.zeros((6, 6))
    b[0, 0] = 1.0  # varies in the first shift only
    rows = [(0, a.ravel().tolist(), b.ravel().tolist()), (1, a.ravel().tolist(), [0.0] * 36), (2, a.ravel().tolist(), a.ravel().tolist())]
    got = {x["k"]: x["d"] for x in spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", L.phase_distance(F.col("a"), F.col("b"), 6, 6, 1).alias("d")).collect()}
    assert got[0] is not None and 0 < got[0] < 2 and got[1] is None and abs(got[2]) < 1e-12


def test_a_batch_is_worked_on_in_slices_of_bounded_cells(spark, monkeypatch):
    import pandas as pd
    from graticule.operators import dropouts
    seen = []

    def work(z: pd.Series, rows: pd.Series) -> pd.Series:
        seen.append(sum(len(v) for v in z))
        return pd.Series([sum(v) + r for v, r in zip(z, rows)])
    monkeypatch.setattr(dropouts, "CELLS", 40)
    maps = pd.Series([[float(k)] * 16 for k in range(10)])
    assert dropouts._in_slices(work)(maps, pd.Series([2] * 10)).tolist() == [16.0 * k + 2 for k in range(10)]
    assert max(seen) <= 40 + 16 and sum(seen) == 160 and len(seen) == 4
    assert len(dropouts._in_slices(work)(maps[:0], pd.Series([], dtype=int))) == 0

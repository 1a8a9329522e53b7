"""Ridge models of several targets, penalties chosen by nested cross-validation, from one scan.

The sufficient statistics of ``linear`` with the targets as last columns serve every target at once.  Per training set and
design the standardised cross products are decomposed once; each penalty is then a division by shifted eigenvalues, for all
targets together.  Outer folds, inner folds, designs and penalties never touch the rows again.

Scores of an inner fold: ``mse`` and ``multi_mse`` are the mean squared error over rows and targets (minimised), ``log_ratio_q2``
is one minus the squared error over that of the training mean, both summed over targets (maximised), as log-ratio coordinates
of compositions ask for.  Inner folds whose score is undefined are skipped; a penalty without any is never preferred to one
with; ties go to the smaller penalty.  Scores that agree to ``TIE`` are a tie: on many rows small penalties differ by less than
the rounding of the sums behind their scores.  With a weight column (say one over the rows of a component) fits and errors are weighted;
the penalty weighs against as many rows as there are.  Rows with a null in a feature, target or weight take no part.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.operators import linear as L

FIT_COLUMNS = "design string, alpha double, intercepts array<double>, coefs array<array<double>>, sse array<double>, ss0 array<double>, mass double, n_train double, n_test double"
SCORERS = ("mse", "multi_mse", "log_ratio_q2")
TIE = 1e-9  # share of a mean squared error, or of a Q2's full scale of one, below which two scores are the same


def moments(df: DataFrame, by: Sequence[str], x: Sequence[Column], y: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """(by, m, n) of features and targets; mean squared errors of all models follow from it."""
    w = F.lit(1.0) if weight is None else weight
    held = {f"_m{k}": c.cast("double") for k, c in enumerate([*x, *y, w])}
    rows = df.select(*by, *[c.alias(n) for n, c in held.items()]).dropna(subset=[*by, *held])
    v = [F.col(n) for n in held]
    return L.moments(rows, by, v[:-2], v[-2], v[-1])


def solve_all(m: np.ndarray, n: float, columns: Sequence[int], targets: int, alphas: Sequence[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(intercepts, coefficients by target) for every penalty, from one decomposition."""
    m = m / m[0, 0]
    c, t = np.asarray(columns, dtype=int) + 1, np.arange(len(m) - targets, len(m))
    mean, my = m[0, c], m[0, t]
    cov = m[np.ix_(c, c)] - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[scale < 1e-12] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale) * n)
    along = vectors.T @ ((m[np.ix_(c, t)] - np.outer(mean, my)) / scale[:, None] * n)
    out = []
    for a in alphas:
        shifted = np.maximum(values, 0.0) + a
        usable = shifted > 1e-10 * max(1.0, n)
        beta = vectors @ (np.where(usable, 1.0 / np.where(usable, shifted, 1.0), 0.0)[:, None] * along) / scale[:, None]
        out.append((my - mean @ beta, beta.T))
    return out


def fit(splits: DataFrame, targets: int, designs: dict[str, Sequence[int]], alphas: Sequence[float]) -> DataFrame:
    """One row per split, design and penalty: coefficients and held-out errors of every target."""
    keys = [f for f in splits.schema.fields if f.name not in ("m_train", "n_train", "m_test", "n_test")]
    names = [f.name for f in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keys] + [FIT_COLUMNS])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                train, test = (L.unpack(np.asarray(row[c], dtype=float)) for c in ("m_train", "m_test"))
                if train[0, 0] <= 0:
                    continue
                t = np.arange(len(train) - targets, len(train))

                def errors(intercepts, slopes, c):
                    e = np.zeros((targets, len(train)))
                    e[:, 0] = -intercepts
                    e[:, c] = -slopes
                    e[np.arange(targets), t] += 1.0
                    return np.einsum("ti,ij,tj->t", e, test, e)
                none = errors(train[0, t] / train[0, 0], np.zeros((targets, 0)), np.zeros(0, dtype=int))
                for design, columns in designs.items():
                    c = np.asarray(columns, dtype=int) + 1
                    for alpha, (b0, b) in zip(alphas, solve_all(train, row["n_train"], columns, targets, alphas)):
                        out.append([row[n] for n in names] + [design, float(alpha), b0, list(b), errors(b0, b, c), none, test[0, 0], row["n_train"], row["n_test"]])
            yield pd.DataFrame(out, columns=names + ["design", "alpha", "intercepts", "coefs", "sse", "ss0", "mass", "n_train", "n_test"])

    return splits.mapInPandas(run, schema)


def _total(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)


def score(scorer: str) -> Column:
    """Score of one held-out fold, NULL where undefined."""
    if scorer not in SCORERS:
        raise ValueError(f"scorer must be one of {SCORERS}")
    if scorer == "log_ratio_q2":
        return F.when(_total("ss0") > 0, 1 - _total("sse") / _total("ss0"))
    return F.when(F.col("mass") > 0, _total("sse") / F.col("mass") / F.size("sse"))


def preferred(tried: DataFrame, by: Sequence[str], scorer: str) -> DataFrame:
    """(by, alpha, inner_score): the smallest penalty whose score ties with the best one, NULL scores last."""
    s = -F.col("inner_score") if scorer == "log_ratio_q2" else F.col("inner_score")
    best = F.min(s).over(Window.partitionBy(*by))  # one row per penalty
    reach = best + TIE * (F.lit(1.0) if scorer == "log_ratio_q2" else F.abs(best))
    near = tried.withColumn("_near", F.coalesce(s <= reach, best.isNull()))
    return near.where("_near").groupBy(*by).agg(F.min_by(F.struct("alpha", "inner_score"), "alpha").alias("b")).select(*by, "b.*")


def nested(df: DataFrame, outer: str, inner: str, x: Sequence[Column], y: Sequence[Column], designs: dict[str, Sequence[int]], k: int,
           scorer: str = "multi_mse", alphas: Sequence[float] = L.ALPHA_GRID, weight: Column | None = None) -> DataFrame:
    """(outer, design, alpha, inner_score, test_mse, test_q2, q2_by_target, intercepts, coefs): per outer fold 0 .. k - 1 and design the penalty that the inner folds of
    its training part prefer, refitted on all of it."""
    stats = moments(df, [outer, inner], x, y, weight)
    worth = score(scorer)
    tried = fit(L.inner_splits(stats, outer, inner, k), len(y), designs, alphas).groupBy(F.col("_o").alias(outer), "design", "alpha").agg(F.avg(worth).alias("inner_score"))
    best = preferred(tried, [outer, "design"], scorer)
    whole = fit(L.leave_out(L.summed(stats, [outer]), [], outer), len(y), designs, alphas)
    each = F.zip_with("sse", "ss0", lambda s, z: F.when(z > 0, 1 - s / z))
    return whole.join(best, [outer, "design", "alpha"]).select(outer, "design", "alpha", "inner_score", score("multi_mse").alias("test_mse"), score("log_ratio_q2").alias("test_q2"), each.alias("q2_by_target"), "intercepts", "coefs")

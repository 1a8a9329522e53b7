"""Grouped linear models from one scan.

All designs, penalties, folds, arms and strata are fitted from the same sufficient statistics:
the upper triangle of sum(w * v v') with v = (1, x_1 .. x_d, y).  Statistics are additive, so
training = total - held-out, an ablation is a sub-matrix, and the held-out squared error is a
quadratic form.  Only (keys x folds) small matrices are ever solved; rows are not touched again
except to attach predictions as a column expression.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions import arrays as A

FIT_COLUMNS = "design string, alpha double, intercept double, coef array<double>, sse double, ss0 double, n_train double, n_test double"
ALPHA_GRID = [float(a) for a in np.logspace(-3, 3, 13)]


def moments(df: DataFrame, by: Sequence[str], x: Sequence[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """(by, m, n): packed weighted moments and the row count; reduced before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    v = [F.lit(1.0), *[c.cast("double") for c in x], y.cast("double")]
    names = [f"_v{i}" for i in range(len(v))]
    rows = df.select(*by, w.alias("_w"), *[c.alias(n) for c, n in zip(v, names)])
    sums = [F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])) for i in range(len(v)) for j in range(i, len(v))]
    return rows.groupBy(*by).agg(F.array(*sums).alias("m"), F.count(F.lit(1)).cast("double").alias("n"))


def leave_out(stats: DataFrame, by: Sequence[str], fold: str) -> DataFrame:
    """(by, fold, m_train, n_train, m_test, n_test); a group holds one entry per fold."""
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    g = stats.groupBy(*by).agg(F.collect_list(F.struct(fold, "m", "n")).alias("parts"))
    zero = F.transform(F.get("parts", F.lit(0))["m"], lambda _: F.lit(0.0))
    g = g.withColumn("total", F.aggregate("parts", zero, lambda acc, p: add(acc, p["m"]))).withColumn("rows", F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["n"]))
    e = g.select(*by, "total", "rows", F.explode("parts").alias("p"))
    return e.select(*by, f"p.{fold}", F.zip_with("total", "p.m", lambda a, b: a - b).alias("m_train"), (F.col("rows") - F.col("p.n")).alias("n_train"), F.col("p.m").alias("m_test"), F.col("p.n").alias("n_test"))


def whole(stats: DataFrame) -> DataFrame:
    """Train and test on the same statistics (in-sample fit)."""
    return stats.select(*[c for c in stats.columns if c not in ("m", "n")], F.col("m").alias("m_train"), F.col("n").alias("n_train"), F.col("m").alias("m_test"), F.col("n").alias("n_test"))


def unpack(m: np.ndarray) -> np.ndarray:
    d = int((np.sqrt(8 * len(m) + 1) - 1) / 2)
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = m
    return out + np.triu(out, 1).T


def solve_ridge(m: np.ndarray, n: float, columns: Sequence[int], alpha: float, standardise: bool = True) -> tuple[float, np.ndarray]:
    """Penalise the slopes of standardised columns (or of the columns as they are), leave the intercept free; total mass equals n rows."""
    m = m / m[0, 0]
    c = np.asarray(columns, dtype=int) + 1
    mean, my = m[0, c], m[0, -1]
    cov = m[np.ix_(c, c)] - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[(scale < 1e-12) | (not standardise)] = 1.0
    z = cov / np.outer(scale, scale) * n
    zy = (m[c, -1] - mean * my) / scale * n
    beta = np.linalg.solve(z + alpha * np.eye(len(c)), zy) / scale if len(c) else np.zeros(0)
    return float(my - mean @ beta), beta


def fit(splits: DataFrame, designs: dict[str, Sequence[int]], alphas: Sequence[float], standardise: bool = True) -> DataFrame:
    """One row per split, design and penalty with coefficients and held-out error; pass ``standardise=False`` for basis columns."""
    keys = [f for f in splits.schema.fields if f.name not in ("m_train", "n_train", "m_test", "n_test")]
    names = [f.name for f in keys]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keys] + [FIT_COLUMNS])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                train, test = unpack(np.asarray(row["m_train"], dtype=float)), unpack(np.asarray(row["m_test"], dtype=float))
                null = np.zeros(len(train))
                null[0], null[-1] = -train[0, -1] / train[0, 0], 1.0
                for design, cols in designs.items():
                    for alpha in alphas:
                        b0, b = solve_ridge(train, row["n_train"], cols, alpha, standardise)
                        e = np.zeros(len(train))
                        e[0], e[-1] = -b0, 1.0
                        e[np.asarray(cols, dtype=int) + 1] = -b
                        out.append([row[n] for n in names] + [design, alpha, b0, b, float(e @ test @ e), float(null @ test @ null), row["n_train"], row["n_test"]])
            yield pd.DataFrame(out, columns=names + ["design", "alpha", "intercept", "coef", "sse", "ss0", "n_train", "n_test"])

    return splits.mapInPandas(run, schema)


def predict(x: Sequence[Column], coef: str = "coef", intercept: str = "intercept") -> Column:
    return F.col(intercept) + A.dot(F.col(coef), F.array(*[c.cast("double") for c in x]))


def summed(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, m, n): statistics added up over the other keys."""
    long = stats.select(*by, "n", F.posexplode("m").alias("_k", "v")).groupBy(*by, "_k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "v"))), lambda e: e["v"]).alias("m"), F.max("n").alias("n"))


def inner_splits(stats: DataFrame, outer: str, inner: str, k: int) -> DataFrame:
    """Inner training and test parts (``_o``, inner, m_train, ...) of every outer fold 0 .. k - 1, from statistics keyed (fold, inner fold).

    The inner test part of outer fold o is the sum over the other folds of the same inner key.
    """
    other = stats.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).where(F.col(outer) != F.col("_o"))
    return leave_out(summed(other, ["_o", inner]), ["_o"], inner)


def inner_scores(stats: DataFrame, outer: str, inner: str, designs: dict[str, Sequence[int]], alphas: Sequence[float], k: int) -> DataFrame:
    """Mean inner MSE per outer fold, design and penalty."""
    fits = fit(inner_splits(stats, outer, inner, k), designs, alphas)
    return fits.groupBy(F.col("_o").alias(outer), "design", "alpha").agg(F.avg(F.col("sse") / F.col("n_test")).alias("mse"), F.avg(1 - F.col("sse") / F.col("ss0")).alias("q2"))


def select_alpha(scores: DataFrame, by: Sequence[str], scorer: str = "mse") -> DataFrame:
    """Best penalty per group, ties to the smaller one; 'mse' is minimised, 'q2' maximised."""
    s = F.col("mse") if scorer == "mse" else -F.col("q2")
    return scores.groupBy(*by).agg(F.min_by("alpha", F.struct(s.alias("s"), F.col("alpha").alias("a"))).alias("alpha"))


def spline_basis(x: Column, lo: Column, hi: Column) -> list[Column]:
    """First four of the five quadratic B-splines on four uniform knots over [lo, hi], linear outside."""
    h = (hi - lo) / 3
    inside = F.least(F.greatest(x, lo), hi)

    def shape(u):
        return F.when((u >= 0) & (u < 1), u * u / 2).when((u >= 1) & (u < 2), (-2 * u * u + 6 * u - 3) / 2).when((u >= 2) & (u <= 3), (3 - u) * (3 - u) / 2).otherwise(0.0)

    def slope(u):
        return F.when((u >= 0) & (u < 1), u).when((u >= 1) & (u < 2), 3 - 2 * u).when((u >= 2) & (u <= 3), u - 3).otherwise(0.0)

    out = []
    for j in range(4):
        u = (inside - lo) / h - (j - 2)
        out.append(shape(u) + slope(u) / h * (x - inside))
    return out


def training_bounds(df: DataFrame, fold: str, columns: Sequence[str], k: int) -> DataFrame:
    """Min and max of each column over the rows outside every fold."""
    per = df.groupBy(fold).agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    other = per.withColumn("outer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).where(F.col(fold) != F.col("outer"))
    return other.groupBy("outer").agg(*[F.min(f"lo_{c}").alias(f"lo_{c}") for c in columns], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in columns])

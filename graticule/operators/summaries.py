"""Relational summaries: quantile summaries, paired differences, correlations, risks, atlases."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graticule.plans import order_stats as O


def fold_summary(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Median, Q10, Q25, Q75, Q90, count and number of positive values."""
    q = O.quantiles(df, by, metric, {"q10": 0.10, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.90})
    n = df.groupBy(*by).agg(F.count(metric).alias("n"), F.count_if(F.col(metric) > 0).alias("n_positive"))
    return q.join(n, list(by))


def paired(df: DataFrame, keys: Sequence[str], vary: str, levels: Sequence[str], metric: Column) -> DataFrame:
    """One column per level of ``vary`` for every key; a conditional aggregate, not a self-join."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(vary) == v, metric)).alias(v) for v in levels])


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias(name))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Pearson correlation of mean ranks; ranks come from value counts, not from one sorted group."""
    by = list(by)
    ranked = O.with_average_rank(O.with_average_rank(df.select(*by, x, y), by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias(name))


def correlation_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of Pearson and Spearman coefficients."""
    for k, c in enumerate(columns):
        df = O.with_average_rank(df, [], c, f"_r{k}")
    pairs = [(a, b) for a in range(len(columns)) for b in range(a + 1, len(columns))]
    wide = df.agg(*[F.struct(F.corr(columns[a], columns[b]).alias("pearson"), F.corr(f"_r{a}", f"_r{b}").alias("spearman")).alias(f"c{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b"), F.col(f"c{a}_{b}.pearson").alias("pearson"), F.col(f"c{a}_{b}.spearman").alias("spearman")) for a, b in pairs])
    return wide.select(F.explode(rows).alias("e")).select("e.*")


def _correlation_row(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    d = len(columns)
    flat = [F.corr(columns[i], columns[j]) if i != j else F.lit(1.0) for i in range(d) for j in range(d)]
    return df.groupBy(*by).agg(F.array(*flat).alias("r"), F.count(F.lit(1)).alias("n"))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix; one aggregate, then a d x d inverse."""
    names, d = list(columns), len(columns)

    def solve(batches):
        for pdf in batches:
            for r in pdf["r"]:
                inv = np.linalg.inv(np.asarray(r, dtype=float).reshape(d, d))
                yield pd.DataFrame({"column_name": names, "vif": np.diag(inv)})

    return _correlation_row(df, columns).select("r").mapInPandas(solve, "column_name string, vif double")


def partial_effects(df: DataFrame, y: str, x: str, controls: Sequence[str], min_n: int = 10) -> DataFrame:
    """Partial R2, standardised beta and partial Spearman of x on y given the controls."""
    cols = [y, x, *controls]
    d = len(cols)
    ranked = df.select(*cols)
    for k, c in enumerate(cols):
        ranked = O.with_average_rank(ranked, [], c, f"_r{k}")
    both = _correlation_row(ranked, cols).select("r", "n").withColumn("kind", F.lit("value")).unionByName(
        _correlation_row(ranked, [f"_r{k}" for k in range(d)]).select("r", "n").withColumn("kind", F.lit("rank")))

    def solve(batches):
        for pdf in batches:
            for r, n, kind in zip(pdf["r"], pdf["n"], pdf["kind"]):
                m = np.asarray(r, dtype=float).reshape(d, d)
                inv = np.linalg.inv(m)
                partial = -inv[0, 1] / np.sqrt(inv[0, 0] * inv[1, 1])
                beta = np.linalg.solve(m[1:, 1:], m[1:, 0])[0]
                ok = n >= min_n
                yield pd.DataFrame({"kind": [kind], "partial": [partial if ok else None], "beta": [beta if ok else None], "n": [n]})

    s = both.mapInPandas(solve, "kind string, partial double, beta double, n long")
    value, rank = (lambda c: F.max(F.when(F.col("kind") == "value", F.col(c)))), (lambda c: F.max(F.when(F.col("kind") == "rank", F.col(c))))
    return s.agg((value("partial") * value("partial")).alias("partial_r2"), value("beta").alias("beta"), rank("partial").alias("partial_spearman"), value("n").alias("n"))


def component_weights(df: DataFrame, component: str) -> DataFrame:
    """weight = 1 / (number of components * rows of the component)."""
    sizes = df.groupBy(component).agg(F.count(F.lit(1)).alias("_rows"))
    k = sizes.agg(F.count(F.lit(1)).alias("k")).scalar()
    return df.join(sizes, component).withColumn("weight", 1.0 / (k * F.col("_rows"))).drop("_rows")


def balanced_mse(df: DataFrame, by: Sequence[str], component: str, error: Column) -> DataFrame:
    per = df.groupBy(*by, component).agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))
    return per.groupBy(*by).agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("n_components"))


def oof_metrics(df: DataFrame, by: Sequence[str], component: str, observed: str, predicted: str, null: str, n_expected: int | None = None) -> DataFrame:
    """Component-balanced MAE, RMSE, Q2 against the training null, coverage of the ``n_expected`` rows (of those present if not told)."""
    e, z = F.col(observed) - F.col(predicted), F.col(observed) - F.col(null)
    per = df.groupBy(*by, component).agg(F.avg(F.abs(e)).alias("a"), F.avg(e * e).alias("s"), F.avg(z * z).alias("z"), F.count(predicted).alias("n"), F.count(F.lit(1)).alias("m"))
    return per.groupBy(*by).agg(F.avg("a").alias("mae"), F.sqrt(F.avg("s")).alias("rmse"), (1 - F.avg("s") / F.avg("z")).alias("q2"),
                                (F.sum("n") / (F.sum("m") if n_expected is None else F.lit(n_expected))).alias("coverage"), F.count(F.lit(1)).alias("n_components"), F.sum("m").alias("n_rows"))


def regression_metrics(df: DataFrame, by: Sequence[str], observed: str, predicted: str) -> DataFrame:
    """R2, MAE, RMSE and Spearman; undefined values for a constant target stay NULL."""
    e = F.col(observed) - F.col(predicted)
    base = df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.var_pop(observed) * F.count(F.lit(1))).alias("_ss"), F.sum(e * e).alias("_sse"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("_ss") > 0, 1 - F.col("_sse") / F.col("_ss"))
    return base.withColumn("r2", r2).drop("_ss", "_sse").join(spearman(df, by, observed, predicted, "rho"), list(by))


def ordering_accuracy(df: DataFrame, pairs: DataFrame, by: Sequence[str], key: str, observed: str, predicted: str) -> DataFrame:
    """Share of the listed pairs (i, j) that are predicted in their observed order.

    Pairs that are observed equal have no order and are left out; a tie in the prediction is an error.
    """
    value = lambda end: df.select(*by, F.col(key).alias(end), F.col(observed).alias(f"o_{end}"), F.col(predicted).alias(f"p_{end}"))
    j = pairs.select("i", "j").join(value("i"), "i").join(value("j"), [*by, "j"]).where(F.col("o_i") != F.col("o_j"))
    right = F.signum(F.col("o_i") - F.col("o_j")) == F.signum(F.col("p_i") - F.col("p_j"))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(right.cast("double")).alias("accuracy"))


def q2(df: DataFrame, by: Sequence[str], observed: str, predicted: str, null: str) -> DataFrame:
    e, z = F.col(observed) - F.col(predicted), F.col(observed) - F.col(null)
    s = df.groupBy(*by).agg(F.sum(e * e).alias("sse"), F.sum(z * z).alias("ss0"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("q2", F.when(F.col("ss0") > 0, 1 - F.col("sse") / F.col("ss0")))


def auroc(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Rank-sum AUC and rank-biserial; only (group, score) counts are ordered."""
    by = list(by)
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    ranked = O.running_totals(counts.select(*by, score, "_n", "_p"), by, score)
    rank = F.col("_before") + (F.col("_n") + 1) / 2
    s = ranked.groupBy(*by).agg(F.sum(F.col("_p") * rank).alias("r"), F.sum("_p").cast("double").alias("p"), F.sum(F.col("_n") - F.col("_p")).cast("double").alias("q"))
    auc = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")))
    return s.select(*by, auc.alias("auc"), (2 * auc - 1).alias("rank_biserial"), F.col("p").cast("long").alias("n_pos"), F.col("q").cast("long").alias("n_neg"))


def pair_coverage(df: DataFrame, fold: str, session: str, component: str) -> DataFrame:
    """Countable pairs per fold and session, excluding pairs inside one component."""
    sizes = df.groupBy(fold, session, component).agg(F.count(F.lit(1)).alias("n"))
    k = F.count(F.lit(1))
    return sizes.groupBy(fold, session).agg(
        F.sum("n").alias("n_rows"), k.alias("n_components"), (k * (k - 1) / 2).cast("long").alias("n_component_pairs"),
        ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n_row_pairs"), F.when(k >= 2, "VALID").otherwise("NOT_ESTIMABLE").alias("state"))

"""Fitted models as tables, and their response curves, effects and importances in one pass over the rows.

A model is a row: kind ``linear`` (coef), ``square`` (coef of the columns, then of their squares), ``spline`` (four
quadratic B-spline coefficients per column with bounds lo, hi) or ``trees`` (nodes with feature, cut, children and value; a
row goes left if it is at most the cut; the prediction is the mean over trees).  Models are small (coefficients, or
nodes of trees) and travel to the tasks; rows never leave them: a task hands on sums per grid point, per bin or per
replicate.  Rows with a NULL or non-finite model input take no part.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graticule.operators import linear as L
from graticule.operators import permutations as N
from graticule.plans import order_stats as O
from graticule.plans.lineage import cut

MODEL = "model string, kind string, intercept double, coef array<double>, lo array<double>, hi array<double>, trees array<array<struct<feature:int,cut:double,left:int,right:int,value:double>>>"
LEAF = -1
CELLS = 1 << 20  # predictions held at once by a task
MODELS = 10_000  # models of one table


@dataclass
class Fitted:
    """A model row, ready to predict matrices of rows x columns."""

    kind: str
    intercept: float
    coef: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    trees: list

    @classmethod
    def of(cls, row) -> "Fitted":
        array = lambda v: np.asarray([] if v is None else v, float)
        f = cls(row["kind"], float(row["intercept"] or 0.0), array(row["coef"]), array(row["lo"]), array(row["hi"]), row["trees"] if row["trees"] is not None else [])
        if f.kind == "trees":
            sizes = [len(t) for t in f.trees]
            f._roots = np.cumsum([0] + sizes[:-1])
            nodes = [(n["feature"], n["cut"], n["left"] + r, n["right"] + r, n["value"]) for t, r in zip(f.trees, f._roots) for n in t]
            feature, at, left, right, value = (np.array(c) for c in zip(*nodes))
            f._nodes = feature.astype(int), at.astype(float), left.astype(int), right.astype(int), value.astype(float)
        return f

    @property
    def additive(self) -> bool:
        return self.kind != "trees"

    def contribution(self, j: int, x: np.ndarray) -> np.ndarray:
        """What column j adds to an additive model."""
        if self.kind == "linear":
            return self.coef[j] * x
        if self.kind == "square":
            return self.coef[j] * x + self.coef[len(self.coef) // 2 + j] * x * x
        return spline_columns(x, self.lo[j], self.hi[j]) @ self.coef[4 * j: 4 * j + 4]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.additive:
            return self.intercept + sum((self.contribution(j, x[:, j]) for j in range(x.shape[1])), np.zeros(len(x)))
        feature, at, left, right, value = self._nodes
        out = np.empty(len(x))
        step = max(CELLS // len(self._roots), 1)
        for k in range(0, len(x), step):
            rows = x[k: k + step]
            node = np.tile(self._roots, (len(rows), 1))
            while True:
                f = feature[node]
                inner = f != LEAF
                if not inner.any():
                    break
                below = np.take_along_axis(rows, np.maximum(f, 0), axis=1) <= at[node]
                node = np.where(inner, np.where(below, left[node], right[node]), node)
            out[k: k + step] = value[node].mean(axis=1)
        return self.intercept + out


def spline_columns(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The columns of ``linear.spline_basis`` for an array."""
    h = (hi - lo) / 3
    inside = np.clip(x, lo, hi)
    out = np.empty((len(x), 4))
    for j in range(4):
        u = (inside - lo) / h - (j - 2)
        parts = [(u >= 0) & (u < 1), (u >= 1) & (u < 2), (u >= 2) & (u <= 3)]
        shape = np.select(parts, [u * u / 2, (-2 * u * u + 6 * u - 3) / 2, (3 - u) * (3 - u) / 2], 0.0)
        slope = np.select(parts, [u, 3 - 2 * u, u - 3], 0.0)
        out[:, j] = shape + slope / h * (x - inside)
    return out


def model_table(spark: SparkSession, rows: list[dict], extra: str = "") -> DataFrame:
    """Models from dictionaries; missing fields are NULL."""
    schema = MODEL + extra
    names = [c.strip().split()[0] for c in MODEL.split("array<array")[0].rsplit(",", 1)[0].split(",")] + ["trees"] + [c.split()[0] for c in extra.split(", ") if c.strip()]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def linear_models(fits: DataFrame, width: int, columns: Sequence[int] | None = None, kind: str = "linear") -> DataFrame:
    """Model rows from ``linear.fit``: column k of the design is coefficient ``columns[k]`` of ``width``."""
    columns = list(range(width)) if columns is None else list(columns)
    coef = F.array(*[F.get("coef", F.lit(columns.index(k))) if k in columns else F.lit(0.0) for k in range(width)])
    keys = [c for c in fits.columns if c not in ("design", "alpha", "intercept", "coef", "sse", "ss0", "n_train", "n_test")]
    return fits.select(F.col("design").alias("model"), F.lit(kind).alias("kind"), "intercept", coef.alias("coef"), *[F.lit(None).cast("array<double>").alias(c) for c in ("lo", "hi")], F.lit(None).cast(MODEL.split("trees ")[1]).alias("trees"), *keys)


def squares(x: Sequence[str]) -> list[Column]:
    """Design columns of kind ``square``."""
    return [F.col(c).cast("double") for c in x] + [F.col(c).cast("double") * F.col(c).cast("double") for c in x]


def additive_model(df: DataFrame, x: Sequence[str], y: str, alpha: float = 1.0, name: str = "spline") -> DataFrame:
    """In-sample additive model: spline columns between each column's bounds, penalised as they are."""
    bounds = df.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in x], *[F.max(c).cast("double").alias(f"hi_{c}") for c in x]).select(F.struct("*").alias("b"))
    rows = df.withColumn("_b", bounds.scalar())
    basis = [b for c in x for b in L.spline_basis(F.col(c), F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}"))]
    fit = L.fit(L.whole(L.moments(rows, [], basis, F.col(y))), {name: list(range(len(basis)))}, [alpha], standardise=False)
    b = bounds.scalar()
    return linear_models(fit, 4 * len(x), kind="spline").withColumn("_b", b).withColumns({"lo": F.array(*[F.col(f"_b.lo_{c}") for c in x]), "hi": F.array(*[F.col(f"_b.hi_{c}") for c in x])}).drop("_b")


def exported_trees(model) -> list[list[tuple]]:
    """Nodes of a fitted ``pyspark.ml`` tree or forest of regression trees, each tree from its root."""
    def walk(node, nodes):
        at = len(nodes)
        nodes.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[at] = (LEAF, 0.0, 0, 0, float(node.prediction()))
        else:
            left, right = walk(node.leftChild(), nodes), walk(node.rightChild(), nodes)
            nodes[at] = (int(node.split().featureIndex()), float(node.split().threshold()), left, right, float(node.prediction()))
        return at

    out = []
    for tree in getattr(model, "trees", [model]):
        nodes: list = []
        walk(tree._java_obj.rootNode(), nodes)
        out.append(nodes)
    return out


def fetched(models: DataFrame, *keys: str) -> list[tuple[tuple, Fitted]]:
    rows = models.limit(MODELS + 1).collect()
    if len(rows) > MODELS:
        raise ValueError(f"more than {MODELS} models in one table")
    return [(tuple(r[k] for k in ("model", *keys)), Fitted.of(r)) for r in rows]


def matrix(pdf: pd.DataFrame, x: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose inputs are finite, and which those are."""
    m = pdf[list(x)].to_numpy(dtype=float, na_value=np.nan)
    ok = np.isfinite(m).all(axis=1)
    return m[ok], ok


def _long(df: DataFrame, x: Sequence[str]) -> DataFrame:
    """(feature, value) counts of the rows that take part; one shuffle for all columns."""
    finite = None
    for c in x:
        v = F.col(c).cast("double")
        one = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        finite = one if finite is None else finite & one
    rows = df.where(finite).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in x])).alias("e")).select("e.*")
    return O.value_counts(rows, ["feature"], "value")


def quantile_points(df: DataFrame, x: Sequence[str], probs: Sequence[float], few: int = 0) -> DataFrame:
    """(feature, k, x): distinct quantiles of each column, or its values where it has at most ``few``; one pass for all."""
    counts = cut(_long(df, x))
    ranked = O.running_totals(counts, ["feature"], "value")
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    pick = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_upto")), F.col("value")))
    points = F.array(*[pick(F.floor(p)) + (pick(F.ceil(p)) - pick(F.floor(p))) * F.max(p - F.floor(p)) for p in at])
    grid = ranked.groupBy("feature").agg(F.array_sort(F.array_distinct(points)).alias("points"), F.count(F.lit(1)).alias("n_distinct"))
    if few:
        least = counts.join(grid.where(F.col("n_distinct") <= few).select("feature"), "feature").groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("own"))  # at most ``few`` values
        grid = grid.join(least, "feature", "left").withColumn("points", F.coalesce("own", "points"))
    return grid.select("feature", F.posexplode("points").alias("k", "x"))


def partial_dependence(df: DataFrame, models: DataFrame, x: Sequence[str], grid: DataFrame) -> DataFrame:
    """(model, feature, k, x, response, n): mean prediction over all rows with one column set to each grid value."""
    x = list(x)
    points = {f: g.sort_values("k")["x"].to_numpy(float) for f, g in grid.toPandas().groupby("feature")}  # features x grid points
    all_models = fetched(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(k, f): np.zeros(len(p)) for k in range(len(all_models)) for f, p in points.items()}
        n = 0
        for pdf in batches:
            m, _ = matrix(pdf, x)
            n += len(m)
            for k, (_, model) in enumerate(all_models):
                whole = model.predict(m) if model.additive else None
                for f, p in points.items():
                    j = x.index(f)
                    if model.additive:  # the other columns' part is the same at every grid value
                        sums[k, f] += (whole - model.contribution(j, m[:, j])).sum() + len(m) * model.contribution(j, p)
                    else:
                        step = max(CELLS // max(len(p), 1), 1)
                        for a in range(0, len(m), step):
                            part = np.repeat(m[a: a + step], len(p), axis=0)
                            part[:, j] = np.tile(p, len(m[a: a + step]))
                            sums[k, f] += model.predict(part).reshape(-1, len(p)).sum(axis=0)
        for (k, f), s in sums.items():
            yield pd.DataFrame({"model": all_models[k][0][0], "feature": f, "k": np.arange(len(s)), "x": points[f], "s": s, "n": n})

    parts = df.select(*x).mapInPandas(run, "model string, feature string, k int, x double, s double, n long")
    return parts.groupBy("model", "feature", "k").agg(F.first("x").alias("x"), F.try_divide(F.sum("s"), F.sum("n")).alias("response"), F.sum("n").alias("n"))


def response_at_means(df: DataFrame, models: DataFrame, x: Sequence[str], grid: DataFrame) -> DataFrame:
    """(model, feature, k, x, response): prediction along the grid with all other columns at their mean."""
    x = list(x)
    means = df.agg(*[F.avg(c).alias(c) for c in x]).select(F.array(*x)).scalar()
    all_models = fetched(models)

    def run(batches):
        for pdf in batches:
            m = np.stack(pdf["means"].to_numpy()).astype(float) if len(pdf) else np.empty((0, len(x)))
            m[np.arange(len(m)), [x.index(f) for f in pdf["feature"]]] = pdf["x"]
            for (name,), model in all_models:
                yield pd.DataFrame({"model": name, "feature": pdf["feature"], "k": pdf["k"], "x": pdf["x"], "response": model.predict(m)})

    return grid.withColumn("means", means).mapInPandas(run, "model string, feature string, k int, x double, response double")


def accumulated_effects(df: DataFrame, models: DataFrame, x: Sequence[str], bins: int) -> DataFrame:
    """(model, feature, bin, lo, hi, n, effect): accumulated local effects, centred by their mean over rows.

    Bins lie between distinct quantiles, closed below (the last one on both sides); empty bins give no row, columns with
    fewer than two bins no curve.  Tasks hand on (sum, count) per bin.
    """
    x = list(x)
    edges = {f: g.sort_values("k")["x"].to_numpy(float) for f, g in quantile_points(df, x, np.linspace(0, 1, bins + 1)).toPandas().groupby("feature")}
    edges = {f: e for f, e in edges.items() if len(e) >= 3}
    all_models = fetched(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {(k, f): np.zeros((2, len(e) - 1)) for k in range(len(all_models)) for f, e in edges.items()}
        for pdf in batches:
            m, _ = matrix(pdf, x)
            for f, e in edges.items():
                j = x.index(f)
                b = np.clip(np.searchsorted(e, m[:, j], side="right") - 1, 0, len(e) - 2)
                low, high = m.copy(), m.copy()
                low[:, j], high[:, j] = e[b], e[b + 1]
                for k, (_, model) in enumerate(all_models):
                    d = model.contribution(j, e[b + 1]) - model.contribution(j, e[b]) if model.additive else model.predict(high) - model.predict(low)
                    held[k, f] += np.stack([np.bincount(b, d, minlength=len(e) - 1), np.bincount(b, minlength=len(e) - 1)])
        for (k, f), (s, n) in held.items():
            e = edges[f]
            yield pd.DataFrame({"model": all_models[k][0][0], "feature": f, "bin": np.arange(len(s)), "lo": e[:-1], "hi": e[1:], "s": s, "n": n.astype(int)})

    parts = df.select(*x).mapInPandas(run, "model string, feature string, bin int, lo double, hi double, s double, n long")
    per = parts.groupBy("model", "feature", "bin").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    curve = Window.partitionBy("model", "feature")  # one row per bin
    acc = per.withColumn("acc", F.sum(F.col("s") / F.col("n")).over(curve.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_bins", F.count(F.lit(1)).over(curve))
    centred = F.col("acc") - F.sum(F.col("acc") * F.col("n")).over(curve) / F.sum("n").over(curve)
    return acc.where("_bins >= 2").select("model", "feature", "bin", "lo", "hi", "n", centred.alias("effect"))


def permutation_importance(df: DataFrame, models: DataFrame, x: Sequence[str], y: str, fold: str, key: str, reps: int, seed) -> DataFrame:
    """(model, feature, fold, q2_base, q2_perm, importance): held-out skill lost when one column moves inside the test fold.

    ``models`` has a row per fold, fitted on the other folds.  Replicate r gives row i the columns of the row that the keyed
    bijection names, so rows x replicates are joined once by index for all columns and nothing is ordered.  Skill is
    measured against the mean of the other folds.
    """
    x = list(x)
    all_models: dict = {}
    for (name, at), model in fetched(models, fold):
        all_models.setdefault(at, []).append((name, model))
    kind = dict(df.select(fold).dtypes)[fold]
    rows = df.select(fold, key, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in x])
    for c in ["_y", *x]:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    placed = N.positions(rows, [fold], key).join(rows, [fold, key]).drop(key)

    def moved(batches):
        keys = N.round_keys(seed, 0, reps)
        for pdf in batches:
            p = N.partners(pdf["index"].to_numpy(), pdf["n"].to_numpy(), keys)
            out = pdf.loc[np.repeat(pdf.index, reps)].reset_index(drop=True)
            yield out.assign(rep=np.tile(np.arange(reps), len(pdf)), at=p.ravel())[[fold, "rep", "at", "_y", *x]]

    targets = placed.mapInPandas(moved, f"{fold} {kind}, rep int, at long, _y double, " + ", ".join(f"{c} double" for c in x))
    source = placed.select(fold, F.col("index").alias("at"), *[F.col(c).alias(f"_{c}") for c in x])
    pairs = targets.join(source, [fold, "at"]).select(fold, "rep", "_y", *x, *[f"_{c}" for c in x])

    def errors(batches):
        held: dict = {}
        for pdf in batches:
            for f, g in pdf.groupby(fold):
                m, other, truth, rep = g[x].to_numpy(float), g[[f"_{c}" for c in x]].to_numpy(float), g["_y"].to_numpy(float), g["rep"].to_numpy()
                for name, model in all_models.get(f, []):
                    for j, c in [(None, ""), *enumerate(x)]:
                        used = m.copy()
                        if j is not None:
                            used[:, j] = other[:, j]
                        s = np.bincount(rep, (truth - model.predict(used)) ** 2, minlength=reps)
                        held[name, f, c] = held.get((name, f, c), 0.0) + s
        for (name, f, c), s in held.items():
            yield pd.DataFrame({"model": name, fold: f, "feature": c, "rep": np.arange(reps), "sse": s})

    sse = pairs.mapInPandas(errors, f"model string, {fold} {kind}, feature string, rep int, sse double").groupBy("model", fold, "feature", "rep").agg(F.sum("sse").alias("sse")).groupBy("model", fold, "feature").agg(F.avg("sse").alias("sse"))
    ss0 = L.fit(L.leave_out(L.moments(rows, [fold], [], F.col("_y")), [], fold), {"null": []}, [0.0]).select(fold, "ss0")
    q2 = sse.join(ss0, fold).withColumn("q2", 1 - F.col("sse") / F.col("ss0"))
    base = q2.where("feature = ''").select("model", fold, F.col("q2").alias("q2_base"))
    return q2.where("feature <> ''").join(base, ["model", fold]).select("model", "feature", fold, "q2_base", F.col("q2").alias("q2_perm"), (F.col("q2_base") - F.col("q2")).alias("importance"))

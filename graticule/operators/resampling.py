"""Bootstrap, permutation and exact tests on keyed hash draws.

Rows are reduced to clusters, units or values first; only those small tables are expanded by
replicate.  Replicates are exploded from a sequence on the reduced rows, never cross-joined.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions.hashing import draw_key, hex_prefix, pick, uniform
from graticule.plans import order_stats as O
from graticule.plans.lineage import shared


def replicates(reps: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))


def indexed(units: DataFrame, key: str, strata: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based index ``_i`` in digest order and size ``_k`` of the stratum."""
    strata = list(strata)
    rows = units.withColumn("_h", F.md5(F.col(key).cast("string")))
    rows = O.ordinal(rows, strata, [F.col("_h"), F.col(key)], [hex_prefix(F.col("_h"))], "_i").withColumn("_i", F.col("_i") - 1).drop("_h")
    size = units.groupBy(*strata).agg(F.count(F.lit(1)).alias("_k"))
    return rows.join(size, strata) if strata else rows.withColumn("_k", size.scalar())


def bootstrap_counts(units: DataFrame, key: str, reps: int, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """Shared bank (stratum, rep, unit, w): units drawn with replacement inside each stratum."""
    strata = list(strata)
    ix = shared(indexed(shared(units.select(*strata, key).distinct()), key, strata))
    draws = ix.select(*strata, "_i", "_k", replicates(reps).alias("rep"))
    draws = draws.select(*strata, "rep", pick(F.col("_k"), seed, *[F.col(s) for s in strata], F.col("rep"), F.col("_i")).alias("_i"))
    counts = draws.groupBy(*strata, "rep", "_i").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(ix.select(*strata, "_i", key), [*strata, "_i"]).select(*strata, "rep", key, "w")


def weighted_means(bank: DataFrame, sums: DataFrame, keys: Sequence[str], total: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Replicate statistic sum(w * total) / sum(w * weight)."""
    j = bank.join(sums, list(keys))
    return j.groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col(total)) / F.sum(F.col("w") * F.col(weight))).alias("stat"))


def resampled_means(sums: DataFrame, key: str, reps: int, seed: int, total: str, weight: str, strata: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, stat): ``weighted_means`` over the bank of ``bootstrap_counts``, without writing the bank.

    Every draw meets its unit's sums once and is added up where it lies: rows x replicates cross the network once, as a
    stratum, a replicate and an index, and the hashed side of the join is the units, not the draws.
    """
    strata = list(strata)
    ix = shared(indexed(shared(sums.select(*strata, key).distinct()), key, strata))
    draws = ix.select(*strata, "_i", "_k", replicates(reps).alias("rep"))
    draws = draws.select(*strata, "rep", pick(F.col("_k"), seed, *[F.col(s) for s in strata], F.col("rep"), F.col("_i")).alias("_i"))
    of = ix.join(sums, [*strata, key]).select(*dict.fromkeys([*strata, "_i", *by, total, weight]))
    j = draws.join(of.hint("shuffle_hash"), [*strata, "_i"])
    return j.groupBy(*by, "rep").agg((F.sum(total) / F.sum(weight)).alias("stat"))


def interval(stats: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    return O.quantiles(stats, by, "stat", {"low": a, "high": 1 - a})


def hashed_order(df: DataFrame, by: Sequence[str], key: str, seed, name: str, *parts: Column, tasks: int | None = None) -> DataFrame:
    """Random order of ``key`` inside ``by`` (rank of the md5 digest, key as tie-break)."""
    rows = df.withColumn("_h", draw_key(seed, *parts, F.col(key)))
    return O.ordinal(rows, by, [F.col("_h"), F.col(key)], [hex_prefix(F.col("_h"))], name, tasks).drop("_h")


def natural_order(df: DataFrame, by: Sequence[str], key: str, name: str) -> DataFrame:
    """Order of a unique numeric key, through counts per bucket of values."""
    r = O.running_totals(df.select(*by, key).withColumn("_n", F.lit(1).cast("long")), by, key)
    return df.join(r.select(*by, key, (F.col("_before") + 1).alias(name)), [*by, key])


def permuted(units: DataFrame, blocks: Sequence[str], key: str, value: str, reps: int, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """(block, rep, key, value, keep): values reassigned to keys inside each block, once per replicate.

    Columns in ``keep`` stay with their key.  Rows x replicates are ordered by as many tasks as keep each at ``O.TASK_ROWS``.
    """
    blocks = list(blocks)
    base = shared(natural_order(units.select(*blocks, key, value, *keep), blocks, key, "_r"))
    tasks = O.partitions(units, base.count() * reps)
    spread = base.select(*blocks, key, *keep, replicates(reps).alias("rep"))
    shuffled = hashed_order(spread, [*blocks, "rep"], key, seed, "_r", F.col("rep"), tasks=tasks)
    taken = O.dealt(base.select(*blocks, "_r", value), tasks, *blocks, "_r")
    return O.dealt(shuffled, tasks, *blocks, "_r").join(taken, [*blocks, "_r"]).select(*blocks, "rep", key, value, *keep)


def permutation_p(null: DataFrame, observed: Column, stat: str = "stat") -> DataFrame:
    """(1 + #{null >= obs}) / (1 + n), the lower-tail twin, skipping undefined replicates."""
    ok = F.col(stat).isNotNull() & ~F.isnan(stat)
    n = F.count_if(ok)
    up, low = F.count_if(ok & (F.col(stat) >= F.col("_obs") - EVEN)), F.count_if(ok & (F.col(stat) <= F.col("_obs") + EVEN))
    return null.withColumn("_obs", observed).agg(F.max("_obs").alias("observed"), ((1 + up) / (1 + n)).alias("p_upper"), ((1 + low) / (1 + n)).alias("p_lower"), n.alias("n_null"))


EVEN = 1e-12  # replicates equal to the observed value up to summation order count as reaching it


def two_sided_p(null: DataFrame, observed: Column, centre: float, stat: str = "stat") -> DataFrame:
    """(observed, p_two_sided): share of replicates at least as far from the centre, the observed one included."""
    far = F.abs(F.col(stat) - centre) >= F.abs(F.col("_obs") - centre) - EVEN
    return null.where(F.col(stat).isNotNull()).withColumn("_obs", observed).agg(F.max("_obs").alias("observed"), ((1 + F.count_if(far)) / (1 + F.count(F.lit(1)))).alias("p_two_sided"))


def weighted_tv(df: DataFrame, group: str, klass: str, classes: Sequence[str], null_counts: DataFrame) -> DataFrame:
    """(t_obs, p_value, t_null_median): distance of each group's class shares from the pooled null centre, weighted by group size.

    ``null_counts`` holds (group, rep, c0, c1, ...) as ``permutations.class_counts`` gives them.
    """
    names = [f"c{k}" for k in range(len(classes))]
    real = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[(F.count_if(F.col(klass) == k) / F.count(F.lit(1))).alias(f"q{i}") for i, k in enumerate(classes)])
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    real = real.withColumn("w", F.col("_n") / total)
    share = null_counts.join(real.select(group, "_n", "w"), group).select(group, "rep", "w", *[(F.col(c) / F.col("_n")).alias(f"q{i}") for i, c in enumerate(names)])
    centre = share.groupBy(group).agg(*[F.avg(f"q{i}").alias(f"b{i}") for i in range(len(classes))])
    away = F.sum(F.col("w") * tv([F.col(f"q{i}") for i in range(len(classes))], [F.col(f"b{i}") for i in range(len(classes))]))
    observed = real.join(centre, group).agg(away.alias("t")).scalar()
    stats = share.join(centre, group).groupBy("rep").agg(away.alias("t"))
    p = stats.withColumn("o", observed).agg(F.max("o").alias("t_obs"), ((1 + F.count_if(F.col("t") >= F.col("o") - EVEN)) / (1 + F.count(F.lit(1)))).alias("p_value"))
    return p.withColumn("t_null_median", O.median(stats, [], "t", "m").scalar())


def tv(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Total variation distance of two probability vectors."""
    parts = [F.abs(x - y) for x, y in zip(a, b)]
    return sum(parts[1:], parts[0]) / 2


def exact_signflip(units: DataFrame, key: str, columns: Sequence[str], max_units: int = 20) -> DataFrame:
    """All 2^m sign patterns of m unit differences: global norm and per-coordinate two-sided p.

    Every unit row is expanded by the configurations, so each pattern is one partially
    aggregated group.
    """
    m = units.count()
    if m > max_units:
        raise ValueError(f"exact enumeration with {m} units is not feasible")
    ix = natural_order(units, [], key, "_b")
    cfg = ix.withColumn("cfg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**m - 1).cast("long"))))
    sign = F.when(F.expr("shiftright(cfg, cast(_b - 1 as int)) & 1") == 1, -1.0).otherwise(1.0)
    means = cfg.groupBy("cfg").agg(*[(F.sum(sign * F.col(c)) / m).alias(c) for c in columns])
    obs = ix.agg(*[F.avg(c).alias(c) for c in columns])
    o = obs.select(F.struct(*columns)).scalar()
    norm = lambda f: F.sqrt(sum([f(c) * f(c) for c in columns[1:]], f(columns[0]) * f(columns[0])))
    eps = 1e-9  # patterns equal to the observed one up to summation order count as equal
    hit = lambda c: F.count_if(F.abs(F.col(c)) >= F.abs(o[c]) - eps)
    total = F.lit(float(2**m))
    return means.agg(F.max(norm(lambda c: o[c])).alias("t_obs"), (F.count_if(norm(F.col) >= norm(lambda c: o[c]) - eps) / total).alias("p_global"),
                     *[(hit(c) / total).alias(f"p_{c}") for c in columns], F.count(F.lit(1)).alias("n_configurations"))


def logistic_slope(df: DataFrame, x: str, label: str) -> DataFrame:
    """Unpenalised logistic slope; rows are first counted per distinct (x, label)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = df.groupBy(F.col(x).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    data = VectorAssembler(inputCols=["_x"], outputCol="_f").transform(counts)
    model = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", regParam=0.0, maxIter=200, tol=1e-10).fit(data)
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


def cluster_moments(df: DataFrame, cluster: str, vector: str, d: int) -> DataFrame:
    """Per cluster: rows, sum vector, flattened cross-product matrix; one partial product per batch."""
    def partial(batches):
        for pdf in batches:
            for c, g in pdf.groupby(cluster):
                x = np.stack([np.asarray(v, dtype=float) for v in g[vector]])
                yield pd.DataFrame({"cluster": [c], "n": [float(len(x))], "s": [x.sum(0)], "q": [(x.T @ x).ravel()]})

    parts = df.select(F.col(cluster).cast("long").alias(cluster), vector).mapInPandas(partial, "cluster long, n double, s array<double>, q array<double>")
    long = parts.select("cluster", "n", F.posexplode(F.concat(F.array("n"), "s", "q")).alias("k", "v"))
    summed = long.groupBy("cluster", "k").agg(F.sum("v").alias("v"))
    packed = summed.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p"))  # 1 + d + d*d entries
    return packed.select(F.col("cluster").alias(cluster), F.transform("p", lambda e: e["v"]).alias("m"))


def _eigen(m: np.ndarray, d: int, k: int):
    n, s, q = m[0], m[1:1 + d], m[1 + d:].reshape(d, d)
    cov = q / n - np.outer(s / n, s / n)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    return v[:, order[:k]], w[order] / max(w.sum(), 1e-300)


def largest_angle(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip(np.linalg.svd(a.T @ b, compute_uv=False), 0, 1)).max()))


def pca_bootstrap_angles(df: DataFrame, cluster: str, vector: str, d: int, k: int, reps: int, seed: int) -> DataFrame:
    """Angle between the top-k subspace of each cluster resample and of the full data."""
    moments = shared(cluster_moments(df, cluster, vector, d))
    bank = bootstrap_counts(moments, cluster, reps, seed)
    full = moments.select(F.lit(-1).alias("rep"), F.lit(1).cast("long").alias("w"), "m")
    rows = bank.join(moments, cluster).select("rep", "w", "m").unionByName(full)
    long = rows.select("rep", "w", F.posexplode("m").alias("i", "v")).groupBy("rep", "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    per = long.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("m"))
    per = shared(per)
    reference = per.where("rep = -1").select(F.col("m")).scalar()

    def solve(batches):
        for pdf in batches:
            out = []
            for rep, m, r in zip(pdf["rep"], pdf["m"], pdf["ref"]):
                (a, evr), (b, _) = _eigen(np.asarray(m), d, k), _eigen(np.asarray(r), d, k)
                out.append((rep, largest_angle(a, b), float(evr[:k].sum())))
            yield pd.DataFrame(out, columns=["rep", "angle_deg", "evr"])

    return per.where("rep >= 0").withColumn("ref", reference).select("rep", "m", "ref").mapInPandas(solve, "rep long, angle_deg double, evr double")


def matched_subset(df: DataFrame, cluster: str, row: str, in_subset: Column, reps: int, seed: int) -> DataFrame:
    """Random subsets with the cluster-size pattern of the given subset.

    The r-th largest subset cluster is matched with the r-th pool cluster in hashed order; rows
    are taken in hashed order up to the wanted size (or all of a smaller cluster).
    """
    sizes = df.where(in_subset).groupBy(cluster).agg(F.count(F.lit(1)).alias("want"))
    ranked = O.ordinal(sizes, [], [F.desc("want"), F.col(cluster)], [-F.col("want")], "_r").select("_r", "want")
    pool = df.select(cluster).distinct().select(cluster, replicates(reps).alias("rep"))
    order = hashed_order(pool, ["rep"], cluster, seed, "_r", F.col("rep"))
    chosen = order.join(ranked, "_r").select("rep", cluster, "want")
    members = hashed_order(df.select(cluster, row).join(chosen, cluster), ["rep", cluster], row, seed + 1, "_p", F.col("rep"))
    return members.where("_p <= want").select("rep", cluster, row)

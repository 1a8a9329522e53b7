"""Runs, widths and steps of ordered series."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.functions import arrays as A
from graticule.plans import order_stats as O
from graticule.plans import series as S
from graticule.plans.lineage import cut, shared


def threshold_runs(df: DataFrame, by: Sequence[str], order: str, flag: Column, rows: float = S.SLICE_ROWS, keep: bool = False) -> DataFrame:
    """Contiguous runs of true flags: start, end, rows.  Runs are reduced map-side.

    ``keep`` adds the slice of each start, so that a following step along ``s0`` need not cut the runs anew.
    """
    numbered = S.islands(S.sliced(df.where(F.col(order).isNotNull()), by, order, rows), by, order, flag)
    found = numbered.groupBy(*by, "island").agg(F.min(order).alias("s0"), F.max(order).alias("s1"), F.count(F.lit(1)).alias("n"), *([F.min(S.SLICE).alias(S.SLICE)] if keep else [])).drop("island")
    return found.withColumn(S.KEY, F.struct(*[F.col(c) for c in by], F.col(S.SLICE))) if keep else found


def merge_runs(runs: DataFrame, by: Sequence[str], gap: float, rows: float = S.SLICE_ROWS) -> DataFrame:
    """Bridge gaps up to ``gap`` between neighbouring runs."""
    prev = S.with_previous(S.sliced(runs, by, "s0", rows), by, "s0", F.col("s1"), "_end")
    start = F.when(F.col("s0") - F.col("_end") <= gap, 0).otherwise(1).cast("long")
    numbered = S.with_running_sum(prev, by, "s0", start, "_k")
    return numbered.groupBy(*by, "_k").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_runs")).drop("_k")


def longest_run(runs: DataFrame, by: Sequence[str], min_len: float) -> DataFrame:
    best = F.max_by(F.struct("s0", "s1"), F.struct((F.col("s1") - F.col("s0")).alias("l"), (-F.col("s0")).alias("o")))
    return runs.groupBy(*by).agg(best.alias("b")).select(*by, "b.s0", "b.s1", (F.col("b.s1") - F.col("b.s0") >= min_len).alias("long_enough"))


def plateau_run(df: DataFrame, by: Sequence[str], order: str, online: Column, depth: str, depth_frac: float, gap: float,
                min_len: float, min_frac: float, rows: float = S.SLICE_ROWS, ref_quantile: float = 0.9) -> DataFrame:
    """Longest bridged run of on-line positions with plateau depth; bridged dips are not members.

    Every series is returned; one without a qualifying position has the state ``no_plateau``.
    """
    by = list(by)
    frame = df.select(*by, order, depth, online.alias("_on"))
    on = frame.where("_on")
    spans = frame.groupBy(*by).agg((F.max(F.when(F.col("_on"), F.col(order))) - F.min(F.when(F.col("_on"), F.col(order)))).alias("_span"))
    ref = shared(spans.join(O.quantiles(on, by, depth, {"_ref": ref_quantile}), by, "left"))  # one row per series, read by every branch below
    marked = frame.join(ref, by).withColumn("_ok", F.col("_on") & (F.col(depth) >= depth_frac * F.col("_ref")))
    marked = cut(S.sliced(marked.where(F.col(order).isNotNull()).select(*by, order, "_ok"), by, order, rows))  # narrow, read several times below
    merged = merge_runs(threshold_runs(marked, by, order, F.col("_ok"), keep=True), by, gap)
    best = F.max_by(F.struct("s0", "s1", "n"), F.struct((F.col("s1") - F.col("s0")).alias("l"), (-F.col("s0")).alias("o")))
    best = merged.groupBy(*by).agg(best.alias("b"))
    lo, hi = F.col("b.s0"), F.col("b.s1")
    state = F.when(lo.isNull(), "no_plateau").when(hi - lo < F.greatest(F.lit(min_len), min_frac * F.col("_span")), "fragmented").otherwise("stable")
    return ref.join(best, by, "left").select(*by, lo.alias("lo"), hi.alias("hi"), F.coalesce("b.n", F.lit(0)).alias("n_members"), state.alias("state"))


def min_spacing(df: DataFrame, by: Sequence[str], order: str, step: float) -> DataFrame:
    """Greedy selection of rows at least ``step`` apart, exact.

    A gap of at least ``step`` before a row always selects it, whatever was kept earlier, so the
    series falls apart into independent segments.  Inside segments the "next kept" pointers are
    followed with pointer doubling, so no task ever walks a whole series.
    """
    by = list(by)
    base = df.select(*by, F.col(order).alias("s")).distinct()
    # next(s) = smallest value >= s + step: look forward from shifted probes through the same series
    probes = base.select(*by, (F.col("s") + step).alias("p"), F.col("s").alias("src"), F.lit(None).cast("double").alias("v"), F.lit(0).alias("kind"))
    values = base.select(*by, F.col("s").alias("p"), F.lit(None).cast("double").alias("src"), F.col("s").alias("v"), F.lit(1).alias("kind"))
    seen = S.with_last_seen(probes.unionByName(values), by, "p", F.col("v"), "nxt", forward=True)
    jump = seen.where("kind = 0").select(*by, "src", F.col("nxt").alias("dst"))
    prev = S.with_previous(base, by, "s", F.col("s"), "before")
    kept = cut(prev.where(F.col("before").isNull() | (F.col("s") - F.col("before") >= step)).select(*by, "s"))
    jump = cut(jump.where("dst IS NOT NULL"))
    n = kept.count()
    while True:
        reached = kept.withColumnRenamed("s", "src").join(jump, [*by, "src"]).select(*by, F.col("dst").alias("s"))
        kept = cut(kept.unionByName(reached).distinct())
        now = kept.count()
        if now == n:
            return kept
        n = now
        far = jump.select(*by, F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = cut(jump.join(far, [*by, "dst"], "left").select(*by, "src", F.col("far").alias("dst")).where("dst IS NOT NULL"))


def _runs_of(flags: Column) -> Column:
    """Array of (i0, i1) for the runs of true in a bounded boolean array."""
    n = F.size(flags)
    at = lambda k: F.coalesce(F.get(flags, k.cast("int")), F.lit(False))
    index = F.sequence(F.lit(0), n - 1)
    starts = F.filter(index, lambda i: at(i) & ~F.when(i > 0, at(i - 1)).otherwise(F.lit(False)))
    ends = F.filter(index, lambda i: at(i) & ~at(i + 1))
    return F.arrays_zip(starts.alias("i0"), ends.alias("i1"))


def threshold_widths(signals: DataFrame, key: str, value: str, dx: float, levels: Sequence[float]) -> DataFrame:
    """Widest run above q * max per level, with sub-sample boundaries and censoring at ends and gaps."""
    top = F.array_max(value)
    rows = signals.where(top > 0).withColumn("_d", A.let(top, lambda m: F.transform(value, lambda v: v / m))) \
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in levels])))
    rows = rows.withColumn("_flags", F.transform("_d", lambda v: F.coalesce(v >= F.col("q"), F.lit(False)))).withColumn("_runs", A.let(F.col("_flags"), _runs_of))
    at = lambda k: F.get("_d", k.cast("int"))
    before = lambda i: F.when(i > 0, at(i - 1))

    def edge(r):
        i, j = r["i0"], r["i1"]
        left = F.when(before(i).isNull(), i * dx - dx / 2).otherwise(i * dx - (at(i) - F.col("q")) * dx / (at(i) - before(i)))
        right = F.when(at(j + 1).isNull(), j * dx + dx / 2).otherwise(j * dx + (F.col("q") - at(j)) * dx / (at(j + 1) - at(j)))
        return F.struct((right - left).alias("w"), (-i).alias("o"), (before(i).isNull() | at(j + 1).isNull()).alias("cen"))

    rows = rows.withColumn("_w", F.transform("_runs", edge)).withColumn("_best", F.array_max("_w"))
    return rows.select(key, "q", F.col("_best.w").alias("width"), F.col("_best.cen").alias("censored"), F.size("_w").alias("n_runs"), A.array_sum(F.col("_w.w")).alias("total_width"))


def _slope(values: Column, i: Column, j: Column, dx: float) -> Column:
    n = (j - i + 1).cast("double")
    seg = F.slice(values, (i + 1).cast("int"), (j - i + 1).cast("int"))
    mid = (n - 1) / 2  # offsets from the middle sum to zero, so the values need no centring
    sxy = A.array_sum(F.transform(seg, lambda v, k: (k - mid) * v))
    sxx = n * (n * n - 1) / 12
    return F.when(n >= 2, sxy / sxx / dx)


def section_features(signals: DataFrame, key: str, value: str, dx: float, affected: float) -> DataFrame:
    """Area, widths, wall slopes, asymmetry, ridges and skewness of one perpendicular profile."""
    v = F.col(value)
    n = F.size(v)
    rows = signals.withColumn("_top", F.array_max(v)).where("_top > 0").withColumn("_k", (F.array_position(v, F.col("_top")) - 1).cast("int")) \
        .withColumn("_runs", A.let(F.col("_top"), lambda m: A.let(F.transform(v, lambda x: x >= 0.5 * m), _runs_of))) \
        .withColumn("_best", F.array_max(F.transform("_runs", lambda r: F.struct((r["i1"] - r["i0"]).alias("l"), (-r["i0"]).alias("o"), r["i0"].alias("i0"), r["i1"].alias("i1"))))) \
        .withColumn("_in", F.col("_k").between(F.col("_best.i0"), F.col("_best.i1"))) \
        .withColumn("_aff", F.array_max(F.transform(A.let(F.transform(v, lambda x: F.abs(x) > affected), _runs_of), lambda r: r["i1"] - r["i0"])))
    i0, i1, k, inside = F.col("_best.i0"), F.col("_best.i1"), F.col("_k"), F.col("_in")
    left = F.slice(v, F.lit(1), F.when(inside, i0).otherwise(k))
    right_from = F.when(inside, i1).otherwise(k) + 2
    right = F.when(right_from <= n, F.slice(v, right_from, F.greatest(n - right_from + 1, F.lit(0))))
    trough = lambda part: F.greatest(F.lit(0.0), -F.coalesce(F.array_min(part), F.lit(0.0)))
    sep = F.when(inside & (F.array_min(left) < 0) & (F.array_min(right) < 0),
                 ((right_from - 1 + F.array_position(right, F.array_min(right)) - 1) - (F.array_position(left, F.array_min(left)) - 1)) * dx)
    skewness = A.let(A.array_mean(v), lambda mu: A.central_moment(v, mu, 3) / F.pow(A.central_moment(v, mu, 2), 1.5))
    area = A.array_sum(F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))) * dx
    return rows.select(
        key, area.alias("area"), (area / F.col("_top")).alias("eq_width"), F.coalesce(F.col("_aff") * dx + dx, F.lit(0.0)).alias("affected"),
        trough(left).alias("ridge_left"), trough(right).alias("ridge_right"),
        F.when(inside, ((i1 - k) - (k - i0)) * dx / F.greatest((i1 - i0) * dx, F.lit(1e-12))).alias("asymmetry"),
        F.when(inside, _slope(v, i0, k, dx)).alias("left_slope"), F.when(inside, _slope(v, k, i1, dx)).alias("right_slope"),
        sep.alias("separation"), skewness.alias("skewness"))


def selection_pool(reasons: DataFrame, key: str, tiers: Sequence[str], permanent: str, extreme: str, cap: int) -> DataFrame:
    """Members of a pool with their reasons, thinned to ``cap``.

    ``reasons`` has (key, reason, extreme).  Members are dropped tier by tier, the last of ``tiers`` first and
    the least extreme first, but only those whose reasons all lie in that tier; permanent members stay.  It
    fails when that cannot reach the cap.  The ranking runs over the members that may go.
    """
    number = F.coalesce(*[F.when(F.col("reason") == t, F.lit(k)) for k, t in enumerate(tiers)], F.lit(-1))
    members = reasons.withColumn("_t", F.when(F.col("reason") == permanent, F.lit(-1)).otherwise(number)).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"), F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.max(extreme).alias("_e"))
    free = (F.col("_low") == F.col("_high")) & (F.col("_low") >= 0)
    over = members.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("n")).scalar()
    going = members.where(free).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_low"), "_e", F.desc(key))))
    enough = members.agg(F.count_if(free).alias("n")).scalar() >= over
    kept = members.join(going.where(F.col("_k") <= over).select(key), key, "left_anti")
    checked = F.when(enough, F.col("reasons")).otherwise(F.raise_error(F.lit(f"the pool cannot be thinned to {cap}: too many members are permanent or have reasons in several tiers")).cast("string"))
    return kept.select(key, checked.alias("reasons"), F.col("_low").alias("tier"))


def holm(df: DataFrame, by: Sequence[str], p: str, tie: str, name: str) -> DataFrame:
    """Step-down adjusted p-values; a family of tests is a short list per ``by`` key."""
    w = Window.partitionBy(*by).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    stepped = df.withColumn("_a", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1)))
    return stepped.withColumn(name, F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")

"""Column expressions on bounded arrays (one map or one signal per row)."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` any number of times.

    A plain column reused inside a lambda would be inlined and evaluated per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shifted(values: Column, by: Column) -> Column:
    """values - by, with ``by`` evaluated once per row.  Free of nested lambdas, so the result may feed a pandas UDF."""
    return F.zip_with(values, F.array_repeat(by, F.size(values)), lambda v, m: v - m)


def finite_sorted(values: Column) -> Column:
    return F.sort_array(F.filter(values, lambda v: v.isNotNull()))


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolated quantile of an already sorted array."""
    pos = (F.size(ordered) - 1) * F.lit(float(p))
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    low = F.get(ordered, lo)
    return F.when(F.size(ordered) > 0, low + (F.get(ordered, hi) - low) * (pos - lo))


def array_quantile(values: Column, p: float) -> Column:
    return let(finite_sorted(values), lambda ordered: sorted_quantile(ordered, p))


def array_median(values: Column) -> Column:
    return array_quantile(values, 0.5)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def array_mean(values: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    step = lambda a, v: F.struct((a["s"] + F.coalesce(v, F.lit(0.0))).alias("s"), (a["n"] + v.isNotNull().cast("double")).alias("n"))
    return F.aggregate(values, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def central_moment(values: Column, mean: Column, p: int) -> Column:
    return mean_of(values, lambda v: F.pow(v - mean, p) if p > 2 else (v - mean) * (v - mean))


def mean_of(values: Column, f: Callable[[Column], Column]) -> Column:
    return array_mean(F.transform(values, f))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])

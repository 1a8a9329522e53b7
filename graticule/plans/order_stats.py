"""Exact ranks, running totals and quantiles without sorting one group in one task.

Values are first reduced to (group, value, count).  A code of the value alone cuts every group
into ordered buckets, bucket totals are accumulated (at most ``STEPS`` per doubling of the
value), and the fine ordering happens inside (group, bucket) only.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(df: DataFrame, by: Sequence[str], value: str, amount: str | Column | None = None) -> DataFrame:
    """Rows per distinct value; rows are pre-aggregated before the shuffle."""
    n = F.count(F.lit(1)) if amount is None else F.sum(F.col(amount) if isinstance(amount, str) else amount)
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))


STEPS = 4096  # buckets between a value and its double


def _bucket(value: Column) -> Column:
    """Order-preserving coarse code of a numeric value: sign and logarithm.

    It depends on the value alone, so every evaluation of a plan puts a value into the same bucket (edges taken from a
    sketch differ from one evaluation to the next, as its merge order does).
    """
    v = value.cast("double")
    size = F.greatest(F.least(F.floor(F.log2(F.abs(v)) * STEPS), F.lit(1100 * STEPS)), F.lit(-1100 * STEPS)) + F.lit(1200 * STEPS)
    # NaN sorts last
    return F.when(F.isnan(v), F.lit(2400 * STEPS)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("int")


def running_totals(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds ``_before`` (total of smaller values), ``_upto`` and ``_total`` per group."""
    by = list(by)
    fine = counts.withColumn("_bucket", _bucket(F.col(value)))
    group = Window.partitionBy(*by)
    offsets = (
        fine.groupBy(*by, "_bucket")
        .agg(F.sum("_n").alias("_size"))
        .withColumn("_offset", F.sum("_size").over(group.orderBy("_bucket")) - F.col("_size"))
        .withColumn("_total", F.sum("_size").over(group))
        .drop("_size")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    return (
        fine.join(offsets, [*by, "_bucket"])
        .withColumn("_upto", F.col("_offset") + F.sum("_n").over(inside))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .drop("_offset", "_bucket")
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles; one output column per entry of ``probs``."""
    by = list(by)
    ranked = running_totals(value_counts(df, by, value), by, value)
    outputs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo = (F.col("_before") <= lo) & (lo < F.col("_upto"))
        at_hi = (F.col("_before") <= hi) & (hi < F.col("_upto"))
        low = F.max(F.when(at_lo, F.col(value).cast("double")))
        high = F.max(F.when(at_hi, F.col(value).cast("double")))
        frac = F.max(pos - lo)
        outputs.append((low + (high - low) * frac).alias(name))
    return ranked.groupBy(*by).agg(*outputs)


def median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, by, value, {name: 0.5})


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """(group, value) -> mean rank of the tied rows, 1-based."""
    by = list(by)
    ranked = running_totals(value_counts(df, by, value), by, value)
    up = F.col("_before") + (F.col("_n") + 1) / 2
    rank = (F.col("_total") + 1 - up) if descending else up
    return ranked.select(*by, value, rank.cast("double").alias(name))


def with_average_rank(df: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False) -> DataFrame:
    return df.join(average_ranks(df, by, value, name, descending), [*by, value], "left")


TASK_ROWS = 500_000  # rows that one task orders


def partitions(df: DataFrame, rows: int) -> int | None:
    """Partitions that keep a task of ``rows`` rows at ``TASK_ROWS``, not fewer than the session's; None where one task is enough.

    A small table can sit in one partition, and all its replicates would be ordered there.
    """
    n = -(-rows // TASK_ROWS)
    return max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by their keys over that many partitions; None leaves it to the planner."""
    return df if parts is None else df.repartition(parts, *keys)


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """1-based position in a total order, counted bucket by bucket.

    ``bucket`` must be a coarse prefix of ``order`` (for hashed orders: the first hex digits),
    so that one task only sorts one bucket while bucket totals stay a small table.  Of a table that is known to be
    large, ``parts`` deals the buckets over more tasks than the session's.
    """
    by = list(by)
    keys = [f"_b{i}" for i in range(len(bucket))]
    rows = df.withColumns({k: b for k, b in zip(keys, bucket)})
    offsets = (
        rows.groupBy(*by, *keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.sum("_size").over(Window.partitionBy(*by).orderBy(*keys)) - F.col("_size"))
        .drop("_size")
    )
    inside = Window.partitionBy(*by, *keys).orderBy(*order)
    return (
        dealt(rows, parts, *by, *keys).withColumn("_in_bucket", F.row_number().over(inside))
        .join(offsets, [*by, *keys])
        .withColumn(name, (F.col("_offset") + F.col("_in_bucket")).cast("long"))
        .drop("_offset", "_in_bucket", *keys)
    )

"""Positions in a total order without a global or per-group window over the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.plans.lineage import cut

PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the position (from 0) of each row within ``group`` under ``order``.

    Rows are range-partitioned by (group, order), so a group that holds a third of all rows is spread over
    a third of the partitions.  Each (group, partition) block then needs one offset; that table has one row
    per block.  The ranged rows are checkpointed, because sampled range bounds must not be drawn twice.
    Pass narrow rows only.
    """
    group = list(group)
    keys = [F.col(g).asc_nulls_last() for g in group] + list(order)
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = cut(laid).withColumn("_part", F.shiftright("_at", PARTITION_BITS))
    blocks = laid.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        on = on & same(F.col(g), F.col(f"_g{k}"))
    return laid.join(blocks, on).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)

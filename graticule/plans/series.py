"""Ordered-series primitives that never need a whole series in one task.

A series (one ``by`` key) is cut into slices along the ordering axis.  Slices follow the rows, not the axis: a series
of more than ``SLICE_ROWS`` rows is cut at quantiles of a mergeable sketch, so a dense hour is cut like any other stretch;
rows at one position stay together.  Windows run inside (key, slice); only one summary row per slice is carried
across slices, and it is joined back on the partitioning that the slice window already produced.  Steps that follow
each other on the same axis share the slice column, so the rows are sketched and shuffled once.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.plans.lineage import cut

SLICE, KEY = "_slice", "_slice_key"
SLICE_ROWS = 50_000
MOST = 1_024  # slices of one series


def slice_edges(df: DataFrame, by: Sequence[str], order: str, rows: float) -> DataFrame:
    """(by, _edges, _coarse): the cuts of every series that is too long for one slice; one partial sketch per task and series."""
    probs = F.lit(np.arange(1, MOST) / MOST)  # one literal, however many cuts
    sketch = df.where(F.col(order).isNotNull()).groupBy(*by).agg(F.percentile_approx(order, probs, 4 * MOST).alias("_q"), F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(float(MOST * rows)) / F.col("_n")))
    edges = sketch.where(F.col("_n") > rows).select(*by, F.array_distinct(F.filter("_q", lambda _, i: (i + 1) % step == 0)).alias("_edges"))
    return edges.withColumn("_coarse", F.filter("_edges", lambda _, i: i % 64 == 63))


def sliced(df: DataFrame, by: Sequence[str], order: str, rows: float = SLICE_ROWS) -> DataFrame:
    """Adds the slice number and the slice's key; a frame that already carries them keeps them.

    The key is a struct of ``by`` and the slice.  Structs compare NULL fields as equal, so rows of a NULL
    series or position keep a slice of their own and find its summary again.
    """
    if SLICE in df.columns:
        return df
    by = list(by)
    edges = cut(slice_edges(df, by, order, rows))  # a row per long series; written, so that ``df`` is not planned twice
    if edges.isEmpty():
        out = df.withColumn(SLICE, F.when(F.col(order).isNotNull(), F.lit(0)).cast("long"))
        return out.withColumn(KEY, F.struct(*[F.col(c) for c in by], F.col(SLICE)))
    if by:  # few series are long; the rows of a long one need not meet for this join
        on = None
        for k, c in enumerate(by):
            edges = edges.withColumnRenamed(c, f"_b{k}")
            same = F.col(c).eqNullSafe(F.col(f"_b{k}"))
            on = same if on is None else on & same
        out = df.join(edges, on, "left").drop(*[f"_b{k}" for k in range(len(by))])
    else:
        out = df.withColumn("_e", edges.select(F.struct("_edges", "_coarse")).scalar()).withColumns({c: F.col(f"_e.{c}") for c in ("_edges", "_coarse")}).drop("_e")
    below = lambda array: F.coalesce(F.size(F.filter(array, lambda e: e < F.col(order))), F.lit(0))
    place = F.when(F.col("_edges").isNull(), 0).otherwise(F.col("_jump") + below(F.slice("_edges", F.col("_jump") + 1, F.lit(64))))
    out = out.withColumn("_jump", F.when(F.col("_coarse").isNull(), 0).otherwise(below(F.col("_coarse")) * 64))
    out = out.withColumn(SLICE, F.when(F.col(order).isNotNull(), place).cast("long")).drop("_edges", "_coarse", "_jump")
    return out.withColumn(KEY, F.struct(*[F.col(c) for c in by], F.col(SLICE)))


def _finish(out: DataFrame, given: DataFrame, *temporary: str) -> DataFrame:
    return out.drop(*temporary) if SLICE in given.columns else out.drop(*temporary, SLICE, KEY)


def _carried(frame: DataFrame, by: list[str], summaries: dict[str, Column]) -> DataFrame:
    """One row per slice that has a position; rows without one carry nothing on."""
    return frame.where(F.col(SLICE).isNotNull()).groupBy(*by, SLICE, KEY).agg(*[c.alias(n) for n, c in summaries.items()])


def with_previous(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, rows: float = SLICE_ROWS, forward: bool = False) -> DataFrame:
    """Value of the neighbouring row of the same series (previous, or next if ``forward``); NULL at a NULL position."""
    by = list(by)
    frame = sliced(df, by, order, rows).withColumn("_v", F.struct(F.col(order).alias("o"), value.alias("v")))
    inside = Window.partitionBy(KEY).orderBy(F.col(order).desc() if forward else F.col(order).asc())
    across = Window.partitionBy(*by).orderBy(F.col(SLICE).desc() if forward else F.col(SLICE).asc())
    carry = _carried(frame, by, {"_summary": (F.min if forward else F.max)("_v")}).select(KEY, F.lag("_summary").over(across).alias("_edge"))
    found = F.when(F.col("_first"), F.col("_edge.v")).otherwise(F.col("_prev.v"))
    out = (
        frame.withColumn("_prev", F.lag("_v").over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carry, KEY, "left")
        .withColumn(name, F.when(F.col(SLICE).isNotNull(), found))
    )
    return _finish(out, df, "_v", "_prev", "_first", "_edge")


def with_running_sum(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, rows: float = SLICE_ROWS) -> DataFrame:
    """Inclusive running sum along the series; NULL at a NULL position."""
    by = list(by)
    frame = sliced(df, by, order, rows).withColumn("_v", value)
    inside = Window.partitionBy(KEY).orderBy(order)
    across = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(frame, by, {"_summary": F.sum("_v")}).select(KEY, F.coalesce(F.sum("_summary").over(across), F.lit(0)).alias("_base"))
    out = (
        frame.withColumn("_cum", F.sum("_v").over(inside))
        .join(carry, KEY, "left")
        .withColumn(name, F.when(F.col(SLICE).isNotNull(), F.col("_base") + F.col("_cum")))
    )
    return _finish(out, df, "_v", "_cum", "_base")


def with_seen(df: DataFrame, by: Sequence[str], order: str, value: Column, back: str | None, ahead: str | None, rows: float = SLICE_ROWS) -> DataFrame:
    """Nearest non-null ``value`` at or before (``back``) and at or after (``ahead``) each row.

    Rows at the same position see each other; of several values there, the largest (ahead: the
    smallest) is taken, so the result does not depend on row order.  A row at a NULL position sees
    nothing and is not seen.
    """
    by = list(by)
    seen = value.isNotNull() & F.col(order).isNotNull()
    frame = sliced(df, by, order, rows).withColumn("_v", F.when(seen, F.struct(F.col(order).alias("o"), value.alias("v"))))
    upto, others = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    summary = _carried(frame, by, {"_last": F.max("_v"), "_head": F.min("_v")})
    edges, found = [], {}
    out = frame
    for name, pick, column, down in ((back, F.max, "_last", False), (ahead, F.min, "_head", True)):
        if name is None:
            continue
        sort = (lambda c: F.col(c).desc()) if down else (lambda c: F.col(c).asc())
        edges.append(pick(column).over(Window.partitionBy(*by).orderBy(sort(SLICE)).rowsBetween(*others)).alias(f"_edge{column}"))
        out = out.withColumn(f"_seen{column}", pick("_v").over(Window.partitionBy(KEY).orderBy(sort(order)).rangeBetween(*upto)))
        found[name] = F.coalesce(F.col(f"_seen{column}"), F.col(f"_edge{column}"))["v"]
    out = out.join(summary.select(KEY, *edges), KEY, "left").withColumns(found)
    return _finish(out, df, "_v", "_seen_last", "_seen_head", "_edge_last", "_edge_head")


def with_last_seen(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, rows: float = SLICE_ROWS, forward: bool = False) -> DataFrame:
    """One direction of :func:`with_seen`."""
    return with_seen(df, by, order, value, None if forward else name, name if forward else None, rows)


def islands(df: DataFrame, by: Sequence[str], order: str, flag: Column, rows: float = SLICE_ROWS, name: str = "island") -> DataFrame:
    """Numbers the contiguous runs of true flags; rows outside runs, and rows without a position, are dropped."""
    frame = sliced(df.where(F.col(order).isNotNull()), by, order, rows).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    marked = with_previous(frame, by, order, F.col("_flag"), "_was", rows)
    start = (F.col("_flag") & ~F.coalesce(F.col("_was"), F.lit(False))).cast("long")
    numbered = with_running_sum(marked, by, order, start, name, rows)
    return _finish(numbered.where("_flag"), df, "_flag", "_was")

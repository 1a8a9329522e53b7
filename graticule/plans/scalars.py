"""One-row aggregates used as scalar subqueries, so no join is planned for them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct column usable inside another plan."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()

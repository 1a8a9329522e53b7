"""Keyed, engine-independent randomness: every draw is a function of (seed, replicate, key)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw_key(*parts) -> Column:
    """md5 hex digest of the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(n: Column, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(uniform(*parts) * n).cast("long")


def hex_prefix(key: Column, digits: int = 2) -> Column:
    return F.substring(key, 1, digits)

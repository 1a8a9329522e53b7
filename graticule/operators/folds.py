"""Leakage-free fold assignment and its contracts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions.hashing import draw_key, hex_prefix
from graticule.operators.contracts import ContractError
from graticule.plans import order_stats as O


def _serpentine(position: Column, k: int) -> Column:
    """0..k-1, k-1..0, 0..k-1, ... along a 1-based position."""
    turn, step = F.floor((position - 1) / k), (position - 1) % k
    return F.when(turn % 2 == 0, step).otherwise(k - 1 - step).cast("long")


def group_folds(df: DataFrame, group: str, k: int, signature: Sequence[Column] = ()) -> DataFrame:
    """(group, n, fold): whole groups per fold, dealt in size order back and forth over the folds.

    Sizes are pre-aggregated; the order is (size descending, digest), counted bucket by bucket.
    ``signature`` columns (for example role counts) refine the order so that roles balance too.
    """
    extra = {f"_s{i}": c for i, c in enumerate(signature)}
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(n) for n, c in extra.items()])
    rows = sizes.withColumn("_h", F.md5(F.col(group).cast("string")))
    down = [-F.col("n"), *[-F.col(n) for n in extra]]
    ranked = O.ordinal(rows, [], [*down, F.col("_h")], [*down, hex_prefix(F.col("_h"))], "_p")
    return ranked.select(group, "n", _serpentine(F.col("_p"), k).alias("fold"))


def shuffled_holdouts(df: DataFrame, group: str, repeats: int, test_share: float, seed: int) -> DataFrame:
    """(rep, group, is_test): the first ceil(share * groups) groups in hashed order are held out."""
    groups = df.select(group).distinct()
    n = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    spread = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", draw_key(seed, F.col("rep"), F.col(group)))
    ranked = O.ordinal(spread, ["rep"], [F.col("_h"), F.col(group)], [hex_prefix(F.col("_h"))], "_p")
    return ranked.select("rep", group, (F.col("_p") <= F.ceil(n * F.lit(test_share))).alias("is_test"))


def nested_folds(df: DataFrame, group: str, outer: int, inner: int) -> DataFrame:
    """(outer, group, inner): inner folds dealt separately inside the training groups of each outer fold."""
    folds = group_folds(df, group, outer)
    train = folds.withColumn("outer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(outer - 1).cast("long")))).where("fold <> outer")
    rows = train.withColumn("_h", F.md5(F.col(group).cast("string")))
    ranked = O.ordinal(rows, ["outer"], [-F.col("n"), F.col("_h")], [-F.col("n"), hex_prefix(F.col("_h"))], "_p")
    return ranked.select("outer", group, _serpentine(F.col("_p"), inner).alias("inner"))


def fold_violations(df: DataFrame, fold: str, identities: Sequence[str]) -> DataFrame:
    """Identities that occur in more than one fold (leaks), per identity column."""
    out = None
    for c in identities:
        leak = df.groupBy(F.col(c).cast("string").alias("value")).agg(F.min(fold).alias("a"), F.max(fold).alias("b")).where("a <> b").select(F.lit(c).alias("identity"), "value")
        out = leak if out is None else out.unionByName(leak)
    return out


def check_folds(df: DataFrame, fold: str, identities: Sequence[str]) -> DataFrame:
    if not fold_violations(df, fold, identities).limit(1).isEmpty():
        raise ContractError("identity shared between folds")
    return df

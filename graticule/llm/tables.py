"""Written tables that end a lineage, and joins that one hot key cannot stop."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from graticule.plans.lineage import ensure_checkpoint_dir

HOT_ROWS = 100_000  # keys that are copied to every task at most


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet into the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, count: str, often: int) -> DataFrame:
    """``rows`` joined with ``lookup`` (unique in ``key``) on a key that is not null.

    ``count`` tells how many rows a key has.  The ``HOT_ROWS`` most frequent keys beyond ``often`` rows are broadcast,
    so their rows stay where they are; the others are shuffled, at most ``often`` rows a key.
    """
    hot = lookup.where(F.col(count) > often).orderBy(F.desc(count), key).limit(HOT_ROWS)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key)
    far = marked.where("_hot IS NULL").drop("_hot").join(lookup.join(F.broadcast(hot.select(key)), key, "left_anti"), key)
    return near.unionByName(far)

"""Cutting lineage of iterative jobs through reliable (shared-folder) checkpoints."""
from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared(df: DataFrame) -> DataFrame:
    """Keep a reduced intermediate that several branches of one plan read.

    Lazy, spills to disk and can be recomputed after executor loss.  Only pre-aggregated tables
    are shared this way, never raw input; ``spark.catalog.clearCache()`` releases them.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; fall back only for local sessions."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        folder = tempfile.mkdtemp(prefix="graticule-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder and forget its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iterative job in the checkpoint folder: each round is written whole, then the one before is removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, None

    def _remove(self, path: str | None) -> None:
        if path is not None:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def keep(self, df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(self.spark)
        path = f"{self.spark.sparkContext.getCheckpointDir()}/round-{uuid.uuid4()}"
        df.write.parquet(path)
        self._remove(self.last)
        self.last = path
        return self.spark.read.parquet(path)

    def end(self) -> None:
        self._remove(self.last)
        self.last = None

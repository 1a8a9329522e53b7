"""Query registry: every entry couples a Spark job with the DuckDB statement that checks it."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    """Lazy parquet readers: ``t.lineitem`` is the lineitem table of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    columns: dict[str, str]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[_spark_output(c, k) for c, k in self.columns.items()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_duck_output(c, k) for c, k in self.columns.items())
        return f"SELECT {cols} FROM ({self.sql}) AS result_rows"


DIGITS = {"d": 6, "e": 3}  # 'e' is for values far above one, where six decimals exceed double precision


def _spark_output(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind in DIGITS:
        return (F.round(c.cast("double"), DIGITS[kind]) + F.lit(0.0)).alias(name)
    return c.cast({"l": "long", "s": "string", "b": "boolean"}[kind]).alias(name)


def _duck_output(name: str, kind: str) -> str:
    if kind in DIGITS:
        return f'round(CAST("{name}" AS DOUBLE), {DIGITS[kind]}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS {dict(l="BIGINT", s="VARCHAR", b="BOOLEAN")[kind]}) AS "{name}"'


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(tables)``; ``columns`` reads 'name:kind ...' with kinds d, e, l, s, b."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, dict(c.split(":") for c in columns.split()), fn, sql)
        return fn

    return wrap

"""Reading and normalising input tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_csv_fallback(spark: SparkSession, path: str, schema: T.StructType, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Read a CSV with the first encoding that decodes without replacement characters.

    The check is a distributed scan of the text, so a bad byte anywhere in any file is seen.
    """
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    for encoding in encodings:
        df = spark.read.csv(path, schema=schema, header=True, encoding=encoding, ignoreLeadingWhiteSpace=False)
        broken = F.lit(False)
        for c in text:
            broken = broken | F.coalesce(F.contains(F.col(c), F.lit("�")), F.lit(False))
        if df.where(broken).limit(1).isEmpty():
            return df
    raise ValueError(f"none of the encodings {list(encodings)} decodes {path}")


def normalise_schema(df: DataFrame, aliases: dict[str, str], numeric: Sequence[str], label: str) -> DataFrame:
    """Rename known aliases, coerce numeric columns (bad text becomes NULL), flag rows without a label."""
    out = df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})
    out = out.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    return out.withColumn("has_label", F.col(label).isNotNull())


def decode_counts(raw: Column, step: Column | int, sentinel: int) -> Column:
    """Instrument counts to micrometres: half-up integer rounding in units of 1/1000, sentinel = missing."""
    scaled = F.floor((raw.cast("long") * step + 500) / 1000)
    return F.when(raw < sentinel, scaled / 1000.0)


def header_fields(path: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """Named metadata extracted from a path or file name; no match is NULL."""
    return {name: F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for name, p in patterns.items()}


def load_contract(manifest: DataFrame, descriptors: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Manifest joined 1:1 with descriptor tables; rows without a partner are flagged, not lost."""
    out = manifest
    for k, d in enumerate(descriptors):
        out = out.join(d.withColumn(f"_has{k}", F.lit(True)), list(keys), "left")
    flags = [F.coalesce(F.col(f"_has{k}"), F.lit(False)) for k in range(len(descriptors))]
    complete = flags[0]
    for f in flags[1:]:
        complete = complete & f
    return out.withColumn("complete", complete).drop(*[f"_has{k}" for k in range(len(descriptors))])


def latest_run(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Lexicographically last file below ``folder`` that matches ``glob``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.agg(F.max("path").alias("path"))

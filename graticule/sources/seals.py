"""Content seals of files and tables, sealed choices, locks and golden comparisons."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = 8 << 20
LEAKING = ("measured", "true", "observed")  # fixed values: prefixes of outcome columns


def _digests(path: str) -> tuple[str, str, str, int]:
    """SHA-256 as stored, with LF line ends and with CRLF line ends, in one streaming pass."""
    from pyarrow import fs
    filesystem, name = fs.FileSystem.from_uri(path)
    raw, lf, crlf, size, held = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), 0, b""
    with filesystem.open_input_stream(name) as stream:
        while block := stream.read(BLOCK):
            raw.update(block)
            size += len(block)
            text = (held + block)
            held = b"\r" if text.endswith(b"\r") else b""
            text = (text[:-1] if held else text).replace(b"\r\n", b"\n")
            lf.update(text)
            crlf.update(text.replace(b"\n", b"\r\n"))
    lf.update(held)
    crlf.update(held)
    return raw.hexdigest(), lf.hexdigest(), crlf.hexdigest(), size


def seal(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, size, sha256, sha256_lf, sha256_crlf) of every file; files are hashed as streams by the tasks.

    ``name`` is the path below ``folder``, so equal file names in different folders stay apart.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    place = F.lit("/" + re.sub(r"^[a-z0-9]+:/*", "", folder).strip("/") + "/")  # the scheme may be written differently
    below = F.substring(F.col("path"), F.position(place, F.col("path")) + F.length(place), F.length("path"))
    paths = files.select("path").withColumn("name", F.when(F.position(place, F.col("path")) > 0, below).otherwise(F.col("path"))).repartition("path")

    def digest(batches):
        for pdf in batches:
            rows = [(p, n, *_digests(p)) for p, n in zip(pdf["path"], pdf["name"])]
            yield pd.DataFrame(rows, columns=["path", "name", "sha256", "sha256_lf", "sha256_crlf", "size"])
    return paths.mapInPandas(digest, "path string, name string, sha256 string, sha256_lf string, sha256_crlf string, size long")


def verify_seal(sealed: DataFrame, current: DataFrame, tolerant: bool = False) -> DataFrame:
    """match / match_line_ends / changed / missing / unexpected per path below the sealed folder."""
    a = sealed.select("name", F.col("sha256").alias("want"))
    j = a.join(current.select("name", "sha256", "sha256_lf", "sha256_crlf"), "name", "full_outer")
    rebuilt = (F.col("want") == F.col("sha256_lf")) | (F.col("want") == F.col("sha256_crlf"))
    state = F.when(F.col("want").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("want") == F.col("sha256"), "match")
    if tolerant:
        state = state.when(rebuilt, "match_line_ends")
    return j.select("name", state.otherwise("changed").alias("state"))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-independent SHA-256 of a table: row digests, combined per digest prefix, then once more.

    Up to 16^6 prefix groups are hashed in parallel, then at most 4096 digests per group of three
    hex digits, then at most 4096 in total, so no task sees more than a sliver of the table.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    h = df.select(row.alias("h"))
    fold = lambda d, keys: d.groupBy(*keys).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"), F.sum("n").alias("n"))
    counted = h.groupBy("h").agg(F.count(F.lit(1)).alias("n"))  # equal rows collapse first, so copies cannot pile up
    d = counted.select(F.sha2(F.concat_ws(":", "h", "n"), 256).alias("h"), "n").withColumns({"p": F.substring("h", 1, 3), "q": F.substring("h", 4, 3)})
    return fold(fold(fold(d, ["p", "q"]), ["p"]), []).select(F.col("h").alias("digest"), F.col("n").alias("n_rows"))


def seal_choices(choices: DataFrame) -> DataFrame:
    """Digest of a choice table that carries no outcome column."""
    leaking = [c for c in choices.columns if c.lower().startswith(LEAKING)]
    if leaking:
        raise ValueError(f"choice table holds outcome columns {leaking}")
    return table_digest(choices)


def evaluate_sealed(choices: DataFrame, digest: str, measured: DataFrame, key: str) -> DataFrame:
    """Attach outcomes only if the choice table still has its sealed digest."""
    from graticule.operators.contracts import join_validated
    now = table_digest(choices).first()["digest"]
    if now != digest:
        raise ValueError("sealed choice table was changed")
    clash = (set(choices.columns) & set(measured.columns)) - {key}
    if clash:
        raise ValueError(f"choice table already holds {sorted(clash)}")
    return join_validated(choices, measured, [key], "m:1")


def write_lock(predictions: DataFrame, path: str, config: dict, features: Sequence[str]) -> str:
    """Persist predictions with the hash of their configuration; an existing lock is never replaced."""
    import json
    payload = json.dumps({"config": config, "features": list(features)}, sort_keys=True, separators=(",", ":"))
    digest = hashlib.sha256(payload.encode("utf-8")).hexdigest()
    predictions.withColumn("config_sha256", F.lit(digest)).write.mode("errorifexists").parquet(path)
    return digest


def read_lock(spark: SparkSession, path: str, digest: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not df.where(F.col("config_sha256") != digest).limit(1).isEmpty():
        raise ValueError("lock was written for another configuration")
    return df.drop("config_sha256")


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXACT, VALUE_DIFF or SHAPE_DIFF (other columns, types or row counts) with the number of rows found on one side only."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        n = a.agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.lit("SHAPE_DIFF").alias("state"), F.lit(None).cast("long").alias("only_a"), F.lit(None).cast("long").alias("only_b"))
    cols = sorted(a.columns)
    tagged = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    per = tagged.groupBy(*cols).agg(F.sum("_s").alias("d"), F.sum(F.abs("_s")).alias("n"))  # multiset difference in one shuffle
    s = per.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_b"))
    state = F.when(F.col("only_a") != F.col("only_b"), "SHAPE_DIFF").when(F.col("only_a") > 0, "VALUE_DIFF").otherwise("EXACT")
    return s.select(state.alias("state"), "only_a", "only_b")


def acceptance_delta(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows on one side only, and per value column the largest absolute change and how often NULL came or went."""
    a = old.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    j = a.join(b, list(keys), "full_outer")
    both = F.col("_a") & F.col("_b")
    per = [F.struct(F.lit(v).alias("column_name"), F.max(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))).alias("max_delta"),
                    F.count_if(both & (F.col(f"a_{v}").isNull() != F.col(f"b_{v}").isNull())).alias("n_null_changed")) for v in values]
    agg = j.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"), F.array(*per).alias("e"))
    return agg.select("n_unmatched", F.explode("e").alias("e")).select("e.column_name", "e.max_delta", "e.n_null_changed", "n_unmatched")

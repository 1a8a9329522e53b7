"""Cleaning and packing a corpus: the stages of the pipeline over ``documents``.

Each stage gets what its predecessor kept, as (spark, docs, sf_dir), and all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet and read again.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graticule.llm import count_tree, language, mixture, retrieval_packing, site_lines
from graticule.plans.lineage import ensure_checkpoint_dir

WORDS, SIMILAR = 5, (80, 100)  # shingles and similarity of near duplicates


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell; rejected ones go."""
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    known = language.identified(docs.select(rest, "text"), language.learned(docs)).where(~F.col("rejected"))
    return known.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many pages of their source share; a source is a site."""
    out = site_lines.without_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group; of rows that repeat, one."""
    return count_tree.one_of_each(docs, WORDS, *SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeat or go."""
    return mixture.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document."""
    return retrieval_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("lines", without_boilerplate), ("near_duplicates", one_of_each), ("mixture", mix_sources), ("packing", pack)]
ORACLE_SQL = None  # compression and tokenization are beyond SQL; tests/llm replays every stage


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Written as Parquet into the shared checkpoint folder and read again: the lineage ends here."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4()}"
    docs.write.parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(spark, docs), sf_dir)
    return docs

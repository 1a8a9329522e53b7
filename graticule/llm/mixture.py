"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies.  The expected copies are prefix-summed
within the source, one random offset is added, and a document is emitted once for every whole number that
its stretch of the sum crosses.  Documents are laid out by size, back and forth from one sampling interval
to the next, so the words that an interval gives hardly depend on the offset and the sum of taken words
stays near its target.

Defined cases: null text has size 0; a null source is a source of its own and comes last; a source without
words has target 0 and takes nothing; an empty table gives an empty mix; rows that repeat a doc_id are
separate documents; other columns pass through untouched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.functions.hashing import uniform
from graticule.llm.ordering import ranked, same
from graticule.plans.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # times its size that a source or a document may be taken
CYCLE = 3  # weights 1, 2, 3, 1, 2, ...


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: the cyclic weights share all words, no target beyond MOST times its source.

    Reaching a common level per weight: sorted by limit / weight, the level that follows when all earlier
    sources are full rises as long as sources fill up and falls after that, so its maximum is the level.
    The windows run over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", ((F.row_number().over(by_name) - 1) % CYCLE + 1).cast("long")).withColumn("_limit", F.col("source_size") * MOST)
    fills = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, rest = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0))).cast("double") / F.sum("weight").over(rest).cast("double")
    s = s.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return s.select("source", "source_size", F.least(F.col("weight") * F.col("_level"), F.col("_limit").cast("double")).alias("target"))


def copies(index: Column, expected: Column, offset: Column) -> Column:
    """Whole numbers crossed by document ``index`` (from 0) of a source laid out in alternating directions."""
    whole = F.floor(expected)
    part = expected - whole
    interval = F.floor(index * part)
    first, last = F.ceil(interval / part), F.ceil((interval + 1) / part) - 1
    at = F.when(interval % 2 == 1, first + last - index).otherwise(index)
    crossed = F.floor(offset + (at + 1) * part) - F.floor(offset + at * part)
    return (whole + F.when(part > 0, crossed).otherwise(F.lit(0))).cast("long")


def mixture_plan(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per document."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sized).withColumnRenamed("source", "_source")
    laid = ranked(sized, ["source"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last()], "_index")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform(seed, F.coalesce(F.col("source"), F.lit("")))
    return laid.join(targets, same(F.col("source"), F.col("_source"))) \
        .select("doc_id", "source", "size", "source_size", "target", copies(F.col("_index"), expected, offset).alias("copies"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document of ``docs``, all its columns, as many times as it is taken."""
    plan = mixture_plan(docs, seed).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies")) \
        .select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), word_count(F.col("text")).alias("z"))
    # rows of one doc_id share what the plan takes of them
    of_key = Window.partitionBy("d", "s", "z")
    rows = rows.withColumn("k", F.row_number().over(of_key.orderBy(F.lit(0)))).withColumn("n", F.count(F.lit(1)).over(of_key))
    rows = rows.join(plan, same(F.col("d"), F.col("_d")) & same(F.col("s"), F.col("_s")) & (F.col("z") == F.col("_z")))
    until = lambda k: F.floor(F.col("_copies") * k / F.col("n"))
    times = (until(F.col("k")) - until(F.col("k") - 1)).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")

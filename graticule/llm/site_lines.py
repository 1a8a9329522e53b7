"""Line dedup by site-relative frequency.

For each site, the share of its pages that hold a line; lines above the boilerplate ratio are dropped from
every page of the site.  A line is what stands between newlines, compared without white space at its ends.

Defined cases: blank lines are neither counted nor dropped; a line that repeats within a page counts once for
it and is dropped at every place; lines on fewer than ``min_pages`` pages stay, whatever their share; a page
that would lose all its lines is a copy rather than content between boilerplate and keeps them (near
duplicates are another operator's task); null text stays null; a null site is a site of its own; rows that
repeat a page key are pages of their own for the counts; input columns n_lines and n_dropped are replaced, all
others pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions.arrays import let
from graticule.llm.ordering import same

RATIO = 0.1
MIN_PAGES = 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def full(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) != ""


def line_key(line: Column) -> Column:
    """Identity of a line: 64 + 32 bits of two hash families, null if blank."""
    return let(F.trim(line, F.lit(" \t\r")), lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"))))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """_site, _line, n_pages, site_pages of the lines above the ratio.

    Counting is a groupBy with map-side sums, so a line on a third of all pages arrives as one row per task.
    """
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: k.isNotNull()))
    lines = pages.select(F.col(site).alias("_site"), F.explode(keys).alias("_line")).groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("n_pages"))
    total = pages.where(F.col(text).isNotNull()).groupBy(F.col(site).alias("_of")).agg(F.count(F.lit(1)).alias("site_pages"))
    return lines.where(F.col("n_pages") >= min_pages).join(total, same(F.col("_site"), F.col("_of"))) \
        .where(F.col("n_pages") > F.lit(ratio) * F.col("site_pages")).select("_site", "_line", "n_pages", "site_pages")


def without_boilerplate(pages: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages, their ``text`` without boilerplate, plus n_lines and n_dropped.

    A site has fewer than (mean lines per page / ratio) lines above the ratio, so one array per site holds
    them.  The arrays are dealt to (site, salt) with one row per salt, and pages of a busy site spread over
    the salts, so neither the join nor its largest key grows with the site.
    """
    salts = 64
    bad = boilerplate(pages, site, text, ratio, min_pages).groupBy("_site").agg(F.collect_list("_line").alias("_bad"))
    bad = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    x = F.col("text")
    rows = pages.select(F.struct(*[c for c in pages.columns if c not in ("n_lines", "n_dropped")]).alias("row"), F.col(site).alias("site"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(salts)).cast("int").alias("spread"))
    joined = rows.join(bad, same(F.col("site"), F.col("_site")) & (F.col("spread") == F.col("_salt")), "left")
    some = F.col("_bad").isNotNull() & x.isNotNull()
    hit = lambda line, b: F.coalesce(F.array_contains(b, line_key(line)), F.lit(False))
    marked = let(F.struct(x.alias("t"), F.col("_bad").alias("b")), lambda s: F.transform(lines_of(s["t"]), lambda line: F.struct(line.alias("x"), hit(line, s["b"]).alias("hit"), full(line).alias("full"))))
    out = joined.withColumn("lines", F.when(some, marked)).withColumn("cut", F.coalesce(F.exists("lines", lambda v: v["full"] & ~v["hit"]), F.lit(False)))
    kept = F.array_join(F.transform(F.filter("lines", lambda v: ~v["hit"]), lambda v: v["x"]), "\n")
    n_lines = F.when(some, F.size(F.filter("lines", lambda v: v["full"]))).otherwise(F.size(F.filter(lines_of(F.coalesce(x, F.lit(""))), full)))
    n_dropped = F.when(F.col("cut"), F.size(F.filter("lines", lambda v: v["hit"]))).otherwise(0)
    out = out.select("row", F.when(F.col("cut"), kept).otherwise(x).alias("kept"), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
    return out.withColumn("row", F.col("row").withField(text, F.col("kept"))).select("row.*", "n_lines", "n_dropped")

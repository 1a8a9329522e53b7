"""Approximate nearest neighbours with a permutation index.

Pivots are vectors of the data.  A vector is represented by its nearest pivots in order; it is posted in the
inverted file of each of its first POSTED pivots.  A query visits the files of its own first pivots.  In
each file it ranks the posted vectors by the footrule distance between the two orders, the sum over pivots of
the difference of their places, and the best are ranked again by Euclidean distance on the original vectors.  A vector that meets the query in several files is ranked in the first of them only.
How far the best reach is one footrule per query, for all its files: that within which a RERANKED share of a sample of the vectors lies.
All vectors within it are ranked, however many copies there are.

Files are dealt to blocks of BLOCK postings, because copies of one vector or a dense region may put a third
of all rows into one file.  Queries that meet fewer vectors than asked for get the exact answer from all
vectors, block by block.

Defined cases: a null vector, one of length 0, one with a null or non-finite component, or all zero, takes no
part, and neither does one whose number of components is not the most frequent one (the smaller of equals);
a null id takes no part; equal distances go to the smaller id; rows that repeat an id are candidates of
their own; other columns are ignored; with fewer candidates than asked for, all are returned.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.plans.lineage import cut

PIVOTS = 128  # fitted on so many vectors; up to 256, as places are kept in a byte
POSTED = 12  # files that hold a vector, and that a query visits
BLOCK = 8192  # postings ranked in one task
QUERIES = 1024  # queries meeting a block in one task
RERANKED = 0.045  # share of all vectors, by footrule, that is ranked by distance, or as many as make LEAST
LEAST = 1024
SAMPLE = 4096  # distinct vectors that tell a query's reach


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the vectors that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.agg(F.min_by("d", F.struct((-F.col("n")).alias("n"), "d")).alias("d")).first()["d"]
    return rows.where(F.size("v") == (common or 0))


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """Distinct vectors, those with the smallest content hash: a bounded sample that copies do not crowd."""
    found = rows.groupBy("v").agg(F.lit(1)).select("v").orderBy(F.xxhash64("v")).limit(count).collect()
    return np.array([r["v"] for r in found], np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def ordered(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``files``, the first pivots in order, and ``places``, one byte per pivot: where it stands in the order."""
    posted = min(POSTED, len(pivots))
    norms = (pivots ** 2).sum(axis=1)
    kind = rows.schema["v"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.argsort(norms - 2 * (_matrix(b.column(1)) @ pivots.T), axis=1, kind="stable")
                places = np.empty(order.shape, np.uint8)
                np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(order[:, :posted].astype(np.int16)), pa.list_(pa.int16())), pa.array([x.tobytes() for x in places], pa.binary())], names=["id", "v", "files", "places"])

    return rows.select("id", "v").mapInArrow(scan, f"id long, v {kind}, files array<short>, places binary")


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _places(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1).astype(np.int16)


def footrule(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.abs(rows - query).sum(axis=1, dtype=np.int32)


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def nearest(query_id: int, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    others = ids != query_id
    ids, d = ids[others], distances(query, rows[others])
    return [(query_id, int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k]]


FOUND = "query_id long, vec_id long, score double"


def _frame(found: list[tuple[int, int, float]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def blocks_of(rows: DataFrame, file: str, size: int) -> DataFrame:
    """file, blocks: how many blocks of about ``size`` rows the rows of a file are dealt to; a row per pivot at most."""
    return rows.groupBy(file).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))


def reaching(asked: DataFrame, sample: np.ndarray, share: float) -> DataFrame:
    """Adds ``reach``: the footrule within which ``share`` of the sampled orders lie."""
    at = min(len(sample) - 1, int(np.ceil(share * len(sample))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(reach=[int(np.partition(footrule(mine, sample), at)[at]) for mine in _places(pdf["places"])] if len(pdf) else [])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInPandas(scan, f"{fields}, reach long")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _meet(queries: DataFrame, rows: DataFrame, ranked) -> DataFrame:
    """Queries (file, id, v, places) against rows (file, id, v, places): every block of queries meets every block of rows of its file."""
    q_blocks, r_blocks = blocks_of(queries, "file", QUERIES).withColumnRenamed("blocks", "qs"), blocks_of(rows, "file", BLOCK).withColumnRenamed("blocks", "rs")
    deal = q_blocks.join(r_blocks, "file")
    q = queries.join(deal, "file").withColumn("qb", _block(F.col("id"), F.col("qs"))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
    r = rows.join(deal, "file").withColumn("rb", _block(F.struct("id", "v"), F.col("rs"))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    cols = ["file", "qb", "rb", "id", "v", "places"]
    q = q.select(*[F.col(c).alias(c) for c in [*cols, *({"reach"} & set(q.columns))]])  # both sides come from one table: columns of their own
    return q.groupBy("file", "qb", "rb").cogroup(r.select(*cols).groupBy("file", "qb", "rb")).applyInPandas(ranked, FOUND)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, work: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest of all other rows that were found.

    ``work`` counts the vectors ranked by distance.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    sample = pivots_of(rows, SAMPLE)
    pivots = sample[:PIVOTS]
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted = min(POSTED, len(pivots))
    placed = cut(ordered(rows, pivots))
    near = np.argsort((pivots ** 2).sum(axis=1) - 2 * (sample @ pivots.T), axis=1, kind="stable")
    orders = np.empty(near.shape, np.int16)
    np.put_along_axis(orders, near, np.arange(near.shape[1], dtype=np.int16)[None, :], axis=1)
    asked = placed.where(is_query)
    within = reaching(asked, orders, max(RERANKED, max(LEAST, 3 * k) / max(placed.count(), 1)))
    filed = lambda df: df.select(F.explode("files").alias("file"), *[c for c in df.columns if c != "files"])

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _frame([])
        file = left["file"].iloc[0]
        ids, have, places = right["id"].to_numpy(), _vectors(right["v"]), _places(right["places"])
        found = []
        for query_id, v, mine, reach in zip(left["id"], _vectors(left["v"]), _places(left["places"]), left["reach"]):
            # what a file visited earlier holds is ranked there
            earlier = np.flatnonzero(mine < mine[file])
            new = np.flatnonzero(~(places[:, earlier] < posted).any(axis=1))
            best = new[footrule(mine, places[new]) <= reach]
            if work is not None:
                work.add(len(best))
            found += nearest(query_id, v, ids[best], have[best], k)
        return _frame(found)

    first = _meet(filed(within), filed(placed), ranked)
    top = cut(_top(first, k))

    def exact(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _frame([])
        ids, have = right["id"].to_numpy(), _vectors(right["v"])
        return _frame([x for query_id, v in zip(left["id"], _vectors(left["v"])) for x in nearest(query_id, v, ids, have, k)])

    full = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = cut(asked.join(full, "id", "left_anti"))
    if short.isEmpty():
        return top
    whole = lambda df: df.select(F.lit(-1).cast("short").alias("file"), "id", "v", "places")
    return top.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_top(_meet(whole(short), whole(placed), exact), k))


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

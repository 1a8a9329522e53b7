"""Order MinHash fingerprints: sensitive to which k-mers a text has, how often, and in which order.

Tokens are words, cut into pieces of PIECE characters so texts without white space have tokens too; a k-mer is
K neighbouring tokens.  Equal k-mers are numbered by occurrence, and (k-mer, number) is hashed.  A sketch takes
the TUPLE k-mers that are smallest under its own order of hashes, puts them back into text order and hashes
that tuple.  The orders of the SKETCHES sketches are rotations of one ring of hashes: the smallest under sketch
j are the first on the ring from j's mark on, so one sort of the hashes serves all sketches and texts of any
length, short ones too, fill every sketch.

Everything is array functions on one row; no text leaves its row, and the only shuffle lays texts out by id.

Defined cases: null text counts as empty; a text without tokens has the fingerprint of zeros; fewer than K
tokens form one k-mer; rows that repeat an id follow each other by content; null ids come last; the only
document is its own successor; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.functions.arrays import let

PIECE = 8
K = 2
TUPLE = 2
SKETCH_BITS = 5
SKETCHES = 1 << SKETCH_BITS
TOKEN = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"
PLACE_BITS = 23
PLACE = (1 << PLACE_BITS) - 1
NULL_BUCKETS = 64


def _packed(h: Column, place: Column) -> Column:
    """A long that sorts by hash and still knows the place in the text."""
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(PLACE)))


def kmers(text: Column) -> Column:
    """Hashes of the k-mers in text order."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def joined(h: Column) -> Column:
        n = F.greatest(F.size(h) - (K - 1), F.lit(0))
        out = F.slice(h, 1, n)
        for j in range(1, K):
            out = F.zip_with(out, F.slice(h, j + 1, n), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(h) >= K, out).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), ",")))).otherwise(h)

    return let(tokens, joined)


def numbered(q: Column) -> Column:
    """Packed hashes of (k-mer, occurrence number); ``q`` is bound once per row."""
    number = lambda h, o: F.xxhash64(h.bitwiseAND(F.lit(~PLACE)), o.cast("int"))

    def runs(s: Column) -> Column:
        """From packed k-mers in order: those of one k-mer stand together, in text order."""
        key = lambda j: F.get(s, j).bitwiseAND(F.lit(~PLACE))
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (key(j) != key(j - 1)))
        run = lambda a, b: F.transform(F.slice(s, a + 1, b - a), lambda x, o: _packed(number(x, o), x.bitwiseAND(F.lit(PLACE))))
        return let(starts, lambda st: F.flatten(F.zip_with(st, F.concat(F.slice(st, 2, F.size(st)), F.array(F.size(s))), run)))

    once = F.transform(q, lambda h, i: _packed(number(h, F.lit(0)), i))
    return F.when(F.size(F.array_distinct(q)) == F.size(q), once).otherwise(let(F.sort_array(F.transform(q, _packed)), runs))


def _sketches(ring: Column) -> Column:
    """One hash per sketch from the packed hashes in order."""
    half = SKETCHES // 2
    marks = lambda arcs: F.transform(F.sequence(F.lit(-half), F.lit(half - 1)), lambda j: F.array_position(arcs, j.cast("long")).cast("int"))
    at = let(F.transform(ring, lambda x: F.shiftright(x, 64 - SKETCH_BITS)), marks)
    # an empty arc takes the next arc's first hash, the last arcs go round to the start
    onward = lambda p: F.reverse(F.aggregate(F.reverse(p), F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.when(x > 0, x).otherwise(F.coalesce(F.get(done, F.size(done) - 1), F.lit(1)))))))
    at = let(at, lambda p: F.when(F.array_contains(p, 0), onward(p)).otherwise(p))
    round_ = F.concat(ring, F.slice(ring, 1, TUPLE - 1))
    by_place = lambda x: F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 64 - PLACE_BITS - 1).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS + 1))
    folded = lambda t: F.aggregate(F.sort_array(F.transform(t, by_place)), F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x.bitwiseAND(F.lit((1 << (64 - PLACE_BITS - 1)) - 1))))
    return let(round_, lambda r: F.transform(at, lambda p: folded(F.slice(r, p, F.least(F.lit(TUPLE), F.size(ring))))))


def signature(text: Column) -> Column:
    """array<long> of SKETCHES hashes of 32 bits."""
    ring = let(kmers(F.coalesce(text, F.lit(""))), lambda q: F.sort_array(numbered(q)))
    full = let(ring, lambda r: F.when(F.size(r) > 0, F.transform(_sketches(r), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array_repeat(F.lit(0).cast("long"), SKETCHES)))
    return full


def fingerprint(sketches: Column) -> Column:
    return F.array_join(F.transform(sketches, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, v: t + v) / F.lit(float(SKETCHES))


def successors(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """doc_id and ``carried`` of ``docs`` (doc_id, text, h) plus next_<name>: those of the document that follows in
    descending doc_id, by ``h`` among equal ids; the first follows the last.

    Ids are cut into buckets of about equal counts, a few per partition.  The first document of each bucket is
    repeated at the end of the bucket before, so successors never cross a bucket.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / (4 * partitions) for k in range(1, 4 * partitions)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 10 * len(cuts)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    of_id = F.size(F.filter(edges, lambda b: b >= F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNotNull(), of_id).otherwise(len(bounds) + 1 + F.shiftright("h", 58).cast("int") + NULL_BUCKETS // 2)
    rows = docs.withColumn("bucket", bucket)
    place = F.struct((-F.col("doc_id")).alias("i"), "h")
    first = rows.groupBy("bucket").agg(F.min(place).alias("at"))  # a row per bucket
    order = Window.orderBy("bucket")
    first = first.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = first.select(F.col("bucket").alias("_bucket"), "at", "before")
    ghosts = rows.join(F.broadcast(first), (F.col("bucket") == F.col("_bucket")) & place.eqNullSafe(F.col("at"))).dropDuplicates(["_bucket"])
    told = lambda df, bucket, ghost: df.select(F.col(bucket).alias("bucket"), F.lit(ghost).alias("ghost"), "doc_id", "h", *[c.alias(n) for n, c in carried.items()])
    both = told(rows, "bucket", False).unionByName(told(ghosts, "before", True))
    along = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h")
    led = both.withColumn("following", F.lead(F.struct(*carried)).over(along)).where(~F.col("ghost"))
    return led.select("doc_id", *carried, *[F.col(f"following.{c}").alias(f"next_{c}") for c in carried])


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit: the last third replaced by the beginning of the next document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h"))
    led = successors(rows, {"text": F.col("text"), "sketches": signature(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    led = led.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    led = led.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketches", "next_sketches", signature(F.col("edited")).alias("edited_sketches"))
    return led.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketches")).alias("fingerprint"), fingerprint(F.col("edited_sketches")).alias("edited_fingerprint"),
                      likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"), likeness(F.col("sketches"), F.col("next_sketches")).alias("near_next"))

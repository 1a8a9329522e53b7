r"""Near duplicates by SimHash, found through Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit b is set if more than half of its word shingles (repeats included)
have bit b in their XXH64 with seed 42.  Two fingerprints link at ``BITS`` = 4 or fewer differing bits.

The binary Golay code (23, 12, 7) is perfect: every word of 23 bits lies within distance 3 of exactly one
codeword.  near(x) is that codeword, and for words at distance 3 also the five codewords at distance 4, so a
word has 1 or 6 near codewords, each named by its 12 data bits.  If x and y differ in at most one bit, the
nearest codeword of y is among near(x): y is within 4 of it or closer, and a word nearer than 3 to its codeword
cannot leave the ball by one bit.

A fingerprint is cut into three segments of 22, 21 and 21 bits.  Of at most four errors the two best segments
hold at most two, so either one segment is equal, or two segments have exactly one error each.  Keys:

* each segment as it is (3 keys), for the first case;
* for each two segments i, j: (near(i), nearest(j)) and (nearest(i), near(j)), for the second: the first kind of x
  and the second kind of y agree on both parts.

That is about 35 keys of 21 or 24 bits per distinct fingerprint; a plain cut into five exact blocks has keys of 13
bits.  No linked pair is missed, and every candidate is verified on all 64 bits.

Equal fingerprints are one node from the start, so exact copies never meet in a group.  A group of one key is
searched breadth first: a fingerprint is compared with those not reached yet, in one vector operation, and only
the edges of a spanning forest leave the task, so a group of near copies costs one pass and n - 1 edges.  Groups of
more than ``CROWD`` rows are dealt again by their key and four equal bytes of eight (four errors touch at most
four bytes): 70 groups per fingerprint, in tasks of their own.  Components of the forest are those of all links.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graticule.llm.batches import pieces
from graticule.operators.graph import connected_components
from graticule.plans.lineage import cut

BITS = 4
CROWD = 1 << 16  # rows of a key beyond which the group is dealt again
COPIES = 10_000  # documents with one fingerprint beyond which its component is broadcast instead of shuffled
HOT_ROWS = 100_000  # at most so many fingerprints are broadcast
SHINGLE = 4
SEED = 42
CHUNK = 1 << 16  # shingles hashed at once
GENERATOR = 0xAE3  # generator polynomial of the Golay code, degree 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, number of bits)
WINDOW = 16  # groups up to this size are compared by shifting the whole batch


def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator polynomial, for words of 23 bits."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1 == 1, GENERATOR << (bit - 11), 0).astype(x.dtype)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 and lower 11 bits are additive, so one table of 2**12 serves; and per remainder the
    error patterns that lead to near codewords (-1 fills up)."""
    high = _remainder(np.arange(1 << 12, dtype=np.int64) << 11)
    patterns = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for error, rest in zip(errors.tolist(), _remainder(errors).tolist()):
            # weight 4 only where the nearest codeword is at distance 3
            if weight < 4 or bin(patterns[rest, 0]).count("1") == 3:
                patterns[rest, used[rest]] = error
                used[rest] += 1
    return high, patterns


HIGH, PATTERNS = _tables()


def near_codewords(x: np.ndarray) -> np.ndarray:
    """(n, 6) data bits of the codewords near each word of 23 bits, the nearest first; -1 fills up."""
    x = x.astype(np.int64)
    error = PATTERNS[HIGH[x >> 11] ^ (x & 0x7FF)]
    return np.where(error < 0, -1, (x[:, None] ^ np.maximum(error, 0)) >> 11)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position, key) of fingerprints; the kind of key stands above bit 24."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    rows, keys = [], []
    everyone = np.arange(len(prints))
    for k, p in enumerate(parts):
        rows.append(everyone)
        keys.append(p | (k << 24))
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        one = np.where(near[i] < 0, -1, (near[i] << 12) | near[j][:, :1])
        other = np.where(near[j][:, 1:] < 0, -1, (near[i][:, :1] << 12) | near[j][:, 1:])  # the nearest of both is in ``one``
        both = np.concatenate([one, other], axis=1)
        at, column = np.nonzero(both >= 0)
        rows.append(at)
        keys.append(both[at, column] | ((k + 3) << 24))
    return np.concatenate(rows), np.concatenate(keys)


BYTES = np.array([sum(0xFF << (8 * b) for b in c) for c in combinations(range(8), 4)], np.uint64)


def refined(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """(n, 70) keys of 64 bits from the old key, four of the eight bytes, and which four."""
    mixed = (prints[:, None] & BYTES[None, :]) * np.uint64(0x9E3779B97F4A7C15) + (keys.astype(np.uint64)[:, None] * np.uint64(128) + np.arange(len(BYTES), dtype=np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)  # clashes only add candidates


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of the k-word shingles; 0 without words, the whole sequence as one shingle with fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    size = min(k, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends[size - 1:] - 1).tolist()
    line = b" ".join(words)
    counts, n = np.zeros(64, np.int64), len(ends)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at: at + CHUNK], ends[at: at + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, print): one row per row of ``docs``, the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "print"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, print long")


def posted(prints: DataFrame) -> DataFrame:
    """(key, print) of every key of distinct fingerprints."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            p = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = keys_of(p.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p[rows])], ["key", "print"])

    return prints.select("print").mapInArrow(run, "key long, print long")


def forest(prints: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges, left = [], prints
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                found = left[hit]
                edges += [(x, y) for y in found]
                queue += list(found)
                left = left[~hit]
    return edges


def _linked(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """(n, 2) links among rows sorted by key: a spanning forest in large groups, all in small ones."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    out = []
    for a, n in zip(starts[sizes > WINDOW].tolist(), sizes[sizes > WINDOW].tolist()):
        out += forest(prints[a: a + n])
    small = np.repeat(sizes <= WINDOW, sizes)
    k, p = keys[small], prints[small]
    pairs = [np.array(out, np.uint64).reshape(-1, 2)]
    for d in range(1, min(WINDOW, len(k))):
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(p[d:] ^ p[:-d]) <= BITS)
        if hit.any():
            pairs.append(np.stack([p[:-d][hit], p[d:][hit]], axis=1))
    return np.concatenate(pairs)


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that arrive sorted by key; a group cut by a batch is kept until its end."""

    def emitted(keys, prints):
        pairs = np.unique(np.sort(_linked(keys, prints), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64).copy()), pa.array(pairs[:, 1].view(np.int64).copy())], ["a", "b"])

    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield emitted(keys[:done], prints[:done])
            keys, prints = keys[done:], prints[done:]
    if len(keys):
        yield emitted(keys, prints)


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        keys, prints = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        made = refined(keys, prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), pa.array(np.repeat(prints, made.shape[1]))], ["key", "print"])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within ``BITS`` bits."""
    posts = posted(prints)
    counted = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key")
    crowded = cut(counted)
    if not crowded.isEmpty():
        # at most (35 / crowd) rows per fingerprint, joined by key like any table
        calm, full = posts.join(crowded, "key", "left_anti"), posts.join(crowded, "key", "left_semi")
        posts = calm.unionByName(full.select("key", "print").mapInArrow(_dealt, "key long, print long"))
    return posts.select("key", "print").repartition("key").sortWithinPartitions("key").mapInArrow(_search, "a long, b long").distinct()


def components(docs: DataFrame, text: str = "text", crowd: int = CROWD, copies: int = COPIES) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links of fingerprints.

    One row per row of ``docs``.  Null and empty texts have the fingerprint zero and link like any other.  Null ids take
    part in links; a component id is the smallest id that is not null, and null if there is none.  Other columns are
    not read.
    """
    told = cut(fingerprints(docs, text))
    nodes = told.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes)
    reach = connected_components(cut(links(nodes, crowd))).select(F.col("node").alias("print"), "component")
    named = cut(nodes.join(reach, "print", "left").withColumn("component", F.coalesce("component", "print")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(smallest, "component").select("print", "component_id", "n"))
    # fingerprints of many copies are few: they are copied to all tasks instead of gathering their documents in one
    hot = named.where(F.col("n") > copies).orderBy(F.desc("n")).limit(HOT_ROWS).select("print", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = told.join(F.broadcast(hot), "print", "left")
    rest = named.join(F.broadcast(hot.select("print")), "print", "left_anti").select("print", "component_id")
    known = marked.where("hot").select("doc_id", "print", F.col("hot_id").alias("component_id"))
    shuffled = marked.where("hot IS NULL").select("doc_id", "print").join(rest, "print")
    return known.unionByName(shuffled.select("doc_id", "print", "component_id")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

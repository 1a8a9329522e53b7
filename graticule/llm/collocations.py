r"""Phrase collocations, counted exactly in burst tries.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]`` and into words at blanks and tabs.  Phrases of 1
to ``LONGEST`` words are counted per language.  Nearly all long phrases of a corpus occur once, so orders are counted one
after the other: a phrase of m words can only reach ``least`` if both phrases of m - 1 words in it do.  Those that do
are marked in a bit map of fixed size (``FILTER_BITS``) that every task gets; a clash in it lets a phrase be counted
that will not reach ``least``, and never loses one.

Words are named by 64-bit hashes.  Before they are used, all distinct words of the corpus are checked: if two that
share a hash could reach ``least`` together, the next seed is taken.

Counting one order is a HAT-trie per task (``BurstTrie``): a shallow trie over hashed word ids whose leaves are
containers of keys and their counts, and a container of more than ``BURST`` entries bursts.  When a task holds more than ``HELD`` entries it spills whole subtrees, largest first,
as sorted runs.  Runs are cut by prefix partition, (language, first word, top bits of the second word), so the subtree of a
frequent word is spread, shuffled as one row per run and partition, and merged there.

Scores compare a phrase with its parts: for a cut after k words l and r count the parts, the score is
floor(1000 a n / (l r)) in decimal arithmetic (exact while 1000 a n has at most 38 digits), and the lowest cut
counts, ties to the smallest k.  A phrase is dropped if a longer one that contains it occurs as often; it is enough to
look at longer by one word, as counts never grow with length.

Null texts are empty, a null language is ``und``.  Repeated rows count each; ids and other columns are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.llm.batches import pieces
from graticule.llm.tables import stored

LONGEST, LEAST, TOP = 5, 100, 2000
FILTER_BITS = 26  # 8 MB whatever the corpus
HELD = 600_000  # entries of a task's trie
BURST = 4_096  # entries of a container
PART_WORDS = 1 << 18  # words of the corpus per prefix partition
PIECE = 1_024  # documents counted at once
CACHE = 1 << 18  # word hashes kept by a worker
_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)  # '.' then stands for the end of a piece
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def split(text: str | None) -> list[bytes]:
    """Words in order, with ``.`` at the end of every piece."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_STOPS).replace(b".", b" . ").split()


def _seed(k: int) -> int:
    return xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)


def hashed(k: int, column: Column) -> Column:
    """The hash of strings under seed ``k``, as Spark writes it; ``_Hashes`` is the same in a task."""
    return F.xxhash64(F.lit(k).cast("long"), column)


class _Hashes(dict):
    def __init__(self, k: int):
        super().__init__()
        self.seed = _seed(k)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = 0 if word == b"." else xxhash.xxh64_intdigest(word, self.seed)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def phrase_hashes(languages: np.ndarray, words: np.ndarray, m: int) -> list[np.ndarray]:
    """Hash of the phrase of 1, 2, ... m words that starts at each place; ends are cut off."""
    out, h = [], languages
    for k in range(m):
        n = len(words) - k
        h = _mixed(h[:max(n, 0)] * _ODD[0] + words[k:] * _ODD[k + 1])
        out.append(h)
    return out


class BurstTrie:
    """Counts of keys (rows of word ids) under a shallow trie.

    A container holds the keys of a range of ids behind a common prefix: several first words while they are rare, one
    word's continuations once it is frequent.  New keys wait in a container until ``burst`` of them are merged at
    once; a container of more than ``burst`` keys bursts at the first id, and in it the first bit, that its keys differ in.
    Containers stand in key order, so a sorted batch is dealt by their lower bounds.
    """

    def __init__(self, width: int, burst: int = BURST):
        self.burst, self.width = burst, width
        self.low = [(0,) * width]
        self.leaves: list[list] = [self._leaf()]
        self.entries = 0

    def _leaf(self, keys=None, counts=None) -> list:
        """[merged keys, their counts, waiting, number waiting]"""
        return [np.empty((0, self.width), np.uint64) if keys is None else keys, np.empty(0, np.int64) if counts is None else counts, [], 0]

    def __len__(self) -> int:
        return self.entries

    def _place(self, keys: np.ndarray, low: tuple) -> int:
        """First row of sorted ``keys`` that is not below ``low``."""
        a, b = 0, len(keys)
        for d, v in enumerate(low):
            v = np.uint64(v)
            column = keys[a:b, d]
            a, b = a + int(np.searchsorted(column, v)), a + int(np.searchsorted(column, v, side="right"))
            if a == b:
                break
        return a

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct keys with their counts."""
        cuts = [self._place(keys, low) for low in self.low] + [len(keys)]
        for k in range(len(self.leaves) - 1, -1, -1):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            leaf = self.leaves[k]
            leaf[2].append((keys[a:b].copy(), counts[a:b].copy()))
            leaf[3] += b - a
            self.entries += b - a
            if leaf[3] > self.burst:
                self._merge(leaf)
                if len(leaf[0]) > self.burst:
                    self._burst(k)

    def _merge(self, leaf: list) -> None:
        if leaf[2]:
            before = len(leaf[0]) + leaf[3]
            leaf[:] = [*_sorted_sums(np.concatenate([leaf[0], *(k for k, _ in leaf[2])]), np.concatenate([leaf[1], *(c for _, c in leaf[2])])), [], 0]
            self.entries += len(leaf[0]) - before

    def _burst(self, k: int) -> None:
        made = []

        def cut(low, keys, counts):
            if len(keys) <= max(self.burst // 2, 1):
                made.append((low, self._leaf(keys, counts)))
                return
            d = int(np.flatnonzero(keys[0] != keys[-1])[0])
            first, last = int(keys[0, d]), int(keys[-1, d])
            bit = (first ^ last).bit_length() - 1
            at = (last >> bit) << bit
            p = int(np.searchsorted(keys[:, d], np.uint64(at)))
            cut(low, keys[:p], counts[:p])
            cut((*map(int, keys[0, :d]), at, *[0] * (self.width - d - 1)), keys[p:], counts[p:])

        cut(self.low[k], *self.leaves[k][:2])
        self.low[k: k + 1], self.leaves[k: k + 1] = [x for x, _ in made], [x for _, x in made]

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees (a language and the top bits of the first word), largest first, until ``keep`` entries are left."""
        sizes: Counter = Counter()
        for low, leaf in zip(self.low, self.leaves):
            sizes[low[0], low[1] >> 60] += len(leaf[0]) + leaf[3]
        gone, left = set(), self.entries
        for subtree, n in sizes.most_common():
            if left <= keep:
                break
            gone.add(subtree)
            left -= n
        out, low, leaves = [], [], []
        for bound, leaf in zip(self.low, self.leaves):
            if (bound[0], bound[1] >> 60) in gone:
                self._merge(leaf)
                out.append(leaf)
            else:
                low.append(bound)
                leaves.append(leaf)
        if not low or any(low[0]):
            low.insert(0, (0,) * self.width)
            leaves.insert(0, self._leaf())
        self.low, self.leaves = low, leaves
        self.entries = sum(len(leaf[0]) + leaf[3] for leaf in leaves)
        empty = self._leaf()
        return np.concatenate([empty[0], *(leaf[0] for leaf in out)]), np.concatenate([empty[1], *(leaf[1] for leaf in out)])


def _sorted_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``keys`` in order, each once, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[first], np.add.reduceat(counts, first)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows():
            for name, counts in held.items():
                counts.pop(b".", None)
                words = sorted(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["lang", "word", "n"])

        for batch in pieces(batches):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(name, Counter()).update(split(t.as_py()))
            if sum(map(len, held.values())) > HELD:
                yield from rows()
                held = {}
        yield from rows()

    narrow = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def usable_seed(words: DataFrame, least: int) -> int:
    """The first seed under which no two words, or languages, are taken for one another."""
    k = 0
    while True:
        clash = words.groupBy("lang", hashed(k, F.col("word")).alias("h")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).where((F.col("n") >= least) & ((F.col("m") > 1) | (F.col("h") == 0)))
        names = words.select("lang").distinct().groupBy(hashed(k, F.col("lang")).alias("h")).count().where("count > 1")
        if clash.isEmpty() and names.isEmpty():
            return k
        k += 1


def bit_map(frequent: DataFrame) -> np.ndarray:
    """Marks of the phrases of one order, from their ``mark``; of fixed size."""
    place = F.col("mark").bitwiseAND((1 << FILTER_BITS) - 1)
    words = frequent.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(mark & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _partition(keys: np.ndarray, parts: int) -> np.ndarray:
    """Prefix partition: language, first word and the top four bits of the second."""
    return (_mixed(keys[:, 0] * _ODD[0] + keys[:, 1] * _ODD[1] + (keys[:, 2] >> np.uint64(60)) * _ODD[2]) % np.uint64(parts)).astype(np.int32)


def runs(docs: DataFrame, m: int, seed: int, marks, parts: int, text: str = "text", lang: str = "lang", held: int = HELD, burst: int = BURST) -> DataFrame:
    """(part, keys, counts): sorted runs of phrases of ``m`` words whose shorter phrases are marked."""

    def counted(batch: pa.RecordBatch, hashes: _Hashes, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [split(t.as_py()) + [b"."] for t in batch.column(1)]
        lengths = [len(w) for w in words]
        h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(lengths))
        names = np.repeat(np.array([xxhash.xxh64_intdigest(x.encode(), hashes.seed) for x in batch.column(0).to_pylist()], np.uint64), lengths)
        ends = np.concatenate([[0], np.cumsum(h == 0)])
        n = len(h) - m + 1
        if n <= 0:
            return np.empty((0, m + 1), np.uint64), np.empty(0, np.int64)
        shorter = _marked(bits, phrase_hashes(names, h, m - 1)[-1])
        at = np.flatnonzero((ends[m:] == ends[:-m]) & shorter[:n] & shorter[1: n + 1])
        keys = np.stack([names[at], *(h[at + j] for j in range(m))], axis=1)
        return _sorted_sums(keys, np.ones(len(at), np.int64))

    def spilled(trie: BurstTrie, keep: int) -> Iterator[pa.RecordBatch]:
        keys, counts = trie.spill(keep)
        part = _partition(keys, parts)
        order = np.argsort(part, kind="stable")
        part, keys, counts = part[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []
        spans = list(zip(cuts, [*cuts[1:], len(part)]))
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array([np.ascontiguousarray(keys[a:b].T).tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], ["part", "keys", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hashes, bits = BurstTrie(m + 1, burst), _Hashes(seed), marks.value
        for batch in pieces(batches, PIECE):
            trie.add(*counted(batch, hashes, bits))
            if len(trie) > held:
                yield from spilled(trie, held // 2)
        yield from spilled(trie, 0)

    narrow = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "part int, keys binary, counts binary")


FREQUENT = "name long, words array<long>, f long, mark long"


def merged(spills: DataFrame, m: int, least: int, held: int = HELD) -> DataFrame:
    """(name, words, f, mark): phrases of ``m`` words that occur ``least`` times, from the runs of each prefix partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, size = None, [], 0

        def merge() -> None:
            nonlocal waiting, size
            waiting = [_sorted_sums(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))]
            size = len(waiting[0][0])

        def finished() -> pa.RecordBatch:
            merge()
            keys, counts = waiting[0]
            enough = counts >= least
            keys, counts = keys[enough], counts[enough]
            mark = keys[:, 0].copy()
            for k in range(m):
                mark = _mixed(mark * _ODD[0] + keys[:, k + 1] * _ODD[k + 1])
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * m), pa.array(np.ascontiguousarray(keys[:, 1:]).view(np.int64).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy().view(np.int64)), words, pa.array(counts), pa.array(mark.view(np.int64))], ["name", "words", "f", "mark"])

        limit = held
        for batch in batches:
            for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != now and waiting:
                    yield finished()
                    waiting, size, limit = [], 0, held
                now = part
                waiting.append((np.frombuffer(keys.as_py(), np.uint64).reshape(m + 1, -1).T, np.frombuffer(counts.as_py(), np.int64)))
                size += len(waiting[-1][1])
                if size > limit:  # several runs hold the same phrases
                    merge()
                    limit = max(held, 2 * size)
        if waiting:
            yield finished()

    return spills.repartition("part").sortWithinPartitions("part").mapInArrow(run, FREQUENT)


def frequent_phrases(docs: DataFrame, words: DataFrame, seed: int, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", held: int = HELD, burst: int = BURST) -> DataFrame:
    """(name, words, f) of all phrases that occur ``least`` times; name and words are hashes under ``seed``."""
    spark = docs.sparkSession
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(64, -(-total // PART_WORDS))

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, word = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            mark = _mixed(name.view(np.uint64) * _ODD[0] + word.view(np.uint64) * _ODD[1]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(word) + 1, dtype=np.int32)), batch.column(1)), batch.column(2), pa.array(mark)], ["name", "words", "f", "mark"])

    level = words.where(F.col("n") >= least).select(hashed(seed, F.col("lang")).alias("name"), hashed(seed, F.col("word")).alias("word"), F.col("n").alias("f"))
    level = stored(level.mapInArrow(marked, FREQUENT))
    out = level
    for m in range(2, longest + 1):
        marks = spark.sparkContext.broadcast(bit_map(level))
        level = stored(merged(runs(docs, m, seed, marks, parts, text, lang, held, burst), m, least, held))
        marks.destroy()
        out = out.unionByName(level)
    return out.select("name", "words", "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang", held: int = HELD, burst: int = BURST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more."""
    words = stored(word_counts(docs, text, lang))
    seed = usable_seed(words, least)
    phrases = frequent_phrases(docs, words, seed, least, longest, text, lang, held, burst)
    names = words.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("name", hashed(seed, F.col("lang")))
    candidates = phrases.where(F.size("words") >= 2)
    size = F.size("words")
    within = candidates.where(size > 2).select("name", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), F.col("f").alias("f_longer"))
    within = within.groupBy("name", "words").agg(F.max("f_longer").alias("f_longer"))
    alone = candidates.join(within, ["name", "words"], "left").where("f_longer IS NULL OR f_longer < f").select("name", "words", "f")
    cuts = alone.select("name", "words", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = cuts.join(phrases.select("name", F.col("words").alias("left"), F.col("f").alias("l")), ["name", "left"]).join(phrases.select("name", F.col("words").alias("right"), F.col("f").alias("r")), ["name", "right"])
    cuts = cuts.join(names, "name")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": (whole("f") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), "below": whole("l") * whole("r")})
    scored = cuts.withColumn("score", F.expr("CAST(above AS DECIMAL(38,0)) div CAST(below AS DECIMAL(38,0))")).groupBy("name", "words").agg(
        F.first("lang").alias("lang"), F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scored.select("name", "lang", "words", "a", "n", "best.score", "best.l", "best.r")
    order = [F.desc("score"), F.desc("a")]
    first = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    spelled = words.where(F.col("n") >= least).select(F.col("lang"), hashed(seed, F.col("word")).alias("h"), "word")
    parts = first.select("lang", "words", F.posexplode("words").alias("at", "h")).join(spelled, ["lang", "h"]).groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    named = first.join(parts, ["lang", "words"]).withColumn("phrase", F.array_join(F.col("spelled.word"), " "))
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))

r"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both tokenizers cut the same bytes.  Offsets where tokens of both end cut the text into groups; inside a group tokens
link where their byte ranges overlap, and every elementary range between two token ends, of whichever side, is one
link.  A link's pair of ids counts in as many documents as hold it.

Most groups hold one token of each side with the same bytes.  The identity map names, for each A id, the B id with the
same bytes, so such pairs are counted in a vector as long as A's vocabulary, one per task, and only the vectors are
added up.  Other pairs are counted per task in sorted arrays and shuffled by pair.  A pair (a, identity of a) that links
inside an irregular group, by an overlap, belongs to the same vector entry and counts once a document.

Texts are encoded once: ids, lengths and links of a batch are arrays, and what the second look needs (distinct pairs of
each document and how often) is written as a table into the checkpoint folder.  The second look adds the corpus'
counts: vectors are broadcast (bounded by the vocabulary), the irregular pairs up to ``BOUND`` of them; beyond that
the documents' pairs are joined with their counts, the most frequent pairs apart.  Both ways give the same rows.

Null and empty texts, and texts that a tokenizer does not reproduce byte by byte, have no tokens: zeros and an empty
string.  Rows that repeat, also under one id, are documents of their own; a null id stays null; other columns are not read.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graticule.llm.batches import pieces
from graticule.llm.tables import looked_up, stored

BOUND = 1 << 21  # irregular pairs that are broadcast (16 bytes each)
HELD = 1 << 20  # pairs a task holds before it hands them on
OFTEN = 10_000  # documents of a pair beyond which its count is copied instead of shuffled
TEXTS = 64  # texts encoded in one call


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others for 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


#: pre-tokenization of byte-level vocabularies whose JSON file asks for the standard expression (fixed value)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked_encoder(path: str, vocabulary: list[bytes]):
    """The file's encoder on tiktoken's engine, or None if its merges are not in the order of ids or it normalises."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(model["vocab"]) - len(merges)
    added = {t["content"] for t in told["added_tokens"]}
    first -= len(added & set(model["vocab"]))
    ordered = all(model["vocab"][a + b] == first + k for k, (a, b) in enumerate(merges))
    plain = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", False)
    if not (ordered and plain and model["type"] == "BPE"):
        return None
    import tiktoken

    ranks = {vocabulary[k]: k for t, k in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pair:
    """Both tokenizers of a worker process, their token bytes and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(a_path)
        whole.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet, vocabulary = byte_alphabet(), whole.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.encode_a = ranked_encoder(a_path, self.a_bytes) or (lambda text: whole.encode(text, add_special_tokens=False).ids)
        self.b_bytes = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(k) for k in range(len(v))] for v in (self.a_bytes, self.b_bytes))
        plain = {x: k for k, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(k)}
        single = {x: k for k, x in enumerate(self.b_bytes) if self.b.is_byte(k)}
        self.identity = np.array([plain.get(x, single.get(x, -1)) for x in self.a_bytes], np.int64)
        self.width = len(self.b_bytes)  # a pair is a * width + b

    def encoded(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for texts that one of them does not reproduce."""
        a, b = [[] for _ in texts], [[] for _ in texts]
        some = [k for k, t in enumerate(texts) if t]
        for at in range(0, len(some), TEXTS):
            part = some[at: at + TEXTS]
            left = [self.encode_a(" " + texts[k]) for k in part]
            right = self.b.encode([texts[k] for k in part], num_threads=1)
            for k, x, y in zip(part, left, right):
                want = (" " + texts[k]).encode()
                if b"".join(map(self.a_bytes.__getitem__, x)) == want == b"".join(map(self.b_bytes.__getitem__, y)):
                    a[k], b[k] = x, y
        return a, b


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Lists of sorted owners' values."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _groups(both: Pair, a: list[int], b: list[int], na: list[int], nb: list[int]) -> Iterator[str]:
    """Text of each group, in order."""
    left, right = list(map(both.a_text.__getitem__, a)), list(map(both.b_text.__getitem__, b))
    i = j = 0
    for p, q in zip(na, nb):
        yield left[i] + "|" + right[j] if p == q == 1 else ",".join(left[i: i + p]) + "|" + ",".join(right[j: j + q])
        i += p
        j += q


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own array<int>, own_times array<int>, mixed array<long>, mixed_times array<int>"


def alignments(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Per document its sizes, the digest of its groups, and its distinct linked pairs with how often they link:
    ``own`` are A ids linked with their identity, ``mixed`` the other pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a_path, b_path)
        row = TaskContext.get().partitionId() << 33
        for batch in pieces(batches):
            n = batch.num_rows
            lists_a, lists_b = both.encoded(batch.column(1).to_pylist())
            (a, n_a), (b, n_b) = _flat(lists_a), _flat(lists_b)
            ends_a, ends_b = np.cumsum(both.a_len[a]), np.cumsum(both.b_len[b])
            last = np.cumsum(n_a) - 1
            doc_ends = np.where(last >= 0, ends_a[np.maximum(last, 0)] if len(ends_a) else 0, 0)
            common_a, common_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
            group_doc = np.searchsorted(doc_ends, ends_a[common_a])
            size_a, size_b = (np.diff(np.flatnonzero(c), prepend=-1) for c in (common_a, common_b))
            n_groups = np.bincount(group_doc, minlength=n)
            cuts = np.union1d(ends_a, ends_b)
            doc = np.searchsorted(doc_ends, cuts)
            linked_a, linked_b = a[np.searchsorted(ends_a, cuts)], b[np.searchsorted(ends_b, cuts)]
            span = len(both.a_bytes) * both.width
            seen, times = np.unique(doc * span + linked_a * both.width + linked_b, return_counts=True)
            doc_of, pair = seen // span, seen % span
            own = both.identity[pair // both.width] == pair % both.width
            at = np.concatenate([[0], np.cumsum(n_groups)])
            size_a, size_b = size_a.tolist(), size_b.tolist()
            digests = [hashlib.sha256(";".join(_groups(both, lists_a[k], lists_b[k], size_a[at[k]: at[k + 1]], size_b[at[k]: at[k + 1]])).encode()).hexdigest() if lists_a[k] else "" for k in range(n)]
            times = times.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), batch.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(np.bincount(doc, minlength=n)), pa.array(digests, pa.string()),
                _lists(doc_of[own], (pair[own] // both.width).astype(np.int32), n), _lists(doc_of[own], times[own], n), _lists(doc_of[~own], pair[~own], n), _lists(doc_of[~own], times[~own], n),
            ], [c.split()[0] for c in ALIGNED.split(", ")])
            row += n

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def document_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): how many documents hold a linked pair; identity pairs come from the vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a_path, b_path)
        vector, held, size = np.zeros(len(both.a_bytes), np.int64), [], 0

        def counted(arrays):
            pairs, inverse = np.unique(np.concatenate([p for p, _ in arrays]), return_inverse=True)
            return pairs, np.bincount(inverse, np.concatenate([c for _, c in arrays])).astype(np.int64)  # below 2**53: documents of one task

        def rows(pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(vector))
            pairs, n = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            held.append((pairs, n))
            size += len(pairs)
            if size > HELD:
                held = [counted(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if size:
            yield rows(*counted(held))
        some = np.flatnonzero(vector)
        yield rows(some * both.width + both.identity[some], vector[some])

    return aligned.select("own", "mixed").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Sum of the flattened values per list."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = lists.offsets.to_numpy()
    return total[at[1:] - at[0]] - total[at[:-1] - at[0]]


REPORT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def report(docs: DataFrame, a_path: str, b_path: str, text: str = "text", bound: int = BOUND, often: int = OFTEN) -> DataFrame:
    """One row per document: sizes, links of pairs that are their A id's most frequent, and the sum of the links' counts."""
    spark, both = docs.sparkSession, pair_of(a_path, b_path)
    width, size = both.width, len(both.a_bytes)
    aligned = stored(alignments(docs, a_path, b_path, text))
    counts = stored(document_counts(aligned, a_path, b_path))
    # two vectors as long as the vocabulary of A
    a_id, b_id = (F.col("pair") / width).cast("long"), F.col("pair") % width
    known = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("best")).toArrow()
    best = np.zeros(size, np.int64)
    best[known["a"].to_numpy()] = known["best"].to_numpy()
    own_ids = spark.createDataFrame([(int(k) * width + int(b),) for k, b in enumerate(both.identity) if b >= 0], "pair long")
    found = counts.join(F.broadcast(own_ids), "pair").toArrow()
    own_n = np.zeros(size, np.int64)
    own_n[found["pair"].to_numpy() // width] = found["n"].to_numpy()
    mixed = counts.join(F.broadcast(own_ids), "pair", "left_anti")
    few = mixed.count() <= bound
    if few:
        told = mixed.toArrow().sort_by("pair")
        irregular = told["pair"].to_numpy(), told["n"].to_numpy()
    else:
        irregular = np.empty(0, np.int64), np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast((best, own_n, *irregular))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, own_n, pairs, pair_n = shared.value
        for batch in batches:
            own, own_times, mixed, mixed_times = batch.columns[-4:]
            ids, times = own.flatten().to_numpy(zero_copy_only=False), own_times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n_best, count_sum = _sums(times * (own_n[ids] == best[ids]), own), _sums(times * own_n[ids], own)
            if few:
                p, times = mixed.flatten().to_numpy(zero_copy_only=False), mixed_times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = pair_n[np.searchsorted(pairs, p)] if len(p) else np.empty(0, np.int64)
                n_best, count_sum = n_best + _sums(times * (n == best[p // width]), mixed), count_sum + _sums(times * n, mixed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(n_best), pa.array(count_sum)], [*batch.schema.names[:-4], "n_best", "count_sum"])

    columns = [c for c in ALIGNED.split(", ") if "array" not in c]
    out = aligned.mapInArrow(run, ", ".join([*columns, "n_best long", "count_sum long"]))
    if few:
        return out.select(REPORT)
    links = aligned.select("row", F.explode(F.arrays_zip("mixed", "mixed_times")).alias("m")).select("row", F.col("m.mixed").alias("pair"), F.col("m.mixed_times").cast("long").alias("times"))
    peak = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(best) if n], "a long, best long")
    told = looked_up(links, mixed.join(F.broadcast(peak), F.col("a") == a_id).select("pair", "n", "best"), "pair", "n", often)
    added = told.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = out.join(added, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(REPORT)

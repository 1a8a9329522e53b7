"""Golay-code fuzzy hashing against all pairs."""
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle
from graticule.llm import golay_simhash as golay, queries

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    """The definition, shingle by shingle and bit by bit."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    grams = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, ids):
    """Components over all pairs, named by the smallest id."""
    p = np.array(prints, np.uint64)
    root = list(range(len(p)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1:] ^ p[i]) <= 4) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [least.get(find(i)) for i in range(len(p))]


def test_query_equals_brute_force(spark):
    rows = oracle.connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = {d: (f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, classes(prints, [d for d, _ in rows]))}
    got = queries.QUERIES["op13_golay_simhash"](spark, FOLDER).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_code_is_perfect():
    assert np.bincount((golay.PATTERNS >= 0).sum(axis=1)).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 23, 5000)
    y = x ^ (1 << r.integers(0, 23, 5000))
    assert all(b in a for a, b in zip(golay.near_codewords(x), golay.near_codewords(y)[:, 0]))


@pytest.mark.parametrize("errors", range(5))
def test_every_pair_within_reach_shares_a_key(errors):
    r = np.random.default_rng(errors)
    p = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    q = p.copy()
    for i in range(len(q)):
        for b in r.choice(64, errors, replace=False):
            q[i] ^= np.uint64(1) << np.uint64(b)
    kept = [set(zip(rows.tolist(), keys.tolist())) for rows, keys in (golay.keys_of(p), golay.keys_of(q))]
    assert {i for i, _ in kept[0] & kept[1]} == set(range(len(p)))


@pytest.mark.parametrize("crowd", [golay.CROWD, 40])
def test_planted_chains_and_crowds(spark, crowd):
    """Balls, chains and scattered fingerprints; crowded keys are dealt again with the same result."""
    r = random.Random(7)
    made = {r.getrandbits(64) for _ in range(300)} | {0, 0xF, 0x1F, 0xFF, 0x1FF}
    centre = r.getrandbits(64)
    made |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(30), 2)}
    x = r.getrandbits(64)
    for _ in range(200):
        x ^= sum(1 << b for b in r.sample(range(64), 4))
        made.add(x)
    made = sorted(made)
    prints = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in made], "print long").repartition(5)
    edges = golay.links(prints, crowd).collect()
    u = lambda v: int(np.int64(v).astype(np.uint64))
    assert all(bin(u(a) ^ u(b)).count("1") <= 4 for a, b in edges)
    at = {p: i for i, p in enumerate(made)}
    root = list(range(len(made)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        i, j = sorted((find(at[u(a)]), find(at[u(b)])))
        root[j] = i
    assert [find(i) for i in range(len(made))] == classes(made, range(len(made)))
    assert len(edges) < 60 * len(made)


def test_edges_of_input(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, many copies, an empty table."""
    long = " ".join(random.Random(1).choices("abcdefgh", k=300_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e"), (5, "A b  C d\ne"), (None, "zz yy"), (7, "one"), (7, "one"), (8, "x y z"), (9, long), (10, long)] + [(20 + k, "copy of a copy of a copy") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ["print", "key", "component", "component_id", "fingerprint", "n", "least", "hot"]})
    want = [(d, f"{plain_fingerprint(t):016x}") for d, t in rows]
    for copies in (golay.COPIES, 10):
        got = golay.components(docs, copies=copies).collect()
        assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=str) == sorted(want, key=str)
        by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
        ids = [by[k] for k in want]
        assert ids == classes([int(p, 16) for _, p in want], [d for d, _ in rows])
        assert ids[:5] == [1, 1, 1, 5, 5] and ids[5] is None and set(ids[-30:]) == {20}
    assert golay.components(docs.where("false")).count() == 0

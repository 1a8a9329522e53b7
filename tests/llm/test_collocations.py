"""Phrases counted in burst tries against DuckDB and against plain counting."""
import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from graticule.llm import collocations, queries


def plain(rows, least, longest, top):
    """The definition with dictionaries."""
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i: i + m])] += 1
    out = []
    for lang in total:
        mine = {p: n for (x, p), n in f.items() if x == lang and len(p) > 1 and n >= least}
        inside = collections.defaultdict(int)
        for p, n in mine.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], n)
        scored = []
        for p, a in mine.items():
            if inside[p] >= a:
                continue
            score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def test_query_matches_duckdb(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_collocations"](spark, folder).toPandas()
    assert len(got) > 50
    assert oracle.differences(got, oracle.connect(folder).execute(queries.ORACLES["op12_collocations"]).df()) is None


@pytest.mark.parametrize("held, burst", [(collocations.HELD, collocations.BURST), (50, 4)])
def test_equals_plain_counting(spark, held, burst):
    """Few words, so all orders are frequent; tiny limits make tries burst, spill and merge many runs."""
    r = random.Random(11)
    words = ["a", "b", "C", "dé", "E-f", "gg", "日本", "\x00", "x'y"]
    rows = [(r.choice(["en", "fr", None, "und", "."]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " ; "]) for _ in range(r.randint(0, 60)))) for _ in range(400)]
    rows += [(None, None), ("en", ""), ("de", "...!?"), ("en", "A b c d e f A b c d e f")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("mine") for c in ["doc_id", "name", "words", "n", "f", "part", "keys", "counts", "word", "rank", "phrase", "h"]}).repartition(5)
    for least, top in ((3, 40), (12, 2000)):
        got = collocations.collocations(docs, least=least, top=top, held=held, burst=burst).collect()
        assert sorted(tuple(x) for x in got) == plain(rows, least, 5, top)


def test_trie_bursts_and_spills_whole_subtrees():
    r = np.random.default_rng(1)
    trie, want = collocations.BurstTrie(4, burst=8), collections.Counter()
    for _ in range(200):
        keys = np.stack([r.integers(0, 2, 40), r.choice([3, 1 << 61, 1 << 62, (1 << 63) - 1], 40), r.integers(0, 9, 40) << 40, r.integers(0, 5, 40)], axis=1).astype(np.uint64)
        keys, counts = collocations._sorted_sums(keys, np.ones(40, np.int64))
        trie.add(keys, counts)
        want.update(dict(zip(map(tuple, keys.tolist()), counts.tolist())))
        assert trie.low == sorted(trie.low) and not any(trie.low[0])
    assert len(trie.leaves) > 20 and len(trie) >= len(want)
    got = collections.Counter()
    while len(trie):
        keys, counts = trie.spill(len(trie) // 2)
        assert not set(map(tuple, keys.tolist())) & set(got)  # what is spilled is whole
        got.update(dict(zip(map(tuple, keys.tolist()), counts.tolist())))
    assert got == want


def test_large_numbers_and_empty_table(spark):
    """Products beyond 64 bits keep their floor; an empty table gives no rows."""
    docs = spark.createDataFrame([("en", "a b")] * 3, "lang string, text string")
    assert collocations.collocations(docs.where("false"), least=1).count() == 0
    big = spark.createDataFrame([(3 * 10**12 + 1, 10**14 + 3, 3 * 10**12 + 7, 4 * 10**12 + 9)], "a long, n long, l long, r long")
    div = big.select(F.expr("CAST(CAST(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(35,0)) * CAST(1000 AS DECIMAL(4,0)) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))")).first()[0]
    assert div == 1000 * (3 * 10**12 + 1) * (10**14 + 3) // ((3 * 10**12 + 7) * (4 * 10**12 + 9))
    long = " ".join(random.Random(1).choices("abcdefgh", k=200_000))
    got = collocations.collocations(spark.createDataFrame([("en", long)], "lang string, text string"), least=2000)
    assert {x["n"] for x in got.collect()} == {200_000} and np.isfinite(got.count())

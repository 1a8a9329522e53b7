"""Alignment of two tokenizers against the definition, token by token."""
import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import oracle
import public_tokenizers
from graticule.llm import queries, token_alignment

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Ranges of all tokens; all pairs of a group that overlap; counts over all texts."""
    a_tokens, b_tokens = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tokens.encode_special_tokens = True
    visible = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    back = {c: b for b, c in visible.items()}
    for k, b in enumerate(b for b in range(256) if b not in visible):
        back[chr(256 + k)] = b

    def ranges(tokens):
        out, at = [], 0
        for k, raw in tokens:
            out.append((k, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for t in texts:
        want = b" " + (t or "").encode()
        a = [(k, bytes(back[c] for c in a_tokens.id_to_token(k))) for k in a_tokens.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = []
        for k in b_tokens.encode(t or ""):
            p = b_tokens.id_to_piece(k)
            b.append((k, bytes([int(p[1:-1], 16)]) if b_tokens.is_byte(k) else p.replace("▁", " ").encode()))
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append(([], [], [], []))
            continue
        a, b = ranges(a), ranges(b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links, start = [], [], 0
        for e in ends:
            ga, gb = [x for x in a if start <= x[1] < e], [x for x in b if start <= x[1] < e]
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if max(x[1], y[1]) < min(x[2], y[2])]
            start = e
        docs.append((a, b, groups, links))
    counts = collections.Counter(p for *_, links in docs for p in set(links))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(len(a), len(b), len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, ls in docs]


def rows_of(df):
    return [tuple(r) for r in df.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "doc_id").collect()]


def test_query_equals_definition(spark):
    rows = oracle.connect(FOLDER).execute("SELECT doc_id, text FROM documents WHERE length(text) < 6000 OR text IS NULL").fetchall()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 6000 OR text IS NULL").repartition(5)
    got = {r[-1]: r[:-1] for r in rows_of(token_alignment.report(docs, A, B))}
    assert got == dict(zip([d for d, _ in rows], plain([t for _, t in rows])))
    assert queries.QUERIES["op11_token_alignment"](spark, FOLDER).columns == token_alignment.REPORT


def strange_texts():
    r = random.Random(5)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "🙂", "́", "▁", "<|endoftext|>", "</s>", "<0x41>", "<unk>", "\x00", "  \n", "123", "'s", "ﬁ", " ", "﻿", "aaa"]
    made = ["".join(r.choices(letters, k=r.randint(1, 14))) for _ in range(300)]
    return [None, "", " ", "\n", "<|endoftext|>", "a" * 5000, "aaa", "word " * 3000, *made, *made[:20]]


@pytest.mark.parametrize("bound", [token_alignment.BOUND, 0])
def test_strange_texts_both_ways(spark, bound):
    """Control strings, odd spaces, characters cut by tokens, repeated rows, null ids, clashing columns; the join's way too."""
    texts = strange_texts()
    ids = [None if k % 7 == 3 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ["row", "pair", "n", "best", "own", "mixed", "n_a", "times", "_hot", "a"]})
    got = rows_of(token_alignment.report(docs.repartition(4), A, B, bound=bound, often=20))
    assert sorted(got, key=str) == sorted(((*w, i) for w, i in zip(plain(texts), ids)), key=str)


def test_engine_equals_the_files_tokenizer():
    """The ranked engine against the tokenizer as loaded from the file, over all code points in several neighbourhoods."""
    pair, whole = token_alignment.Pair(A, B), Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    assert token_alignment.ranked_encoder(A, pair.a_bytes) is not None
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c} " for c in points[k: k + 64]) for k in range(0, len(points), 64)]
    assert [pair.encode_a(t) for t in texts] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_long_text_and_empty_table(spark):
    text = " ".join(random.Random(2).choices(["the", "of", "tion", "zxq", "é", "42"], k=200_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    one, two = rows_of(token_alignment.report(docs, A, B))
    assert one[:-1] == two[:-1] and one[0] > 200_000 and one[3] >= one[2] > 100_000
    assert token_alignment.report(docs.where("false"), A, B).count() == 0

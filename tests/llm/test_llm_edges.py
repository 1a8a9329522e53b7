"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graticule.llm import chat, consensus_html, count_tree, language, mixture, order_minhash, permutation_index, retrieval_packing, site_lines, url_trees
import public_tokenizers

CLASHES = ["row", "size", "target", "copies", "n_lines", "n_dropped", "lang_pred", "score", "rejected", "node", "leaf", "h", "bucket", "ghost", "sketches", "ids", "route", "salt", "host", "path", "rule", "verdict", "prediction", "length", "n_shingles", "component_id", "_site", "_index", "d", "s", "z"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def long_text(n=30000, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ROWS = [
    (1, "one two three four five six", "en", "a", 27), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "fr", None, 4), (None, "no id here", None, None, None),
    (5, long_text(), "en", "a", 1), (6, long_text(), "en", "b", 1), (7, "one two three four five six", "en", "a", 27), (7, "one two three four five six", "en", "a", 27), (8, "x", "de", "b", 1), (9, "1234 --- !!", "de", "b", 9),
    (10, "one two three four five six", None, None, 27),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_mixture(docs, nothing):
    plan = mixture.mixture_plan(docs).collect()
    assert len(plan) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in plan)
    assert {r["doc_id"]: r["size"] for r in plan if r["doc_id"] in (2, 3, 4, 5)} == {2: 0, 3: 0, 4: 0, 5: 30000}
    total = sum(r["size"] for r in plan)
    assert abs(sum({r["source"]: r["target"] for r in plan}.values()) - total) < 1e-6
    mixed = mixture.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert {r["size"] for r in mixed.select("size").distinct().collect()} == {"mine size"}
    assert mixture.mixture_plan(nothing).count() == 0 and mixture.mixed(nothing).count() == 0


def test_site_lines(spark, docs, nothing):
    out = site_lines.without_boilerplate(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(ROWS)
    assert {r["text"] for r in out.where("doc_id = 2").collect()} == {None}
    assert site_lines.without_boilerplate(nothing).count() == 0
    pages = [(k, f"menu\nbody {k}\n \nmenu\t", "s") for k in range(6)] + [(k, "menu", "s") for k in range(6, 9)] + [(9, "menu\nelse", None), (9, "menu\nelse", None)]
    got = site_lines.without_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, source string"), ratio=0.5).collect()
    told = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert told == {(k, f"body {k}\n ", 3, 2) for k in range(6)} | {(k, "menu", 1, 0) for k in range(6, 9)} | {(9, "menu\nelse", 2, 0)} and len(got) == len(pages)


def test_language(docs, nothing):
    content = language.learned(docs)
    out = language.identified(docs, content)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(ROWS)
    none = out.where("text IS NULL OR NOT text RLIKE '[a-z]'").collect()
    assert len(none) == 4 and all(r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0 for r in none)
    assert language.learned(nothing) == {} and language.identified(nothing, {}).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, {}).collect()} == {"und"}


def chained(spark, ids, more=()):
    """a ~ b ~ c, where a and c do not link at 85 of 100, under these ids."""
    w = [f"w{k}" for k in range(200)]
    a, b = w, w[:-10] + [f"y{k}" for k in range(10)]
    c = [f"z{k}" for k in range(10)] + b[10:]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, (a, b, c))] + list(more), "doc_id long, text string")


@pytest.mark.parametrize("ids, want", [((1, None, 2), {1}), ((None, None, None), {None}), ((9, 3, 9), {3})])
def test_null_and_repeated_ids_carry_links(spark, ids, want):
    """The middle document links the outer ones whatever its id is."""
    df = chained(spark, ids)
    got = count_tree.components(df).collect()
    assert len(got) == 3 and {r["component_id"] for r in got} == want


def test_one_of_each_class_stays(spark):
    """Null ids are no class of their own, an id's other text does not stay with it, rows without words stay, columns are kept."""
    other = " ".join(f"q{k}" for k in range(50))
    df = chained(spark, (1, None, 2), [(2, other), (None, other), (3, other), (None, "alone and without an id"), (None, "alone and without an id"), (5, None), (6, ""), (5, None)])
    df = df.selectExpr("*", "1 AS text_key", "2 AS node", "3 AS component")
    got = count_tree.one_of_each(df, 4, 85, 100)
    assert got.columns == df.columns
    told = sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in got.collect()), key=str)
    assert told == sorted([(1, "w0 w1"), (2, "q0 q1"), (None, "alone"), (5, ""), (6, "")], key=str)
    assert count_tree.one_of_each(df.where("false"), 4, 85, 100).count() == 0


def test_count_tree(docs, nothing):
    got = count_tree.components(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == by[7] == by[10] == (3, 1) and by[5] == by[6] and by[5][1] == 5
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4) and by[8] == (1, 8) and by[None] == (1, None)
    assert count_tree.components(nothing).count() == 0


def test_packing(docs, nothing):
    got = retrieval_packing.packed(docs, BPE).toPandas()
    assert set(got[got.doc_id.isin([2, 3])].doc_tokens) == {1}
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()
    want = {r["doc_id"]: r["t"] for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("t")).collect() if r["doc_id"]}
    whole = got.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert all(whole.loc[k].n == whole.loc[k].t * t for k, t in want.items())
    assert retrieval_packing.packed(nothing, BPE).count() == 0


def test_order_minhash(docs, nothing):
    got = {r["doc_id"]: r for r in order_minhash.edit_report(docs).collect()}
    assert order_minhash.edit_report(docs).count() == len(ROWS)
    assert got[1]["fingerprint"] == got[7]["fingerprint"] == got[10]["fingerprint"] and got[5]["near_next"] == 0.0 and got[6]["near_next"] == 1.0
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == "0" * 256 and got[2]["n_chars"] == 0
    assert order_minhash.edit_report(nothing).count() == 0


def test_chat(spark):
    rows = [(1, 2, "assistant", "late <|end|>\n"), (1, None, "user", None), (1, 2, "assistant", "late <|end|>\n"), (2, 0, None, "\\[INST]\\\\"), (None, 0, "a\nb", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine")).withColumn("runs", F.lit(0)).withColumn("parts", chat.text_part(F.col("text")))
    out = chat.formatted(turns)
    got = {r["conv_id"]: r for r in out.collect()}
    assert chat.turns_of(got[1]["formatted"]) == [("user", ""), ("assistant", "late <|end|>\n"), ("assistant", "late <|end|>\n")]
    assert chat.turns_of(got[2]["formatted"]) == [("", "\\[INST]\\\\")] and chat.turns_of(got[None]["formatted"]) == [("a\nb", "x")]
    assert chat.under_mask(got[1]["formatted"], [x.asDict() for x in got[1]["runs"]]) == ["late <|end|>\n"] * 2
    assert chat.digests(out).count() == 3 and chat.formatted(turns.where("false")).count() == 0


def test_consensus_html(spark):
    pages = [(1, "http://h/a", None), (2, None, "<p>a<p>b"), (3, "http://h/b", ""), (3, "http://h/b", ""), (4, "nowhere", "<div class=x1>" + "<i>" * 3000 + "deep &lt;text&gt;"), (None, "http://h/c", "<b>bold")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("path", F.lit("mine")).withColumn("text", F.lit("mine"))
    got = {(r["page_id"], r["text"]) for r in consensus_html.extracted(df).collect()}
    assert got == {(1, ""), (2, "a b"), (3, ""), (4, "deep <text>"), (None, "bold")}
    assert consensus_html.extracted(df.where("false")).count() == 0


def test_url_trees(spark, docs):
    rules = [url_trees.Rule("block", "net", "/")]
    rows = [(1, "http://A.net/x"), (2, None), (3, ""), (4, "no scheme"), (4, "no scheme"), (5, "http://b.org/" + "p" * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in CLASHES})
    out = url_trees.judged(df, rules)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(rows)
    assert {(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in out.collect()} == {(1, "a.net", "net/", "block"), (2, "", None, "block"), (3, "", None, "block"), (4, "", None, "block"), (5, "b.org", None, "block")}
    assert {r["verdict"] for r in url_trees.judged(df, []).collect()} == {"allow"}
    assert url_trees.judged(df.where("false"), rules).count() == 0


def test_permutation_index(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ["id", "v", "p", "file", "places", "rank", "score"]})
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in permutation_index.search(df, F.col("id") % 100 == 0).collect()}
    assert got == {(0, 1): (3, 0.0), (0, 2): (100, 0.0), (0, 3): (2, 2 ** 0.5), (0, 4): (2, 2 ** 0.5), (100, 1): (0, 0.0), (100, 2): (3, 0.0), (100, 3): (2, 2 ** 0.5), (100, 4): (2, 2 ** 0.5)}
    assert permutation_index.search(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_pipeline_stages(spark, docs, nothing, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, plain.where("false")):
        rows = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == plain.columns
                rows.write.parquet(path := f"{tmp_path}/{k}-{start is plain}")
                rows = spark.read.parquet(path)
        rows.count()

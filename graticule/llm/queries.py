"""Registered queries of the operators in this subpackage, with their DuckDB statements where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graticule.llm import chat, collocations, consensus_html, count_tree, golay_simhash, language, mixture, order_minhash, permutation_index, retrieval_packing, site_lines, token_alignment, url_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op9_mixture", r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
named AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
filled AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM named),
targets AS (SELECT source, source_size, least(weight * max(level) OVER (), CAST(source_size * 3 AS DOUBLE)) AS target FROM filled),
laid AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
    CAST(row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id) - 1 AS DOUBLE) AS i,
    CAST(CAST('0x' || substr(md5('17|' || coalesce(s.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS part FROM laid),
placed AS (SELECT *, CASE WHEN part > 0 AND CAST(floor(i * part) AS BIGINT) % 2 = 1 THEN ceil(floor(i * part) / part) + ceil((floor(i * part) + 1) / part) - 1 - i ELSE i END AS pos FROM parts)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(size * (whole + CASE WHEN part > 0 THEN floor(u + (pos + 1) * part) - floor(u + pos * part) ELSE 0 END) AS BIGINT) AS taken FROM placed""")
def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixture.mixture_plan(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ESCAPED = "coalesce({0}, '')"
for _old, _new in [("\\", "\\\\"), *((c, c[0] + "\\" + c[1:]) for c in chat.CONTROL)]:
    ESCAPED = f"replace({ESCAPED}, '{_old}', '{_new}')"


@query("op1_chat_format", f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(chat.TURN) + len(chat.END) + 1} + length(replace({ESCAPED.format('role')}, chr(10), '\\' || chr(10))) + length({ESCAPED.format('text')})) AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM turns GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(["user", "assistant"])], turns.schema)
    turns = turns.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.formatted(turns))


@query("op8_site_lines", r"""
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS page FROM documents),
lines AS (SELECT page, doc_id, source, p.line, p.k, trim(p.line, chr(32) || chr(9) || chr(13)) AS bare FROM pages, (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k) p),
shares AS (SELECT source, bare, count(DISTINCT page) AS n FROM lines WHERE bare <> '' GROUP BY source, bare),
totals AS (SELECT source, count(*) AS total FROM pages WHERE text IS NOT NULL GROUP BY source),
bad AS (SELECT s.source, s.bare FROM shares s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n > 0.1::DOUBLE * total),
marked AS (SELECT l.*, b.bare IS NOT NULL AS hit FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare),
done AS (SELECT page, string_agg(line, chr(10) ORDER BY k) FILTER (NOT hit) AS kept, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (hit) AS n_hit, count(*) FILTER (bare <> '' AND NOT hit) AS n_kept FROM marked GROUP BY page)
SELECT p.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(CASE WHEN n_kept > 0 THEN n_hit ELSE 0 END AS BIGINT) AS n_dropped, CASE WHEN n_kept > 0 THEN kept ELSE p.text END AS text
FROM pages p LEFT JOIN done d ON p.page = d.page""")
def op8_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_boilerplate(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


RULES = [url_trees.Rule("block", "net", "/"), url_trees.Rule("allow", "example.net", "/en/"), url_trees.Rule("block", "example.com", "/de/"), url_trees.Rule("allow", "org", "/fr/")]


@query("op6_url_trees")
def op6_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_trees.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    told = language.identified(docs.select("doc_id", "text"), language.learned(docs))
    return told.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_count_tree", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) m ON s.doc_id = m.x""")
def op10_count_tree(spark: SparkSession, folder: str) -> DataFrame:
    return count_tree.components(table(spark, folder, "documents"))


@query("op2_retrieval_packing")
def op2_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_consensus_html")
def op5_consensus_html(spark: SparkSession, folder: str) -> DataFrame:
    out = consensus_html.extracted(table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


@query("op7_permutation_index")
def op7_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.search(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edit_report(table(spark, folder, "documents"))


@query("op13_golay_simhash")
def op13_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return golay_simhash.components(table(spark, folder, "documents"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, i, words FROM w, (SELECT unnest(range(1, 6)) AS m) orders, unnest(range(1, len(words) - m + 2)) AS t(i)),
f AS (SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m >= 2),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.m > c.m AND x.a >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT kept.lang, kept.phrase, kept.a, n, l.f AS l, r.f AS r, k, (1000::HUGEINT * kept.a * n) // (l.f::HUGEINT * r.f) AS score
    FROM kept JOIN totals ON totals.lang = kept.lang, unnest(range(1, kept.m)) AS t(k) JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(kept.words[1 : k], ' ') JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(kept.words[k + 1 : ], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM lowest QUALIFY rank <= 2000""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))

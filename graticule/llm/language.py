"""Language identification by compression.

Each language has a raw-content dictionary of learned text.  A text, lower-cased and reduced to its letters,
is compressed once per language with that dictionary, and the smallest output names the language.  Long texts are compressed in blocks, each with a
fresh dictionary, so all of the text counts and the dictionary matters as much at its end as at its start.

The fit reads a bounded sample: SNIPPETS documents per language, SNIPPET characters of each; prediction reads
whole texts.  ``score`` is the margin between the best and the second best, as a share of the latter; a
margin under MARGIN is a rejection.

Defined cases: null text or text without a letter is ``und`` with score 0 and rejected; ties go to the first
language by name and are rejected; with one learned language it is always chosen, with score 1; nothing
learned gives ``und``; a null doc_id counts as held out; rows that repeat are judged alike; input columns
named like the three written ones are replaced, all others pass through.
"""
from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graticule.llm.batches import pieces

FOLDS = 5
SNIPPETS, SNIPPET = 96, 1200
CODER = {"min_match": 3, "strategy": zstandard.STRATEGY_BTOPT, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
LEVEL, CHUNK = 3, 2048  # bytes
MARGIN = 0.002
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
NO_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def learned(docs: DataFrame) -> dict[str, bytes]:
    """Language -> dictionary content, from the labelled documents that are not held out.

    Per language, the documents whose content hash falls under a share that leaves about SNIPPETS of them;
    the driver gets at most that many snippets per language.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (place * n < F.lit(2 * SNIPPETS << 32)))
    rows = known.where(wanted).groupBy("lang").agg(F.slice(F.array_sort(F.collect_set(F.struct(place.alias("p"), F.substring("text", 1, SNIPPET).alias("x")))), 1, SNIPPETS).alias("s")).collect()
    return {r["lang"]: b"".join(letters(s["x"]) for s in r["s"]) for r in rows}


def letters(text: str) -> bytes:
    return f" {' '.join(NO_LETTERS.split(text.lower()))} ".encode()


@functools.lru_cache(maxsize=4)
def coders(contents: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=CHUNK, dict_size=len(content), **CODER)
        d.precompute_compress(compression_params=how)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=how)))
    return out


def sizes(text: str, made: list[tuple[str, zstandard.ZstdCompressor]]) -> list[int]:
    data = letters(text)
    blocks = [data[k: k + CHUNK] for k in range(0, len(data), CHUNK)]
    return [sum(len(c.compress(b)) for b in blocks) for _, c in made]


def judge(text: str | None, made: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected)"""
    if not made or text is None or not LETTER.search(text):
        return UNKNOWN, 0.0, True
    if len(made) == 1:
        return made[0][0], 1.0, False
    order = sorted((n, lang) for n, (lang, _) in zip(sizes(text, made), made))
    (best, lang), (second, _) = order[:2]
    score = (second - best) / second
    return lang, score, score < MARGIN


def identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` plus lang_pred, score and rejected; only ``text`` is looked at."""
    contents = tuple(sorted(dictionaries.items()))
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coders(contents)
        for b in pieces(batches):
            told = [judge(t, made) for t in b.column(at).to_pylist()]
            extra = [pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()), pa.array([x[2] for x in told], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(predict, schema)

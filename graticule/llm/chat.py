r"""Chat formatting of typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string: texts are escaped,
attachments become ordered placeholders, and every attachment is recorded with its reference and the number
of tokens its placeholder stands for.  A turn reads ``<|turn|>role\ncontent<|end|>\n``.

Escaping is reversible: every backslash is doubled and one is put behind the first character of each control
string, so no control string of a text survives and ``\x -> x`` undoes it.

Defined cases: null text, role or reference is empty; a part of unknown or null type counts as text; a turn
without parts is empty; null turns come first; turns with one number are ordered by role and content; an
empty table gives no conversation; a null conv_id is a conversation of its own; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Strings that chat templates read as control.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>"
BLOCK = 256  # turns put together before the blocks of a conversation are


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class PartVisitor:
    """What each type of part becomes: content, and for attachments the tokens they expand to."""

    def __init__(self, patch: int = 28, tokens_per_second: int = 25, tokens_per_page: int = 256):
        self.patch, self.tokens_per_second, self.tokens_per_page = patch, tokens_per_second, tokens_per_page

    def expanded(self, p: Column) -> Column:
        tiles = F.ceil(F.coalesce(p["width"], F.lit(0)) / self.patch) * F.ceil(F.coalesce(p["height"], F.lit(0)) / self.patch)
        return F.when(p["type"] == "image", tiles) \
            .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.tokens_per_second)) \
            .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * self.tokens_per_page).otherwise(F.lit(0)).cast("long")

    def is_attachment(self, p: Column) -> Column:
        return F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))

    def content(self, p: Column) -> Column:
        return F.when(self.is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escaped(p["text"]))

    def flatten(self, parts: Column) -> Column:
        """struct(content, attachments) of one turn; attachments keep the order of their placeholders."""
        parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
        refs = F.transform(F.filter(parts, self.is_attachment), lambda p: F.struct(p["type"].alias("type"), F.coalesce(p["uri"], F.lit("")).alias("uri"), self.expanded(p).alias("tokens")))
        return F.struct(F.array_join(F.transform(parts, self.content), "").alias("content"), refs.alias("attachments"))


def text_part(text: Column) -> Column:
    """Parts of a turn that is plain text."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("uri"), null("long").alias("width"), null("long").alias("height"), null("double").alias("seconds"), null("long").alias("pages"))).cast(f"array<{PART}>")


def formatted(turns: DataFrame, visitor: PartVisitor | None = None, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, runs, attachments from (conv_id, turn, role, parts).

    ``runs`` is the loss mask by run length: per turn ``skip`` code points, then ``take`` under the mask, then
    ``rest``.  Run lengths need no running sum, so a conversation of any length is put together in two
    steps: blocks of turns, then the blocks.
    """
    visitor = visitor or PartVisitor()
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visitor.flatten(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n"))
    t = t.select("conv_id", "turn", "role", head.alias("head"), F.col("flat.content").alias("content"), F.col("flat.attachments").alias("attachments"))
    loss = F.col("role") == trained_role
    take = F.when(loss, F.length("content")).otherwise(0)
    run = F.struct(F.length("head").alias("skip"), take.alias("take"), (F.length("content") - take + len(END)).alias("rest"))
    piece = F.struct("turn", "role", F.concat("head", "content", F.lit(END)).alias("text"), run.alias("run"), "attachments")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    put = lambda c, f: F.array_join(F.transform(c, lambda x: x["text"]), "").alias("text") if f == "text" else F.flatten(F.transform(c, lambda x: x[f])).alias(f)
    b = t.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    b = b.select("conv_id", F.struct("block", put(F.col("p"), "text"), F.transform("p", lambda x: x["run"]).alias("runs"), put(F.col("p"), "attachments")).alias("b"))
    c = b.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("p"))
    return c.select("conv_id", put(F.col("p"), "text").alias("formatted"), put(F.col("p"), "runs"), put(F.col("p"), "attachments"))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, content) per turn, read back from the formatted text of a conversation of texts."""
    out = []
    for seg in text.split(TURN)[1:]:
        role = re.match(r"(?:[^\\\n]|\\.)*", seg, flags=re.DOTALL)[0]
        out.append((unescaped(role), unescaped(seg[len(role) + 1: -len(END)])))
    return out


def under_mask(text: str, runs: list[dict]) -> list[str]:
    """Unescaped text of each stretch under the loss mask."""
    out, at = [], 0
    for r in runs:
        at += r["skip"]
        if r["take"]:
            out.append(unescaped(text[at: at + r["take"]]))
        at += r["take"] + r["rest"]
    return out


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation: what can be read back from its formatted text and mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = turns_of(r["formatted"])
                whole = hashlib.sha256()
                for role, content in turns:
                    whole.update(f"{role}\n{content}\n".encode())
                loss = "".join(under_mask(r["formatted"], r["runs"]))
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                             "formatted_chars": len(r["formatted"]), "n_attachments": len(r["attachments"]), "expanded_tokens": sum(a["tokens"] for a in r["attachments"])})
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[n] for x in rows], pa.string() if "sha" in n else pa.int64()) for n in names})

    return chats.select("conv_id", "formatted", "runs", "attachments").mapInArrow(read, schema)

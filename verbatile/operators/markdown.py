"""Markdown by lines: block types, headings, sections. Rows are (doc_id, line, text), as corpus.lines gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.operators import corpus

FENCE = r"^\s*(```|~~~)"
HEADING = r"^#{1,6}\s+\S"
#: Block types and their patterns; the first that matches counts.
BLOCKS = [
    ("blank", r"^\s*$"), ("indented", r"^(?: {4}|\t)\s*\S"), ("comment", r"^\s*<!--.*-->\s*$"), ("declaration", r"^\s*<[!?]"), ("html", r"^\s*</?[A-Za-z][^>]*>"), ("heading", HEADING),
    ("rule", r"^\s*(-{3,}|\*{3,}|_{3,})\s*$"), ("quote", r"^\s*>"), ("list", r"^\s*([-*+]|\d+[.)])\s+\S"), ("table", r"^\s*\|.*\|\s*$"), ("footnote", r"^\[\^[^\]]+\]:"),
    ("reference", r"^\s{0,3}\[[^\]^][^\]]*\]:\s*\S"), ("image", r"^\s*!\[[^\]]*\]\([^)]*\)\s*$"), ("link", r"^\s*\[[^\]]*\]\([^)]*\)\s*$"),
]


def block_types(rows: DataFrame) -> DataFrame:
    """rows with block: the type of each line; fences and what they hold are code."""
    d = corpus.fence_state(rows, "doc_id", "line", F.col("text").rlike(FENCE))
    kind = F.when(F.col("inside") | F.col("text").rlike(FENCE), "code")
    for name, pattern in BLOCKS:
        kind = kind.when(F.col("text").rlike(pattern), name)
    return d.withColumn("block", kind.otherwise("paragraph")).drop("inside")


def heading_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"^#+\s*|\s*#+\s*$", "")))


def without_sections(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows without the sections of the given headings (lower case), each up to the next heading."""
    d = block_types(rows)
    d = corpus.forward_fill(d, "doc_id", "line", F.when(F.col("block") == "heading", heading_key(F.col("text"))), "section")
    return d.where(~F.coalesce(F.col("section").isin(names), F.lit(False))).drop("section")

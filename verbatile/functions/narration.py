"""Text for speech: paragraphs, chunks of bounded length, Unicode forms. Nulls stay null."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def paragraphs(c: Column, letters: int = 4) -> Column:
    """Paragraphs (headings are their own) with single spaces; those with fewer letters, such as ornaments, are left out."""
    apart = F.regexp_replace(c, r"(?m)^(#{1,6} [^\n]*)$", "\n\n$1\n\n")
    found = F.transform(F.split(apart, r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s*#+ ", ""), r"\s+", " ")))
    return F.filter(found, lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", "")) >= letters)


def chunks_of(text: str, limit: int, least: int) -> list[str]:
    """Pieces of at most limit characters: cut behind the last mark in the second half of the limit, else at the last space,
    else hard. A piece shorter than least joins the one before it where both fit."""
    out: list[str] = []
    text = text.strip()
    while text:
        if len(text) <= limit:
            piece, text = text, ""
        else:
            head = text[: limit + 1]
            marks = [i + 1 for i in range(limit // 2, limit) if head[i] in ".!?;:," and head[i + 1 : i + 2].isspace()]
            at = marks[-1] if marks else head.rfind(" ")
            at = at if at > 0 else limit
            piece, text = text[:at].rstrip(), text[at:].lstrip()
        if out and len(piece) < least and len(out[-1]) + 1 + len(piece) <= limit:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def speech_chunks(c: Column, limit: int = 400, least: int = 40) -> Column:
    if not 0 < least <= limit:
        raise ValueError("0 < least <= limit")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunks_of(t, limit, least))

    return run(c)

"""Column functions for prose that a converter has made: markup, headings, spacing, damaged encodings. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what UTF-8 looks like when it was read as Windows-1252.
MOJIBAKE = "Ã.|Â.|â€.|ï¬.|ðŸ."
# Digits that scans give for letters.
DIGITS = {"0": "o", "1": "l", "5": "s", "8": "b"}


def mojibake_score(c: Column) -> Column:
    """Damaged characters, replacement characters twice."""
    return F.regexp_count(c, F.lit(MOJIBAKE)) + 2 * F.regexp_count(c, F.lit("�"))


def spacing(c: Column) -> Column:
    """One space, one empty line at most, none before punctuation or a line's end."""
    for pattern, value in ((r"[ \t]{2,}", " "), (r" +\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+([,.;:!?])", "$1")):
        c = F.regexp_replace(c, pattern, value)
    return c


def without_footnotes(c: Column) -> Column:
    """Definitions with their indented lines, then references."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^\[\^[^\]\n]+\]:[^\n]*\n?(?:[ \t]+\S[^\n]*\n?)*", ""), r"\[\^[^\]\n]+\]", "")


def digit_letters(c: Column) -> Column:
    """In a word with exactly one digit, at its head or between letters, and two letters or more that are not all capitals, the digit
    becomes the letter that it looks like."""
    for digit, letter in DIGITS.items():
        c = F.regexp_replace(c, rf"(?<!\w)(?=\w*[a-z])([A-Za-z]*){digit}([A-Za-z]+)(?!\w)(?<=\w{{3}})", f"$1{letter}$2")
    return c


def speech_issues(c: Column, letters: int = 4) -> Column:
    """What may hurt a speech engine in a chunk, as an array of codes."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    many = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return F.array_compact(F.array(
        F.when(n < letters, F.concat(F.lit("LOW_ALPHA("), n.cast("string"), F.lit(")"))),
        F.when(c.rlike("[<>]"), "XML_BRACKETS"),
        F.when(c.rlike(r"(?i)&(?!(?:#\d+|#x[0-9a-f]+|amp|lt|gt|quot|apos);)"), "RAW_AMPERSAND"),
        F.when(many("“") != many("”"), "UNBALANCED_CURLY_QUOTES"),
    ))


def speaks(languages: Column, wanted: Column) -> Column:
    """Whether an array of language tags holds the wanted one or one of the same base."""
    base = lambda x: F.split(F.lower(F.trim(x)), "[-_]")[0]
    return F.exists(languages, lambda x: base(x) == base(wanted))

"""Column functions for headings as converters leave them. All stay in the JVM; null is no heading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What begins a numbered heading, the names of unnumbered ones, and what stands between a label and a title.
KINDS = "chapter|story|part|book|volume|act|section"
NAMES = (
    r"prologue|epilogue|prelude|introduction|interlude|appendix|afterword|foreword|acknowledg(?:e)?ments?|character\s+profiles?|glossary|"
    r"bonus\s+short\s+stories|short\s+stories|side\s+stories|extras?|notes|references|bibliography"
)
BETWEEN = r"[|:\-–—]"
NUMBERED = rf"(?i)^({KINDS})\s+([\divxlcdm]+)(?:\s*{BETWEEN}\s*|\s+)(.+)$"
BARE = rf"(?i)^({KINDS})\s+([\divxlcdm]+)\s*$"
NAMED = rf"(?i)^({NAMES})(?:\s*{BETWEEN}\s*(.+))?$"
ATX = r"^(#{1,6})\s+(.+?)\s*$"


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def body_of(line: Column) -> Column:
    """A line's text without heading marks, underlining tags and emphasis around all of it."""
    t = F.trim(F.coalesce(line, F.lit("")))
    t = F.when(t.rlike(ATX), F.trim(_part(t, ATX, 2))).otherwise(t)
    t = F.trim(F.regexp_replace(t, r"(?i)</?u>", ""))
    for mark in (r"\*\*", "__"):
        t = F.regexp_replace(t, rf"^{mark}(.*?){mark}$", "$1")
    return F.trim(t)


def is_false_heading(body: Column, never: tuple[str, ...] = (NUMBERED, NAMED)) -> Column:
    """Prose that a converter took for a heading: nothing, a quotation, a part of a sentence, an exclamation of one or two words, a
    time of day. What matches one of never isn't: by default, numbered and named headings."""
    t = F.trim(body)
    opens, ends = F.substring(t, 1, 1), F.right(t, F.lit(1))
    word = r"[A-Z][A-Za-z'’-]*"
    exclaimed, time = rf"\A{word}(\s+{word})?[.!?…]\z", r"\A\d{1,2}(:\d{2}){1,2}(…|\.\.\.)?\z"
    prose = opens.isin("“", '"', "‘", "'", "—") | ends.isin("—", ",", ";", ":") | opens.rlike("[a-z]") | t.rlike(exclaimed) | t.rlike(time)
    for pattern in never:
        prose = prose & ~t.rlike(pattern)
    return F.coalesce((t == "") | prose, F.lit(True))


def _number(c: Column) -> Column:
    return F.when(c.rlike("(?i)^[ivxlcdm]+$"), F.upper(c)).otherwise(c)


def _titled(label: Column, title: Column) -> Column:
    t = F.trim(title)
    return F.concat(F.lit("# "), label, F.when(t == "", "").otherwise(F.concat(F.lit(": "), t)))


def normal_heading(line: Column) -> Column:
    """The line as a heading in one form: `# Chapter IV: Title`. False headings lose their marks, other lines only what trails."""
    t, body = F.trim(F.coalesce(line, F.lit(""))), body_of(line)
    marker = r"(?i)^\[chapter\]\s*([\divxlcdm]+)(?:\s*[|:\-–—]?\s*)(.*)$"
    kind = lambda p: F.initcap(_part(body, p, 1))
    name = _part(body, NAMED, 1)
    proper = F.when(name.rlike(r"(?i)^character\s+profiles?$"), "Character Profiles").otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))
    return (
        F.when(body.rlike(marker), _titled(F.concat(F.lit("Chapter "), _number(_part(body, marker, 1))), _part(body, marker, 2)))
        .when(body.rlike(BARE), _titled(F.concat(kind(BARE), F.lit(" "), _number(_part(body, BARE, 2))), F.lit("")))
        .when(body.rlike(NUMBERED), _titled(F.concat(kind(NUMBERED), F.lit(" "), _number(_part(body, NUMBERED, 2))), _part(body, NUMBERED, 3)))
        .when(body.rlike(NAMED), _titled(proper, _part(body, NAMED, 2)))
        .when(t.rlike(ATX), F.when(is_false_heading(body), body).otherwise(F.concat(_part(t, ATX, 1), F.lit(" "), body)))
        .otherwise(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+$", ""))
    )


def heading_text(line: Column) -> Column:
    """The text of a line that is a heading by its marks or its words, null otherwise."""
    t = F.trim(line)
    body = F.regexp_replace(F.when(t.rlike(ATX), F.trim(_part(t, ATX, 2))).otherwise(t), r"(?i)</?u>", "")
    body = F.trim(F.regexp_replace(body, r"^[*_]+|[*_]+$", ""))
    profiles = r"^(?:[A-Z][A-Z0-9 _'’:\-]{2,}\s+)?(?i:character\s+prof(?:iles?|les?))$"
    return F.when(body.rlike(profiles), "Character Profiles").when(t.rlike(ATX) | body.rlike(NAMED) | body.rlike(NUMBERED), body)


def section_key(label: Column) -> Column:
    """How labels of sections are compared: letters and digits in lower case, misspelt profiles put right, a series' name before them
    left out."""
    t = F.regexp_replace(F.trim(F.regexp_replace(label, r"(?i)</?u>", "")), r"^#{1,6}\s*", "")
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, "[*_`]+", "")), "[^a-z0-9]+", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"\bprofles\b", "profiles"), r"\bprofle\b", "profile")
    return F.regexp_replace(F.regexp_replace(t, r"^[a-z0-9 ]+\s+(character profiles?)$", "$1"), r"\s+", " ")

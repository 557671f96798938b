"""Column predicates of single lines and small blocks of text. All stay in the JVM; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ornaments that separate scenes, symbols and clusters that scans make, spaces of any script (Zs), what publishers and authors write.
ORNAMENTS = r"\u2500-\u27BF\u2B00-\u2BFF\uFFF0-\uFFFF"
SYMBOLS = r"[><~=|/@#^&\\]{4,}"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CLUSTER = "(?i)[bcdfghjklmnpqrstvwxyz]{8,}"
PUBLISHER = r"(?i)J-Novel Club|Yen Press|Light Novel|Publisher|Published|ISBN|ISSN|Story by|Written by|Illustrated by|Illustration by|Author|Illustrator|20\d{2}.*All rights reserved"
TIMELINE = r"(?i)Time[ -]?Line|Character Profile|Glossary|Appendix"
AUTHOR = r"(?i)Afterword|Author'?s? (?:Note|Notes|Comment|Remarks)|Epilogue - Author"
# File names' endings of videos.
VIDEOS = ("3gp", "avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "ts", "webm", "wmv")


def _t(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _n(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_separator(c: Column) -> Column:
    """Only ornaments, punctuation and Markdown's marks, or nothing."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{ORNAMENTS}\s*_~`.,;:!?=+-]+", "") == ""


def re2_line(c: Column) -> Column:
    """A line as DuckDB's regular expressions read it: a vertical tab is no white space."""
    return F.translate(c, "\x0b", "\x01")


def without_outer_spaces(c: Column) -> Column:
    """Without the spaces of any script around it, as DuckDB's trim()."""
    return F.trim(c, F.lit(SPACES))


def is_scan_noise(c: Column, symbols: str = SYMBOLS, cluster: str = CLUSTER, least: int = 1) -> Column:
    """A line of ten characters or more with hardly a letter and a run of symbols, or one of least or more mostly made of consonant clusters;
    headings aren't."""
    t = _t(c)
    n = F.length(t)
    share = _n(t, r"\p{L}") / n
    clustered = F.aggregate(F.regexp_extract_all(t, F.lit(cluster), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return (t != "") & ~t.rlike(r"^#{1,6}\s") & ((n >= 10) & (share < 0.12) & t.rlike(symbols) | (n >= least) & (clustered > 0.5 * n))


def is_dump_noise(c: Column) -> Column:
    """What a careless scan leaves: fragments, symbols, clusters, odd capitals, too many s, tokens of a letter or two."""
    t = _t(c)
    n = F.length(t)
    alnum, alpha, upper, s = _n(t, r"[\p{L}\p{N}]"), _n(t, r"\p{L}"), _n(t, r"\p{Lu}"), _n(t, "[sS]")
    words, other = _n(t, "[A-Za-z]+(?:'[A-Za-z]+)?"), n - _n(t, r"[\p{L}\p{N}\s]")
    runs = F.aggregate(F.regexp_extract_all(t, F.lit("(?i)[bcdfghjklmnpqrstvwxyz]{6,}"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    tokens = F.filter(F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(w, r"""^["'.,:;!?\-\[\](){}*]+|["'.,:;!?\-\[\](){}*]+$""", "")), lambda w: w.rlike(r"\p{L}"))
    rules = (
        n <= 2, (n == 3) & ~t.rlike(r"^\p{L}"), (n > 8) & (alnum < 0.2 * n), (n > 3) & t.rlike(r"(?U)^[\W_]+$"), runs > 0.35 * n,
        (n > 30) & ~F.contains(t, F.lit(" ")) & t.rlike("[a-z]{3,}[A-Z]{2,}[a-z]{3,}"), (n > 6) & (_n(t, r"[><~=|/_@#^&*]") > 0.4 * n),
        t.rlike(r"(?U)[~`=«»]{3,}|(?:\W\s*){6,}"), (n >= 8) & (words <= 2) & (other > 0.35 * n), (n > 6) & (_n(t, r"[^\x00-\x7f]") > 0.2 * n) & (words < 3),
        (alpha >= 15) & ((upper > 0.55 * alpha) | (s > 0.32 * alpha) | (s > 0.22 * alpha) & (upper > 0.25 * alpha)), (n > 15) & (_n(t, r"([a-zA-Z])\1{2,}") >= 3),
        (n <= 25) & (F.size(tokens) >= 3) & F.forall(tokens, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) <= 2),
    )
    found = F.lit(False)
    for r in rules:
        found = found | r
    return (t != "") & found


def is_publisher(c: Column) -> Column:
    t = _t(c)
    return F.contains(t, F.lit("©")) | t.rlike("[Cc]opyright") | t.rlike(PUBLISHER)


def is_footnote(c: Column) -> Column:
    t = _t(c)
    return t.rlike(r"^\*?\*?\[?\d{1,3}\]?\*?\*?\s") | t.rlike(r"^\d{1,3}[.\s]\s") & (F.length(t) > 20)


def is_timeline(c: Column) -> Column:
    t = _t(c)
    return t.rlike(TIMELINE) | t.rlike(r"(?i)^(?:Unified )?Year\s+\d{3,4}[:\s,.]")


def is_authors_note(c: Column) -> Column:
    """A heading over an afterword or an author's remarks."""
    return F.coalesce(c, F.lit("")).rlike(r"^#+\s+") & _t(c).rlike(AUTHOR)


def is_capitals(c: Column, least: int = 2, most: int | None = None, word: str | None = None) -> Column:
    """More than 85 % capitals among the letters of ASCII, and so many words. word: what counts as one in the line as it is; by default, what
    spaces separate once characters foreign to such headings are left out."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9\s,.:()\-/]", ""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) if word is None else _n(F.coalesce(c, F.lit("")), word)
    return (_n(t, "[A-Za-z]") > 0) & (100 * _n(t, "[A-Z]") > 85 * _n(t, "[A-Za-z]")) & (words >= least if most is None else words <= most)


def is_readable_picture(c: Column) -> Column:
    """Whether text read from a picture is language: enough words and letters; of eight lines or more few may be noise."""
    t = F.coalesce(c, F.lit(""))
    dense = lambda x: F.regexp_replace(x, r"\s", "")
    n, word = F.length(dense(t)), r"[A-Za-z][A-Za-z'’\-]{1,}"
    meaningful = F.size(F.filter(F.regexp_extract_all(t, F.lit(word), F.lit(0)), lambda w: F.length(w) >= 3))
    rows = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: _n(x, word)
    share = lambda x: _n(x, r"\p{L}") / F.greatest(F.length(dense(x)), F.lit(1))
    noisy = F.size(F.filter(rows, lambda x: (words(x) <= 1) | (share(x) < 0.35)))
    good = F.size(F.filter(rows, lambda x: (words(x) >= 3) & (share(x) >= 0.55)))
    many = (F.size(rows) >= 8) & ((noisy >= 0.5 * F.size(rows)) | (good < 0.25 * F.size(rows)))
    return (n > 0) & ~many & ((meaningful >= 3) & (_n(t, r"\p{L}") >= 0.45 * n) | (meaningful >= 6) & (_n(t, r"[\p{L}\p{N}]") >= 0.55 * n))


def is_structured(block: Column) -> Column:
    """Whether a block's line ends matter: mostly short lines of which two or more look like labels, or two with an early colon."""
    rows = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(rows, lambda x: F.length(x) <= 48))
    labels = F.size(F.filter(rows, lambda x: x.rlike(r"^[A-Z][A-Za-z0-9 /&()'’+\-]{0,40}:?$")))
    colons = F.size(F.filter(rows, lambda x: F.contains(F.substring(x, 1, 30), F.lit(":"))))
    return (F.size(rows) >= 2) & ((short >= 0.75 * F.size(rows)) & (labels >= 2) | (colons >= 2))


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1)).isin(*VIDEOS)


def availability(attributes: Column, mask: int = 0x1000 | 0x40000 | 0x400000) -> Column:
    """Whether a file's attributes say that it is elsewhere."""
    return F.when(attributes.bitwiseAND(F.lit(mask)) != 0, "online-only").otherwise("local")


def without_emphasis(c: Column) -> Column:
    """Pairs of `**`, `__`, `*` and `_` that don't stand inside words go."""
    for mark in (r"\*\*", "__", r"\*", "_"):
        c = F.regexp_replace(c, rf"(?U)(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", "$1")
    return c


def spaced_words(c: Column) -> Column:
    """A space behind punctuation that a word touches; contractions that are glued to the next word are cut off."""
    glued = "it's|that's|there's|what's|who's|where's|when's|why's|how's|can't|won't|don't|didn't|doesn't|isn't|aren't|wasn't|weren't|couldn't|wouldn't|shouldn't|i'm|you're|we're|they're|he's|she's|i'll|we'll|they'll|you'll|i've|you've|we've|they've"
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bbird'seye\b", "bird's-eye"), r"(?U)([.,;:!?])(\w)", "$1 $2")
    return F.regexp_replace(c, rf"(?i)\b({glued})([A-Za-z])", "$1 $2")


# Quotes, dashes and spaces that only differ in form.
DOUBLE, SINGLE = "“”„‟❝❞«»", "‘’‚‛`´"
DASHES = {"‐": "-", "‑": "-", "‒": "–", "―": "—"}


def plain_punctuation(c: Column) -> Column:
    """Quotes as ASCII, hyphens, en and em dashes each in one form, an ellipsis as three dots."""
    c = F.translate(c, DOUBLE + SINGLE + "".join(DASHES), '"' * len(DOUBLE) + "'" * len(SINGLE) + "".join(DASHES.values()))
    return F.replace(c, F.lit("…"), F.lit("..."))


def without_soft_hyphens(c: Column) -> Column:
    """Soft hyphens go, and a line's end behind one if a letter follows."""
    return F.replace(F.regexp_replace(c, r"­\n(?=\p{L})", ""), F.lit("­"), F.lit(""))

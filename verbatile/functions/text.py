"""Column functions for text repair. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and their letters; curly quotes, dashes and their plain forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
# Unicode spaces.
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def line_endings(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_invisible(c: Column) -> Column:
    """Format and control characters go, but for newline, carriage return and tab."""
    return F.regexp_replace(c, r"[\p{Cf}\p{Cc}&&[^\n\r\t]]", "")


def plain_spaces(c: Column) -> Column:
    """Unicode spaces become a space."""
    return F.translate(c, SPACES, " " * len(SPACES))


def ligatures(c: Column) -> Column:
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces inside a line become one; indentation stays."""
    return F.regexp_replace(c, r"(?m)(?<=[^ \n]) {2,}", " ")


def dehyphenate(c: Column) -> Column:
    """A word broken by a hyphen at a line's end is joined if it goes on in lower case."""
    return F.regexp_replace(c, r"(\p{L})-\n(\p{Ll})", "$1$2")


def split_boundary(c: Column) -> Column:
    """`noone` and `toone` are two words."""
    return F.regexp_replace(c, r"\b([Nn]o|[Tt]o)one\b", "$1 one")


def alpha_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def is_speakable(c: Column, minimum: int = 4) -> Column:
    return alpha_count(c) >= minimum


def is_stutter(token: Column) -> Column:
    """`W-What`: one or two letters that begin the word behind the hyphen."""
    lead, rest = F.regexp_extract(token, r"^([A-Za-z]{1,2})-([A-Za-z]+)$", 1), F.regexp_extract(token, r"^([A-Za-z]{1,2})-([A-Za-z]+)$", 2)
    return (lead != "") & F.lower(rest).startswith(F.lower(lead))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds rounded half up."""
    ms = F.floor(seconds * 1000 + 0.5).cast("bigint")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def inline_markup(c: Column) -> Column:
    """Line breaks become newlines, underlining and comments go, three newlines or more become two."""
    for pattern, value in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</?u>", ""), (r"(?s)<!--.*?-->", ""), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, value)
    return c


def repeated_letters(c: Column) -> Column:
    """A word of one letter three times or more becomes that letter, but for Roman numerals in capitals."""
    return F.regexp_replace(c, r"\b(?!(?:III|XXX|CCC|MMM)\b)([a-zA-Z])\1{2,}\b", "$1")


def file_title(c: Column) -> Column:
    """A title from a file's name: tags in brackets and characters that file systems refuse go, underscores become spaces."""
    for pattern, value in ((r"\[[^\]]*\]", " "), (r"_", " "), (r'[<>:"/\\|?*]', ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, value)
    return F.trim(c)


def page_ranges(c: Column) -> Column:
    """`1-3,7` as sorted distinct pages from 0."""
    ends = lambda x: F.split(x, "-")
    pages = F.transform(F.split(F.regexp_replace(c, r"\s", ""), ","), lambda x: F.sequence(ends(x)[0].cast("int") - 1, F.element_at(ends(x), -1).cast("int") - 1))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, tenths rounded half up."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        tenths = F.floor((n * 10 + 1024**power // 2) / F.lit(1024**power))
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == "GB" else out.when(n < 1024 ** (power + 1), text)
    return out

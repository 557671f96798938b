"""Repair of converted documents by lines: headings, front matter, metadata, tails, page furniture. Rows are (doc_id, line, text), as
corpus.lines gives them; what is left keeps its line numbers. Null texts count as empty lines, a document without lines has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.functions import headings as H

# What publishers put before a text; a document with two of them there has front matter.
FRONT = (
    r"\bcopyright\b", r"\btable of contents\b|\bcontents\b", r"\bbegin reading\b", r"\byen (?:press|on)\b", r"\bj-novel club\b",
    r"\billustration by\b|\bcover art by\b", r"\btranslation by\b", r"\bisbn\b|\blccn\b|cataloging-in-publication", r"\ball rights reserved\b",
    r"\bscanning, uploading\b|\bdistribution of this book\b", r"\bpublisher\b",
)
# Where a story begins, and labels and lines of metadata.
NARRATIVE = r"^(?:prologue|prelude|introduction|interlude|epilogue|(?:chapter|story|part|book|act|section)\s+(?:\d+|[ivxlcdm]+)\b)"
METADATA = ("copyright", "contents", "table of contents", "title page", "publication information", "publishing information", "library of congress cataloging-in-publication data")
METADATA_LINES = (
    r"^isbn(?:s)?\s*[: ]", r"^lccn\s*[: ]", r"^first\s+(?:ebook|yen on|edition|published)\b", r"^all rights reserved\.?$", r"^©\s*\d{4}\b",
    r"^(?:visit us at\s+)?(?:https?://)?(?:www\.)?\S+\.com\S*$",
)
# A publisher's newsletter, and items of a table of contents behind the text.
NEWSLETTER = r"\bsign\s*up\b.*\bnewsletter\b|\bnewsletter\s+sign\s*up\b|(?:https?://|www\.)?(?:www\.)?yenpress\.com(?:/\S*)?|\byen\s+(?:press\s+)?newsletter\b"
CONTENTS_ITEM = r"^\s*\d+[.)]\s+(?:cover|insert|title\s+page|copyright|chapter\b.*|afterword|appendix\b.*|yen\s+newsletter)\s*$"
PAGE_NUMBER = r"^\s*(?:page\s+)?(?:\d{1,4}|[ivxlcdm]{1,8})\s*$"
STRUCTURE = r"^\s*(?:#|>|[-*+]\s|\d+[.)]\s|```|~~~|\|)"


def _by_line() -> Window:
    return Window.partitionBy("doc_id").orderBy("line")


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + pattern)


def normal_headings(rows: DataFrame) -> DataFrame:
    """Every line in normal form; a heading that only repeats the heading before it (empty lines between don't count) goes."""
    d = rows.withColumn("text", H.normal_heading(F.col("text")))
    filled = F.when(F.trim("text") != "", F.col("text"))
    d = d.withColumn("__v_last", F.last(filled, ignorenulls=True).over(_by_line().rowsBetween(Window.unboundedPreceding, -1)))
    same = F.col("text").startswith("#") & (F.lower("text") == F.lower("__v_last"))
    return d.where(~F.coalesce(same, F.lit(False))).drop("__v_last")


def _plain(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(c, r"(?i)</?u>", "")), r"^[*_`]+|[*_`]+$", "")
    return F.trim(F.regexp_replace(F.trim(t), r"^#{1,6}\s*", ""))


def without_front_matter(rows: DataFrame) -> DataFrame:
    """What stands before the first heading of the story goes if two or more kinds of front matter are in it. A converter's chapter
    mark counts before all other headings; a line that names several chapters, or is very long, is none."""
    named = F.coalesce(H.heading_text(F.col("text")), F.col("text"))
    c = _plain(named)
    numbered = r"\b(?:chapter|story|part|book|act|section)\s+(?:\d+|[ivxlcdm]+)\b"
    titled = has(c, r"^(?:chapter|story|part|book|act|section)\s+(?:\d+|[ivxlcdm]+)\s*[|:\-–—]\s*\S") | has(c, r"^(?:prologue|prelude|introduction|interlude|epilogue)\s*$")
    begins = has(c, NARRATIVE) & (F.regexp_count(c, F.lit("(?i)" + numbered)) <= 1) & (F.length(c) <= 180) & (titled | F.trim("text").rlike(H.ATX))
    d = rows.withColumns({"__v_mark": has(F.col("text"), r"^\s*\[chapter\]\s*\S+"), "__v_begins": begins})
    whole = Window.partitionBy("doc_id")
    d = d.withColumn("__v_first", F.coalesce(F.min(F.when(F.col("__v_mark"), F.col("line"))).over(whole), F.min(F.when(F.col("__v_begins"), F.col("line"))).over(whole)))
    before = F.col("line") < F.col("__v_first")
    kinds = sum((F.max(F.when(before & has(F.col("text"), p), 1).otherwise(0)).over(whole) for p in FRONT), F.lit(0))
    return d.withColumn("__v_kinds", kinds).where(~F.coalesce(before & (F.col("__v_kinds") >= 2), F.lit(False))).drop("__v_mark", "__v_begins", "__v_first", "__v_kinds")


def without_metadata(rows: DataFrame) -> DataFrame:
    """Sections with a label of metadata go, up to the next other heading or the story; lines of metadata go by themselves."""
    heading = H.heading_text(F.col("text"))
    label = F.lower(F.trim(F.regexp_replace(F.coalesce(heading, _plain(F.col("text"))), r"^[ :]+|[ :]+$", "")))
    label = F.regexp_replace(label, r"\s+", " ")
    state = F.when(label.isin(*METADATA), "metadata").when(heading.isNotNull() | has(_plain(F.col("text")), NARRATIVE), "text")
    d = rows.withColumn("__v_state", F.last(state, ignorenulls=True).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)))
    t, alone = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)</?u>", "")), F.lit(False)
    for p in METADATA_LINES:
        alone = alone | has(t, p)
    return d.where(~F.coalesce(F.col("__v_state") == "metadata", F.lit(False)) & ~alone).drop("__v_state")


def without_sections(rows: DataFrame, names: list[str]) -> DataFrame:
    """The sections of the given labels go, each up to the next heading of another section."""
    wanted = [F.lit(n) for n in names]
    heading = H.heading_text(F.col("text"))
    key = F.when(heading.isNotNull(), H.section_key(heading))
    d = rows.withColumn("__v_key", F.last(key, ignorenulls=True).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.exists(F.array(*[H.section_key(w) for w in wanted]), lambda w: w == F.col("__v_key")) if wanted else F.lit(False)
    return d.where(~F.coalesce(hit, F.lit(False))).drop("__v_key")


def without_tail(rows: DataFrame, near: int = 4) -> DataFrame:
    """What a publisher put behind a text goes: from a volume that is coming soon (within near lines) on; from a newsletter, or else from
    the first of two items of a table of contents at most near lines apart, in the last fifth of the lines (or the last 300)."""
    after = _by_line().rowsBetween(0, near)
    soon = F.max(F.when(has(F.col("text"), r"\bcoming\s+soon\b"), 1).otherwise(0)).over(after) == 1
    volume = has(_plain(F.coalesce(H.heading_text(F.col("text")), F.col("text"))), r"^volume\s+\d+\b")
    merged = has(F.col("text"), r"\bvolume\s+\d+\b") & has(F.col("text"), r"\bcoming\s+soon\b")
    whole = Window.partitionBy("doc_id")
    d = rows.withColumns({"__v_n": F.count(F.lit(1)).over(whole), "__v_nth": F.row_number().over(_by_line()) - 1, "__v_volume": volume & soon, "__v_merged": merged, "__v_item": has(F.col("text"), CONTENTS_ITEM)})
    late = F.col("__v_nth") >= F.greatest(F.lit(0), F.col("__v_n") - F.greatest(F.lit(300), F.floor(F.col("__v_n") / 5)))
    item = F.when(late & F.col("__v_item"), F.col("line"))
    d = d.withColumn("__v_next", F.min(item).over(_by_line().rowsBetween(1, Window.unboundedFollowing)))
    first = lambda c: F.min(F.when(c, F.col("line"))).over(whole)
    d = d.withColumns({
        "__v_a": F.coalesce(first(F.col("__v_volume")), first(F.col("__v_merged"))), "__v_b": first(late & has(F.col("text"), NEWSLETTER)),
        "__v_c": first(late & F.col("__v_item") & (F.col("__v_next") - F.col("line") <= near)),
    })
    cut = F.least(F.coalesce("__v_a", F.lit(2**62)), F.coalesce("__v_b", "__v_c", F.lit(2**62)))
    return d.where(F.col("line") < cut).drop(*[c for c in d.columns if c.startswith("__v_")])


def page_furniture(rows: DataFrame, occurrences: int = 3, gap: int = 12, longest: int = 80) -> DataFrame:
    """doc_id, artifact, kind, n, first: running heads (2 to 12 words, in any case and spacing, no sentence's end) and page numbers that
    come back at least so often, never closer than gap lines."""
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    d = rows.select("doc_id", "line", t.alias("t")).where((F.col("t") != "") & (F.length("t") <= longest) & ~F.col("t").rlike(STRUCTURE))
    number = has(F.col("t"), PAGE_NUMBER)
    d = d.select("doc_id", "line", "t", F.when(number, "").otherwise(F.lower("t")).alias("key")).where(number | ~F.col("t").rlike("[.!?…:;]$"))
    d = d.withColumn("apart", F.col("line") - F.lag("line").over(Window.partitionBy("doc_id", "key").orderBy("line")))
    found = d.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("least"), F.min(F.struct("line", "t")).alias("head")).where((F.col("n") >= occurrences) & (F.col("least") >= gap))
    found = found.where((F.col("key") == "") | F.regexp_count(F.col("head.t"), F.lit("[A-Za-z]+")).between(2, 12))
    return found.select("doc_id", F.col("head.t").alias("artifact"), F.when(F.col("key") == "", "page number").otherwise("running head").alias("kind"), "n", F.col("head.line").alias("first"))

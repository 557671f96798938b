"""Column functions for dates, durations, labels and counters as reports show them. All stay in the JVM.

Null in, null out, unless a function names a default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counters of a usage record.
USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
# What a request may begin with that says nothing.
LEAD_INS = ("please ", "can you ", "could you ", "would you ", "i want you to ", "i need you to ")


def short_number(n: Column) -> Column:
    """1.23B, 1.23M, 1.2K or 123; null counts as 0."""
    x = F.coalesce(n.cast("double"), F.lit(0.0))
    size = F.abs(x)
    return (
        F.when(size >= 1e9, F.format_string("%.2fB", x / 1e9)).when(size >= 1e6, F.format_string("%.2fM", x / 1e6))
        .when(size >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x))
    )


def percent(x: Column) -> Column:
    """12.3%, a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.1f%%", x * 100))


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends; null where nothing is left."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(t != "", t)


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, the last of them an ellipsis where some were left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def prompt_title(text: Column, most: int = 90) -> Column:
    """A request's first sentence without its polite lead-in; a sentence ends behind its 16th character at the earliest."""
    t = collapsed(text)
    lead = F.coalesce(*[F.when(F.lower(t).startswith(p), F.lit(len(p))) for p in LEAD_INS], F.lit(0))
    t = F.trim(F.substring(t, lead + 1, F.length(t)))
    stops = F.array_compact(F.array(*[F.nullif(F.when(F.locate(s, t) > 16, F.locate(s, t)), F.lit(0)) for s in (". ", "? ", "! ")]))
    t = F.when(F.size(stops) > 0, F.substring(t, F.lit(1), F.array_min(stops))).otherwise(t)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def prompt_preview(text: Column, most: int = 500) -> Column:
    return F.substring(collapsed(text), 1, most)


def project_of(path: Column) -> Column:
    """A path's last part; `(unknown)` for null and empty ones."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+$", "")
    return F.when(p == "", "(unknown)").otherwise(F.regexp_extract(p, r"([^/\\]*)$", 1))


def iso_millis(ms: Column) -> Column:
    """Milliseconds since 1970 as an ISO time in UTC; seconds have a fraction only where there is one."""
    whole = F.floor(ms / 1000).cast("bigint")
    day = F.date_format(F.timestamp_add("SECOND", whole, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    return F.concat(day, F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("000"))), F.lit("Z"))


def micros(iso: Column) -> Column:
    """Microseconds since 1970 of an ISO time with an offset or Z; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00")))


def seconds_between(a: Column, b: Column) -> Column:
    """From a to b, 0 if b is earlier, null if either is no time."""
    apart = (micros(b) - micros(a)) / 1e6
    return F.when(apart.isNotNull(), F.greatest(F.lit(0.0), apart))


def has_offset(iso: Column) -> Column:
    """Whether an ISO time can be read and says its offset."""
    return F.coalesce(iso.rlike(r"(Z|[+-]\d\d:\d\d)$") & micros(iso).isNotNull(), F.lit(False))


def shown_time(ts: Column, zone: str) -> Column:
    """A UTC time (without zone) as `Jan 05 14:30` in a zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "MMM dd HH:mm")


def task_label(title: Column, shown: Column, project: Column, number: Column, session: Column) -> Column:
    """The title, or else time, project, number and the session's last six characters."""
    own = F.trim(F.coalesce(title, F.lit("")))
    parts = F.concat_ws(" · ", shown, project, F.concat(F.lit("Task "), number.cast("string")), F.right(session, F.lit(6)))
    return F.when(own != "", own).otherwise(parts)


def clock(seconds: Column) -> Column:
    """h:mm:ss, fractions left out."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def spoken_duration(seconds: Column) -> Column:
    """250 ms, 12.5 s, 3.2 m or 1.5 h."""
    return (
        F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).when(seconds < 60, F.format_string("%.1f s", seconds))
        .when(seconds < 3600, F.format_string("%.1f m", seconds / 60)).otherwise(F.format_string("%.1f h", seconds / 3600))
    )


def size_of_stream(bits_per_second: Column, seconds: Column) -> Column:
    """Bytes of a stream."""
    return F.floor(bits_per_second * seconds / 8).cast("bigint")


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds rounded half up."""
    ms = F.floor(seconds * 1000 + 0.5).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc, hundredths rounded half up."""
    c = F.floor(seconds * 100 + 0.5).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def usage_counters(record: Column) -> Column:
    """The counters of a JSON record as a struct; what is missing, no number or negative is 0."""
    one = lambda k: F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.get_json_object(record, f"$.{k}").try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.struct(*[one(k).alias(k) for k in USAGE])


def portable_path(path: Column, root: Column) -> Column:
    """A path below a root with forward slashes; only its name if it is not below it."""
    p, r = F.regexp_replace(path, r"\\", "/"), F.regexp_replace(F.regexp_replace(root, r"\\", "/"), "/+$", "")
    below = F.startswith(p, F.concat(r, F.lit("/")))
    return F.when(below, F.substring(p, F.length(r) + 2, F.length(p))).otherwise(F.regexp_extract(p, "([^/]*)$", 1))

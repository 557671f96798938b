"""Column functions that judge subtitle and translation text. All stay in the JVM; null text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[぀-ヿ㐀-鿿가-힯]"
NUMBER = r"\d+(?:[.,]\d+)*"
CLAUSE = r"[.!?。！？؟।…,;:،؛，；：]+"

# English names of numbers.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
ROMAN = "i ii iii iv v vi vii viii ix x".split()

# Words that negate.
NEGATIONS = "no not never neither nobody nothing nowhere can't cannot won't isn't aren't wasn't weren't don't doesn't didn't".split()

# What a model says instead of a translation.
CHATTER = (
    "current:", "previous context", "following context", "translation:", "here's the", "here is the", "this translation", "source text",
    "i can't provide", "i cannot provide", "could you please provide", "if you have any other questions", "need assistance with another topic",
    "please provide", "current dialogue", "how can i assist", "if you need any more", "no translation needed", "next part of the conversation",
    "for translation into english",
)

# Other names of languages.
LANGUAGES = {
    "english": "en", "eng": "en", "japanese": "ja", "jpn": "ja", "jp": "ja", "korean": "ko", "kor": "ko", "kr": "ko", "chinese": "zh",
    "mandarin": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "cn": "zh", "german": "de", "deu": "de", "ger": "de", "french": "fr", "fra": "fr",
    "fre": "fr", "spanish": "es", "spa": "es",
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Text without white space."""
    return F.regexp_replace(_text(c), r"(?U)\s+", "")


def word_key(c: Column) -> Column:
    """Letters, digits and underscores in lower case, nothing else: how texts are compared."""
    return F.lower(F.regexp_replace(_text(c), r"(?U)\W+", ""))


def phrase_key(c: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " ")))


def spaced_key(c: Column) -> Column:
    """What is no letter or digit becomes one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(_text(c), r"(?U)\W+", " ")))


def _wrapped(line: Column, width: int) -> Column:
    """Lines that a line's words take, 10^9 if a word is wider than a line."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("now"), F.lit(False).alias("wide"))

    def add(a, w):
        n = F.length(w)
        longer = F.when(a["now"] == 0, n).otherwise(a["now"] + 1 + n)
        over = longer > width
        return F.struct((a["done"] + F.when(over, 1).otherwise(0)).alias("done"), F.when(over, n).otherwise(longer).alias("now"), (a["wide"] | (n > width)).alias("wide"))

    return F.aggregate(words, zero, add, lambda a: F.when(a["wide"], F.lit(10**9)).otherwise(a["done"] + F.when(a["now"] > 0, 1).otherwise(0)))


def line_count(c: Column, width: int = 42) -> Column:
    """Lines that a text needs if Latin words aren't broken; CJK lines may be broken anywhere."""
    lines = F.split(F.regexp_replace(_text(c), "\n$", ""), "\n")
    dense = lambda x: x.rlike(CJK) & ~x.rlike("[A-Za-z0-9]")
    need = lambda x: F.when(F.length(x) <= width, 1).when(dense(x), F.ceil(F.length(x) / width).cast("int")).otherwise(_wrapped(x, width))
    return F.least(F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + need(x)), F.lit(10**9))


def malformed(c: Column) -> Column:
    """Reasons why a cue's text is corrupt or incomplete."""
    t = _text(c)
    count = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    pairs = (("(", ")", "parentheses"), ("[", "]", "brackets"), ("{", "}", "braces"))
    return F.array_compact(F.array(
        F.when(t.rlike(r"[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "invalid_character"),
        F.when(t.rlike(r"[ \t]{2,}") | t.rlike(r"(?U)^\s|\s$"), "bad_whitespace"),
        F.when(t.rlike("[,;:،؛、，；：—-][\"'”’»）】]*$"), "incomplete_ending"),
        *[F.when(count(a) != count(b), f"unbalanced_{name}") for a, b, name in pairs],
    ))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(NUMBER), F.lit(0))


def english_number(n: Column) -> Column:
    """A number from 0 to 999 in words, null beyond."""
    word = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    small = lambda x: F.when(x < 20, word(ONES, x)).otherwise(F.concat(word(TENS, F.floor(x / 10) - 2), F.when(x % 10 == 0, "").otherwise(F.concat(F.lit(" "), word(ONES, x % 10)))))
    hundreds = F.concat(word(ONES, F.floor(n / 100)), F.lit(" hundred"), F.when(n % 100 == 0, "").otherwise(F.concat(F.lit(" "), small(n % 100))))
    return F.when(n < 0, None).when(n < 100, small(n)).when(n < 1000, hundreds)


def keeps_number(number: Column, source: Column, target: Column) -> Column:
    """Whether a numeral of the source is in the target, as digits, in words, as an ordinal up to 20 or a Roman one up to 10; 100 of
    ten thousands is also a million."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(_text(target)), "[^a-z]+", " ")), F.lit(" "))
    n = F.when(number.rlike(r"^\d+$"), number.try_cast("bigint"))
    nth = lambda words: F.get(F.array(*map(F.lit, words)), F.when((n >= 1) & (n <= len(words)), n - 1).cast("int"))
    million = F.when((n == 100) & F.regexp_like(_text(source), F.concat(number, F.lit(r"\s*[만万]"))), "million")
    said = lambda w: F.coalesce(F.contains(plain, F.concat(F.lit(" "), w, F.lit(" "))), F.lit(False))
    return F.array_contains(numbers(target), number) | said(english_number(n)) | said(nth(ORDINALS)) | said(nth(ROMAN)) | said(million)


def integrity_issues(source: Column, target: Column, least: float = 0.15, most: float = 6.0) -> Column:
    """Faults of a translation that can be told without reading it: empty, numbers lost, far too short or long, clauses repeated."""
    s, t = F.trim(_text(source)), F.trim(_text(target))
    n = F.length(squeezed(s))
    ratio = F.length(squeezed(t)) / F.greatest(n, F.lit(1))
    limit = F.when(n <= 4, 30.0).when(n <= 8, 15.0).when(s.rlike(CJK) & (n <= 12), 12.0).otherwise(most)
    repeated = t.rlike(r"(?i)(.{2,}?)(?:\s*[,;.!?]\s*\1){2,}") & ~s.rlike(r"(?i)(.{1,}?)(?:\s*[,;.!?、，]\s*\1){2,}")
    found = F.array_compact(F.array(
        F.when(F.exists(numbers(s), lambda x: ~keeps_number(x, s, t)), "number_mismatch"), F.when(ratio < least, "translation_too_short"),
        F.when(ratio > limit, "translation_too_long"), F.when(repeated, "repeated_translation_clause"),
    ))
    return F.when(t == "", F.array(F.lit("empty_translation"))).otherwise(found)


def clauses(c: Column) -> Column:
    return F.filter(F.transform(F.split(_text(c), CLAUSE), lambda x: F.trim(x)), lambda x: x != "")


def coverage_issues(source: Column, target: Column) -> Column:
    """Clauses of the source that the target has too few for, and its Latin identifiers that the target lacks."""
    a, b = F.size(clauses(source)), F.size(clauses(target))
    found = F.regexp_extract_all(_text(source), F.lit(r"(?U)(?<!\w)(?:[A-Za-z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)*)(?!\w)"), F.lit(0))
    folded = F.lower(_text(target))
    has = lambda x: F.regexp_like(folded, F.concat(F.lit(r"(?<![a-z0-9])\Q"), x, F.lit(r"\E(?![a-z0-9])")))
    lost = F.exists(F.transform(found, lambda x: F.lower(x)), lambda x: ~has(x))
    return F.array_compact(F.array(F.when((a > 1) & (b < a), "source_clause_omission"), F.when(lost, "source_identifier_omission")))


def negates(c: Column) -> Column:
    return _text(c).rlike(r"(?i)\b(?:" + "|".join(NEGATIONS) + r")\b")


def agreement_issues(source: Column, primary: Column, other: Column, primary_likeness: Column, other_likeness: Column, likeness: Column, least: float = 0.72, evidence: float = 0.20) -> Column:
    """Why two translations of a source need another look. The likenesses are of source and each one, and of the two."""
    same = F.lower(F.trim(_text(primary))) == F.lower(F.trim(_text(other)))
    sets = lambda c: F.array_sort(F.array_distinct(numbers(c)))
    return F.array_compact(F.array(
        F.when(likeness < least, "semantic_disagreement"), F.when(sets(primary) != sets(other), "number_disagreement"),
        F.when(negates(primary) != negates(other), "polarity_disagreement"),
        F.when(same & (F.greatest(primary_likeness, other_likeness) < evidence), "low_evidence_consensus"),
        F.when(F.size(integrity_issues(source, other)) > 0, "independent_integrity_failure"),
    ))


def speech_suspicions(speech: Column, text: Column, likeness: Column, least: float = 0.72) -> Column:
    """Whether what was said and what is shown differ: in sense, in numbers or in negation."""
    sets = lambda c: F.array_sort(F.array_distinct(numbers(c)))
    return (likeness < least) | (sets(speech) != sets(text)) | (negates(speech) != negates(text))


def unwrapped(answer: Column) -> Column:
    """A model's answer without code fence, label and quotes."""
    t = F.trim(_text(answer))
    t = F.when(t.rlike(r"(?s)^```.*```$"), F.trim(F.regexp_replace(t, r"^```(?:\w+)?\s*|\s*```$", ""))).otherwise(t)
    t = F.trim(F.regexp_replace(t, r"(?i)^\s*(?:translation|translated\s+(?:text|dialogue)|answer)\s*:\s*", ""))
    first = F.substring(t, 1, 1)
    quoted = (F.length(t) >= 2) & (first == F.right(t, F.lit(1))) & first.isin('"', "'", "“", "”")
    return F.when(quoted, F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def is_response(answer: Column, current: Column, context: Column, language: str) -> Column:
    """Whether an answer can be a translation: not empty, not too long, no talk about the task, nothing of the context (an array of
    neighbouring lines), few CJK letters if it should be English, two lines at most."""
    t = F.trim(_text(answer))
    talk = F.lit(False)
    for phrase in CHATTER:
        talk = talk | F.lower(t).rlike(r"(?<![a-z])\Q" + phrase + r"\E")
    leaks = F.exists(F.coalesce(context, F.array().cast("array<string>")), lambda x: (F.trim(x) != "") & F.contains(t, F.trim(x)))
    cjk, letters = F.regexp_count(t, F.lit(CJK)), F.regexp_count(t, F.lit("[A-Za-z]|" + CJK))
    foreign = (cjk > 0.25 * letters) if language.lower() in ("en", "eng", "english") else F.lit(False)
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    return (t != "") & (F.length(t) <= F.greatest(F.lit(120), F.length(_text(current)) * 6)) & ~talk & ~leaks & ~foreign & (lines <= 2)


def joined_tokens(tokens: Column) -> Column:
    """Tokens with leading spaces run together, CJK ones without spaces, others with one space between them."""
    whole, parts = F.array_join(tokens, ""), F.array_join(F.transform(tokens, lambda x: F.trim(x)), " ")
    led = F.exists(tokens, lambda x: x.rlike(r"^\s"))
    return F.trim(F.when(led | whole.rlike(CJK) & ~whole.rlike("[A-Za-z0-9]"), whole).otherwise(parts))


def language_tag(c: Column) -> Column:
    """The base tag of a language's name or tag in lower case; null stays."""
    base = F.split(F.lower(F.trim(c)), "[-_]")[0]
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, base), base)


def is_confident(text: Column, logprob: Column, no_speech: Column, compression: Column, least: float = -1.0, most: float = 0.6) -> Column:
    """Whether a recogniser's segment is likely speech; null evidence is none."""
    return (F.trim(_text(text)) != "") & (F.coalesce(logprob, F.lit(-99.0)) >= least) & (F.coalesce(no_speech, F.lit(1.0)) <= most) & (F.coalesce(compression, F.lit(99.0)) <= 2.4)


def lacking_terms(text: Column, required: Column, forbidden: Column) -> Column:
    """Terms (arrays) that a text should have and hasn't, then those that it shouldn't have and has, as `missing:x` and `forbidden:x`."""
    t, none = phrase_key(text), F.array().cast("array<string>")
    has = lambda x: F.contains(t, phrase_key(x))
    lost = F.transform(F.filter(F.coalesce(required, none), lambda x: ~has(x)), lambda x: F.concat(F.lit("missing:"), x))
    return F.concat(lost, F.transform(F.filter(F.coalesce(forbidden, none), has), lambda x: F.concat(F.lit("forbidden:"), x)))


def attempt_score(time: Column, turn: Column, event: Column, issues: Column) -> Column:
    """How good an attempt at subtitles is: coverage of time, turns and events, less its issues."""
    return 4 * time + 2 * turn + event - 0.001 * issues


def bounded_offset(seconds: Column, most: float) -> Column:
    return F.greatest(F.least(seconds, F.lit(most)), F.lit(-most))


def with_provenance(history: Column, stage: str, method: str) -> Column:
    """A history (array of stage and method) with one more entry; null is no history."""
    kind = "array<struct<stage:string,method:string>>"
    return F.array_append(F.coalesce(history, F.array().cast(kind)), F.struct(F.lit(stage).alias("stage"), F.lit(method).alias("method")))


def ordered_union(a: Column, b: Column) -> Column:
    """The elements of two arrays once each, in order of appearance."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))

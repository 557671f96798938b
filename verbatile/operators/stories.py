"""Stories: sections, sentences, entities, voices and references. Entities are few, texts are many: entities are broadcast where a
scan needs them all, after a check of their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.operators.records import few

def section_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, section_id, level, title, start, end (places in the text), sha256 of each Markdown section, from one heading to the next; a
    document without headings is one section of level 0, what stands before the first heading is in none."""
    text = F.replace(F.replace(F.coalesce(text_col, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(text, "\n")
    # Where each line begins: the lengths of those before it and their line feeds.
    starts = F.aggregate(lines, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x) + 1))
    d = documents.select(id_col, text.alias("text"), F.arrays_zip(lines.alias("line"), starts.alias("start")).alias("rows"))
    mark = r"^(#{1,6})\s+(\S.*?)\s*#*\s*$"
    heads = F.filter("rows", lambda r: r["line"].rlike(mark))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("start")))
    d = d.select(id_col, "text", F.posexplode(F.when(F.size(heads) > 0, heads).otherwise(whole)).alias("nth", "head"))
    after = F.lead("head.start").over(Window.partitionBy(id_col).orderBy("nth"))
    d = d.select(id_col, "nth", "head", "text", F.coalesce(after, F.length("text")).alias("end"))
    part = F.substring(F.col("text"), F.col("head.start") + 1, F.col("end") - F.col("head.start"))
    title = F.when(F.col("head.line").isNotNull(), F.regexp_extract("head.line", mark, 2))
    return d.select(id_col, F.format_string("sec-%04d", F.col("nth") + 1).alias("section_id"), F.coalesce(F.length(F.regexp_extract("head.line", mark, 1)), F.lit(0)).alias("level"), title.alias("title"), F.col("head.start").alias("start"), "end", F.sha2(part, 256).alias("sha256"))


def _whole(alias: Column) -> Column:
    return F.concat(F.lit(r"(?i)\b\Q"), alias, F.lit(r"\E\b"))


def present(texts: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, entities: the entities any of whose aliases (entity, alias) a text holds, in any case."""
    met = texts.join(few(aliases.where("trim(alias) <> ''")), F.contains(F.lower(text_col), F.lower("alias")))
    return met.groupBy(id_col).agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def mentions(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: int = 5) -> DataFrame:
    """id_col, name, n, places: how often a text has each name as a whole word, in any case, and where the first ones begin."""
    met = texts.join(few(names.select("name").where("trim(name) <> ''").distinct()), F.contains(F.lower(text_col), F.lower("name")))
    cut = F.split(F.col(text_col), F.concat(F.lit(r"(?i)(?=\b\Q"), F.col("name"), F.lit(r"\E\b)")), -1)
    pieces = F.filter(cut, lambda x: x.isNotNull())
    # Pieces begin at the mentions, all but a first one that doesn't; their lengths tell the places.
    begins = F.aggregate(pieces, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x)))
    marked = F.filter(F.arrays_zip(pieces.alias("p"), begins.alias("at")), lambda r: F.regexp_like(r["p"], F.concat(F.lit(r"(?i)^\Q"), F.col("name"), F.lit(r"\E\b"))))
    d = met.select(id_col, "name", marked.alias("m")).where(F.size("m") > 0)
    return d.select(id_col, "name", F.size("m").cast("bigint").alias("n"), F.slice(F.col("m")["at"], 1, evidence).alias("places"))


def in_context(texts: DataFrame, aliases: DataFrame, around: int = 500, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, entity, passages: the first distinct passages of so many characters around mentions of an entity's aliases of three
    letters or more, white space collapsed."""
    long_ = aliases.where(F.length(F.trim("alias")) >= 3).select("entity", F.col("alias").alias("name")).distinct()
    found = mentions(texts, long_.select("name"), id_col, text_col, 2**31 - 1).join(long_, "name").select(id_col, "entity", "name", F.explode("places").alias("at"))
    lo = F.greatest(F.lit(0), F.col("at") - around)
    passage = F.substring(F.col(text_col), lo + 1, F.col("at") + F.length("name") + around - lo)
    d = found.join(texts.select(id_col, text_col), id_col).select(id_col, "entity", "at", F.trim(F.regexp_replace(passage, r"\s+", " ")).alias("passage"))
    first = d.groupBy(id_col, "entity", "passage").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy(id_col, "entity").orderBy("at", "passage"))
    kept = first.withColumn("nth", nth).where(F.col("nth") <= most)
    return kept.groupBy(id_col, "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "passage"))), lambda x: x["passage"]).alias("passages"))


# Names that are none, and words that tell what a name is.
NO_NAMES = ("an", "because", "closing the", "however", "instead", "my", "no", "once", "one", "taking", "we", "whether")


def entity_kind(name: Column, text: Column) -> Column:
    """location, concept, organization or character, by the name and the words beside it; null for words that are no names."""
    low = F.lower(name)
    beside = lambda before, after: F.regexp_like(text, F.concat(F.lit("(?i)" + before), F.lit(r"\Q"), name, F.lit(r"\E" + after)))
    organized = beside(r"\b", r"\s+(?:guild|council|army|academy|church)\b") | beside(r"\b", r"\b") & low.rlike("guild|council|academy")
    place = beside(r"(?:continent|kingdom|forest|city|town|village|region|homeland)\s+(?:of|called)\s+", r"\b") | beside(r"\b", r"\b\s+(?:continent|kingdom|city|town|village|forest|glades|hall)\b") | beside(r"\b(?:in|on|from|near|toward|across)\s+(?:the\s+)?", r"\b")
    return F.when(low.isin(*NO_NAMES), None).when(low.rlike("glades|hall") | (low == "earth"), "location").when(low.endswith("ing") | (low == "dwarven"), "concept").when(organized, "organization").when(place, "location").otherwise("character")


def slug(c: Column, fallback: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", fallback).otherwise(s)


def first_words(c: Column, most: int) -> Column:
    """The first words of a prompt, semicolons as commas, without punctuation at the end."""
    words = F.slice(F.filter(F.split(F.replace(c, F.lit(";"), F.lit(",")), r"\s+"), lambda w: w != ""), 1, most)
    return F.regexp_replace(F.array_join(words, " "), "[.,:;]+$", "")


def token_estimate(c: Column) -> Column:
    """Words and symbols."""
    return F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]"))


PRONOUNS = r"(?i)\b(?:he|him|his|she|her|hers|they|them|their)\b"
FIRST = r"(?i)\b(?:I|me|my|mine)\b"


def carried_entities(sentences: DataFrame, key: str, order: str, viewpoint: str | None = None) -> DataFrame:
    """sentences (key, order, text, entities: those that it names) with resolved: pronouns of the third person stand for the entities that
    were named last, the first person for the viewpoint; a sentence without names or pronouns ends what can be meant."""
    none = F.array().cast("array<string>")
    named, third, own = F.coalesce("entities", none), F.col("text").rlike(PRONOUNS), F.col("text").rlike(FIRST)
    d = sentences.withColumns({"__v_named": named, "__v_third": third, "__v_own": own})
    # What is remembered after a sentence: its names; the viewpoint, if it only has that; nothing if it is neutral; else what was before.
    seen_own = F.col("__v_own") if viewpoint else F.lit(False)
    state = F.when(F.size("__v_named") > 0, F.col("__v_named")).when(seen_own & ~F.col("__v_third"), F.array(F.lit(viewpoint or ""))).when(~F.col("__v_own") & ~F.col("__v_third"), none)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__v_last", F.coalesce(F.last(state, ignorenulls=True).over(before), none))
    local = F.when(seen_own, F.array_union(F.array(F.lit(viewpoint or "")), F.col("__v_named"))).otherwise(F.col("__v_named"))
    out = F.when(F.col("__v_third") & (F.size("__v_last") > 0), F.array_distinct(F.concat("__v_last", local))).otherwise(local)
    return d.withColumn("resolved", out).drop("__v_named", "__v_third", "__v_own", "__v_last")


def referenced(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """wanted (canonical_id, name, style, profile) with found (the catalog's id) and state: by id, else by name in any case; `skipped` where
    style or profile differ, `changed` where the file's digest isn't the one on record, `missing` without an entry."""
    c = catalog.select(*[F.col(x).alias("__c_" + x) for x in ("canonical_id", "name", "style", "profile", "sha256", "recorded")])
    by_id = wanted.join(c, F.col("canonical_id") == F.col("__c_canonical_id"), "left")
    found, rest = by_id.where("__c_canonical_id IS NOT NULL"), by_id.where("__c_canonical_id IS NULL").select(*wanted.columns)
    named = c.withColumn("__v_nth", F.row_number().over(Window.partitionBy(F.lower("__c_name")).orderBy("__c_canonical_id"))).where("__v_nth = 1").drop("__v_nth")
    d = found.unionByName(rest.join(named, F.lower("name") == F.lower("__c_name"), "left"))
    differs = ~F.col("style").eqNullSafe(F.col("__c_style")) | ~F.col("profile").eqNullSafe(F.col("__c_profile"))
    state = F.when(F.col("__c_canonical_id").isNull(), "missing").when(differs, "skipped").when(~F.col("__c_sha256").eqNullSafe(F.col("__c_recorded")), "changed").otherwise("used")
    return d.select(*wanted.columns, F.col("__c_canonical_id").alias("found"), state.alias("state"))


def decided_entities(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """entities (entity_id, name) with canonical_id and aliases (sorted, the name among them) of the decisions (entity_id, canonical_id,
    aliases). Decisions must be for exactly these entities, one each, with canonical ids of their own."""
    ids, told = entities.select("entity_id"), decisions.select("entity_id")
    faults = {
        "undecided": ids.join(told, "entity_id", "left_anti"), "unknown": told.join(ids, "entity_id", "left_anti"), "decided twice": told.groupBy("entity_id").count().where("count > 1"),
        "one canonical id": decisions.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id")).where("n > 1"),
    }
    for fault, d in faults.items():
        row = d.head(1)
        if row:
            raise ValueError(f"{fault}: {row[0].entity_id}")
    names = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))))
    return entities.join(decisions, "entity_id").select(*entities.columns, "canonical_id", names.alias("aliases"))


def cue_voices(cues: DataFrame, speakers: DataFrame) -> DataFrame:
    """cues (id, speaker, metadata map) with voice: that of the metadata, else the speaker's (speaker, voice); cues with neither are an
    error."""
    d = cues.join(speakers.select("speaker", F.col("voice").alias("__v_voice")), "speaker", "left").withColumn("voice", F.coalesce(F.try_element_at("metadata", F.lit("voice")), "__v_voice")).drop("__v_voice")
    without = d.where("voice IS NULL").head(1)
    if without:
        raise ValueError(f"no voice: {without[0].id}")
    return d


def adapted_issues(source: Column, adapted: Column, entities: Column, known: Column, least: float = 0.5, most: float = 1.5) -> Column:
    """Faults of an adapted text: empty, numbers or entities (arrays) that the source lacks, too short or long."""
    digits = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    ratio = F.length(F.trim(F.coalesce(adapted, F.lit("")))) / F.greatest(F.length(F.trim(F.coalesce(source, F.lit("")))), F.lit(1))
    return F.array_compact(F.array(
        F.when(F.trim(F.coalesce(adapted, F.lit(""))) == "", "empty"), F.when(F.size(F.array_except(digits(adapted), digits(source))) > 0, "unsupported_number"),
        F.when(F.size(F.array_except(entities, known)) > 0, "unsupported_entity"), F.when(ratio < least, "too_short"), F.when(ratio > most, "too_long"),
    ))


def dealt_voices(speakers: DataFrame, voices: DataFrame, by: str) -> DataFrame:
    """speakers (by, speaker, style) with voice of voices (voice, style), in order of speaker: an unused voice of the style, else an unused
    one, else those of the style (or all) in turn. A medium has few speakers, so one is dealt at a time."""
    import pandas as pd

    rows = [(r.voice, r.style) for r in few(voices).orderBy("voice").collect()]

    def deal(d: pd.DataFrame) -> pd.DataFrame:
        used: list[str] = []
        out = []
        for style in d.sort_values("speaker")["style"]:
            fitting = [v for v, s in rows if s == style]
            free = [v for v in fitting if v not in used] or [v for v, _ in rows if v not in used]
            again = fitting or [v for v, _ in rows]
            pick = free[0] if free else min(again, key=lambda v: (used.count(v), v)) if again else None
            used.append(pick)
            out.append(pick)
        return d.sort_values("speaker").assign(voice=out)

    d = speakers.select(by, "speaker", "style")
    return d.groupBy(by).applyInPandas(deal, f"`{by}` {d.schema[by].dataType.simpleString()}, speaker string, style string, voice string")


def review_decisions(groups: DataFrame, decisions: DataFrame, inputs: list[str]) -> DataFrame:
    """groups (group_id and inputs) with verdict of the decisions (group_id, verdict, approval_key): `stale` where the key isn't the digest of
    the inputs as they are now, `open` without a decision."""
    key = F.sha2(F.concat_ws("\u0001", "group_id", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in inputs]), 256)
    d = groups.withColumn("approval_key", key).join(decisions.select("group_id", F.col("verdict").alias("__v_verdict"), F.col("approval_key").alias("__v_key")), "group_id", "left")
    verdict = F.when(F.col("__v_verdict").isNull(), "open").when(F.col("__v_key") == F.col("approval_key"), F.col("__v_verdict")).otherwise("stale")
    return d.withColumn("verdict", verdict).drop("__v_verdict", "__v_key")

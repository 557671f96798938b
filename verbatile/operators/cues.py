"""Joins and checks of timed cues: recovery of what they miss, coverage, votes, voices, documents of cues.

Cues are rows (key, an id, start, end in seconds). Rows whose start or end is null are left out of joins; a null key joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.functions import subtitles
from verbatile.operators import intervals


def recovery_regions(turns: DataFrame, cues: DataFrame, key: str, least: float = 0.25, gap: float = 0.0) -> DataFrame:
    """Stretches of speech (key, start, end) of at least so many seconds that no cue holds, merged where they are gap apart."""
    left = intervals.difference(turns.select(key, "start", "end"), cues.select(key, "start", "end"), key)
    return intervals.union(left.where(F.col("end") - F.col("start") >= least), key, gap)


def _covered(events: DataFrame, cues: DataFrame, key: str, width: float, margin: float) -> DataFrame:
    """lid of each event (key, lid, start, end) with overlap: summed over the cues; held: its middle is in a cue or margin from one."""
    right = cues.select(key, F.monotonically_increasing_id().alias("rid"), "start", "end")
    sums = intervals.overlaps(events.select(key, "lid", "start", "end"), right, key, width).groupBy("lid").agg(F.sum("overlap").alias("overlap"))
    middle = events.select(key, "lid", ((F.col("start") + F.col("end")) / 2).alias("at"))
    wide = right.select(key, "rid", (F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    held = intervals.containing(middle, wide, key, width).select("lid", F.lit(True).alias("held"))
    return events.join(sums, "lid", "left").join(held, "lid", "left").withColumns({"overlap": F.coalesce("overlap", F.lit(0.0)), "held": F.coalesce("held", F.lit(False))})


def uncovered_words(words: DataFrame, cues: DataFrame, key: str, width: float = 60.0, least: float = 0.03, margin: float = 0.1, shortest: float = 0.12) -> DataFrame:
    """Words (key, lid, start, end, word) that the cues miss: hardly any overlap, and the middle not near a cue. They last at least
    shortest."""
    d = _covered(words, cues, key, width, margin).where((F.col("overlap") < least) & ~F.col("held"))
    return d.select(key, "lid", "start", F.greatest("end", F.col("start") + shortest).alias("end"), "word")


def recovered_groups(words: DataFrame, cues: DataFrame, key: str, gap: float = 0.8) -> DataFrame:
    """Missed words (key, lid, start, end, word) as cues (key, start, end, text): one goes on where no more than gap and no cue lies
    between. Both sides are sorted together, so no words and cues are paired."""
    told = lambda d, side, *more: d.select(key, "start", "end", F.lit(side).alias("side"), *more)
    both = told(words, 1, "lid", "word").unionByName(told(cues, 0, F.lit(None).cast("bigint").alias("lid"), F.lit(None).cast("string").alias("word")))
    # A cue that begins before a word and ends behind the last word before it stands between them. Its end is the latest one of
    # the cues that begin before the word; words don't overlap cues, so the latest end decides.
    ahead = Window.partitionBy(key).orderBy("start", "side", "lid").rowsBetween(Window.unboundedPreceding, -1)
    d = both.withColumn("reach", F.max(F.when((F.col("side") == 0), F.col("end"))).over(ahead)).where("side = 1")
    along = Window.partitionBy(key).orderBy("start", "lid")
    last = F.lag("end").over(along)
    new = last.isNull() | (F.col("start") - last > gap) | F.coalesce(F.col("reach") > last, F.lit(False))
    d = d.withColumn("group", F.sum(F.when(new, 1).otherwise(0)).over(along))
    made = d.groupBy(key, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "lid", "word"))).alias("words"))
    text = F.array_join(F.filter(F.transform("words", lambda w: F.trim(w["word"])), lambda w: w != ""), " ")
    return made.select(key, "start", "end", text.alias("text")).where("text <> ''")


def inside_regions(words: DataFrame, regions: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Words (key, lid, start, end) whose middle is in a region (key, rid, start, end), ends included."""
    middle = words.select(key, "lid", ((F.col("start") + F.col("end")) / 2).alias("at"))
    return words.join(intervals.containing(middle, regions, key, width).select("lid"), "lid", "left_semi")


def reconciliation(recovered: DataFrame, aligned: DataFrame, key: str, width: float = 60.0, most: float = 0.01) -> DataFrame:
    """Recovered cues (key, lid, start, end) that no more than that share of their length overlaps aligned ones."""
    d = _covered(recovered, aligned, key, width, 0.0)
    return d.where(F.col("overlap") < most * (F.col("end") - F.col("start"))).drop("overlap", "held")


def envelopes(cues: DataFrame, evidence: DataFrame, fixed: DataFrame, key: str, width: float = 60.0, least: float = 0.03) -> DataFrame:
    """cues (key, lid, start, end) widened to the evidence (key, rid, start, end) that overlaps them by least, but not beyond the
    neighbouring fixed cues (key, start, end); evidence_count says of how many."""
    met = intervals.overlaps(cues.select(key, "lid", "start", "end"), evidence, key, width).where(F.col("overlap") >= least)
    wide = met.groupBy("lid").agg(F.min("rs").alias("lo"), F.max("re").alias("hi"), F.count(F.lit(1)).alias("evidence_count"))
    sides = lambda d, k, lid, at: d.select(key, at.alias("at"), F.lit(k).alias("k"), lid.alias("lid"))
    no = F.lit(None).cast("bigint")
    ends = sides(fixed, 0, no, F.col("end")).unionByName(sides(cues, 1, F.col("lid"), F.col("start")))
    starts = sides(fixed, 1, no, F.col("start")).unionByName(sides(cues, 0, F.col("lid"), F.col("end")))
    before = Window.partitionBy(key).orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("at", "k").rowsBetween(0, Window.unboundedFollowing)
    floor = ends.withColumn("floor", F.max(F.when(F.col("lid").isNull(), F.col("at"))).over(before)).where("lid IS NOT NULL").select("lid", "floor")
    top = starts.withColumn("top", F.min(F.when(F.col("lid").isNull(), F.col("at"))).over(after)).where("lid IS NOT NULL").select("lid", "top")
    d = cues.join(wide, "lid", "left").join(floor, "lid", "left").join(top, "lid", "left")
    start = F.when(F.col("lo").isNull(), F.col("start")).otherwise(F.greatest(F.coalesce("floor", F.lit(0.0)), F.least("start", "lo")))
    end = F.when(F.col("hi").isNull(), F.col("end")).otherwise(F.least(F.coalesce("top", "hi"), F.greatest("end", "hi")))
    return d.select(key, "lid", start.alias("start"), end.alias("end"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def coverage(events: DataFrame, cues: DataFrame, key: str, width: float = 60.0, least: float = 0.03, margin: float = 0.1) -> DataFrame:
    """Per key the share of events (key, lid, start, end) that cues cover (overlap of least, or the middle margin from a cue) and of
    their time in the union of the cues; events without length don't count."""
    real = events.where(F.col("end") > F.col("start"))
    d = _covered(real, intervals.union(cues.select(key, "start", "end"), key), key, width, margin)
    hit = F.avg(F.when((F.col("overlap") >= least) | F.col("held"), 1.0).otherwise(0.0))
    return d.groupBy(key).agg(hit.alias("event_coverage"), F.least(F.lit(1.0), F.sum("overlap") / F.sum(F.col("end") - F.col("start"))).alias("time_coverage"))


def sharing_ids(left: DataFrame, right: DataFrame, ids: str, lid: str, rid: str) -> DataFrame:
    """Pairs (lid, rid) of rows whose arrays of ids meet."""
    a = left.select(lid, F.explode(F.array_distinct(ids)).alias("__v_id"))
    b = right.select(rid, F.explode(F.array_distinct(ids)).alias("__v_id"))
    return a.join(b, "__v_id").select(lid, rid).distinct()


def supported_terms(routes: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """group, term, routes: of the terms (group, term) those that the texts (group, route, text) of so many routes hold, in any case."""
    met = routes.join(terms, "group").where(F.contains(F.lower("text"), F.lower("term")))
    return met.groupBy("group", "term").agg(F.countDistinct("route").alias("routes")).where(F.col("routes") >= least)


def attached(words: DataFrame, cues: DataFrame, key: str, gap: float = 0.5, width: float = 60.0) -> DataFrame:
    """For each word (key, lid, start, end) the cue (key, rid, start, end) whose ends its middle is nearest to (0 inside), at most gap
    away; the smallest rid on ties."""
    at = ((F.col("start") + F.col("end")) / 2).alias("at")
    wide = cues.where(F.col("start") <= F.col("end")).select(key, "rid", F.col("start").alias("rs"), F.col("end").alias("re"))
    wide = intervals.gridded(wide, F.col("rs") - gap, F.col("re") + gap, width, False)
    cell = F.floor(F.col("at") / (F.lit(float(width)) * F.pow(F.lit(float(intervals.COARSER)), F.col("grid"))))
    met = words.select(key, "lid", at).withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(intervals.GRIDS - 1)))).withColumn("cell", cell).join(wide, [key, "grid", "cell"])
    far = F.when(F.col("at").between(F.col("rs"), F.col("re")), F.lit(0.0)).otherwise(F.least(F.abs(F.col("at") - F.col("rs")), F.abs(F.col("at") - F.col("re"))))
    best = met.withColumn("far", far).where(F.col("far") <= gap).groupBy(key, "lid").agg(F.min(F.struct("far", "rid")).alias("best"))
    return best.select(key, "lid", F.col("best.rid").alias("rid"), F.col("best.far").alias("far"))


def discontinuities(parts: DataFrame, key: str, order: str, most: float = 0.002) -> DataFrame:
    """Rows that don't begin where the one before ended, with the gap."""
    gap = F.col("start") - F.lag("end").over(Window.partitionBy(key).orderBy(order))
    return parts.withColumn("gap", gap).where(F.abs("gap") > most)


def text_issues(cues: DataFrame, key: str, longest: int = 84, width: int = 42, lines: int = 2) -> DataFrame:
    """key, issue, n: counts of what is wrong with the texts of cues (key, text); malformed ones are counted by reason."""
    t = F.trim(F.coalesce("text", F.lit("")))
    found = F.when(t == "", F.array(F.lit("empty_text"))).otherwise(F.concat(
        F.array_compact(F.array(F.when(F.length(t) > longest, "long_text"), F.when(subtitles.line_count(t, width) > lines, "excessive_lines"))),
        subtitles.malformed(F.col("text")),
    ))
    return cues.select(key, F.explode(found).alias("issue")).groupBy(key, "issue").agg(F.count(F.lit(1)).alias("n"))


def unsteady_voices(cues: DataFrame, key: str, speaker: str = "speaker", voice: str = "voice") -> DataFrame:
    """Speakers who are given more than one voice, with the voice they have most often (the first by name on ties)."""
    n = cues.where(F.col(speaker).isNotNull() & F.col(voice).isNotNull()).groupBy(key, speaker, voice).agg(F.count(F.lit(1)).alias("n"))
    d = n.groupBy(key, speaker).agg(F.count(F.lit(1)).alias("voices"), F.min(F.struct((-F.col("n")).alias("m"), F.col(voice).alias("v")))["v"].alias("most"))
    return d.where("voices > 1")


def speaking_rates(voices: DataFrame, probes: DataFrame, voice: str, characters: int, default: float) -> DataFrame:
    """voice, rate: characters a second of a probe text (voice, seconds), the default without a usable probe."""
    d = voices.select(voice).distinct().join(probes, voice, "left")
    return d.select(voice, F.coalesce(F.try_divide(F.lit(float(characters)), F.when(F.col("seconds") > 0, F.col("seconds"))), F.lit(default)).alias("rate"))


#: Fields that a canonical cue must have, and no others.
FIELDS = ("id", "semantic_group_id", "source_cue_ids", "start", "end", "source_text", "translated_text", "speaker", "words", "confidence", "provenance", "metadata")


def schema_issues(cues: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """entity, issue: fields of the table that are missing or unexpected, cues without id, repeated ids, times that run backwards."""
    spark = cues.sparkSession
    told = [(f, "missing_field") for f in fields if f not in cues.columns] + [(c, "unexpected_field") for c in cues.columns if c not in fields]
    found = spark.createDataFrame(told, "entity string, issue string")
    of = lambda d, issue: d.select(F.col("id").cast("string").alias("entity"), F.lit(issue).alias("issue"))
    if "id" in cues.columns:
        found = found.unionByName(of(cues.where(F.col("id").isNull()), "no_id")).unionByName(of(cues.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1"), "repeated_id"))
        if {"start", "end"} <= set(cues.columns):
            found = found.unionByName(of(cues.where(F.col("end") < F.col("start")), "backwards"))
    return found


def canonical(legacy: DataFrame, key: str, order: str) -> DataFrame:
    """Legacy cues (key, start, end, text and others) in canonical fields: ids by order, other columns in the map of metadata."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    others = [c for c in legacy.columns if c not in (key, "start", "end", "text", "speaker")]
    extra = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]) if others else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull())
    ident = F.format_string("cue-%04d", nth)
    return legacy.select(
        key, ident.alias("id"), ident.alias("semantic_group_id"), F.array(ident).alias("source_cue_ids"), "start", "end", F.col("text").alias("source_text"),
        F.coalesce(F.col("speaker"), F.lit("unknown")).alias("speaker") if "speaker" in legacy.columns else F.lit("unknown").alias("speaker"), extra.alias("metadata"),
    )


def metric_changes(before: DataFrame, after: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """metric, before, after, change of numbers that either report has; the change is null where one lacks it."""
    a, b = before.select(name, F.col(value).alias("before")), after.select(name, F.col(value).alias("after"))
    return a.join(b, name, "full").withColumn("change", F.col("after") - F.col("before"))


def confidence_maps(rows: DataFrame, key: str, ident: str, confidence: str) -> DataFrame:
    """key, confidences: a map from id to confidence; nulls are left out, of repeated ids the largest counts."""
    d = rows.where(F.col(ident).isNotNull() & F.col(confidence).isNotNull()).groupBy(key, ident).agg(F.max(confidence).alias("c"))
    return d.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(ident, "c")))).alias("confidences"))


def ordered_concat(aligned: DataFrame, kept: DataFrame, longest: float = 8.0) -> DataFrame:
    """Aligned cues and those of kept that last no longer, by start and end."""
    return aligned.unionByName(kept.where(F.col("end") - F.col("start") <= longest)).orderBy("start", "end")


def alignment_route(explicit: Column, confidence: Column, language: Column, models: dict[str, str], fallback: str = "unaligned") -> Column:
    """What aligns a medium: an explicit model, nothing where the language is uncertain (below 0.5), the language's model, or the
    fallback."""
    table = F.create_map(*[F.lit(x) for kv in models.items() for x in kv])
    return F.coalesce(explicit, F.when(F.coalesce(confidence, F.lit(0.0)) < 0.5, fallback), F.try_element_at(table, subtitles.language_tag(language)), F.lit(fallback))


def report(cues: DataFrame, key: str, longest: float = 12.0, shortest: float = 0.5, fastest: float = 20.0, chars: int = 84, width: int = 42, lines: int = 2) -> DataFrame:
    """key, issues (a map from kind to number, of timing and text), total and passed for each medium's cues (key, start, end, text)."""
    timing = intervals.cue_checks(cues.withColumn("text", F.coalesce("text", F.lit(""))), key, longest, shortest, fastest)
    kinds = [c for c in timing.columns if c != key]
    told = timing.unpivot([key], kinds, "issue", "n").unionByName(text_issues(cues, key, chars, width, lines)).where("n > 0")
    whole = told.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "n")))).alias("issues"), F.sum("n").alias("total"))
    d = cues.select(key).distinct().join(whole, key, "left")
    return d.select(key, F.coalesce("issues", F.create_map().cast("map<string,bigint>")).alias("issues"), F.coalesce("total", F.lit(0)).alias("total"), F.col("total").isNull().alias("passed"))

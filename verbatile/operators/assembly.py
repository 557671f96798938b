"""Whole documents and media put together from smaller operators: blocks, chapters, cleaning with an audit, display cues, clusters."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.functions import headings, lines, passages, subtitles
from verbatile.functions import text as T
from verbatile.operators import corpus, folds, markdown, repair
from verbatile.operators.records import few
from verbatile.sinks import stores

#: Block types whose neighbouring lines are one block.
TOGETHER = ("code", "indented", "html", "paragraph", "quote", "table", "list", "blank")


def blocks(rows: DataFrame) -> DataFrame:
    """doc_id, block (from 0), type, start, end, text of Markdown lines (doc_id, line, text): lines of one type that follow each other are
    one block, but headings, rules and footnotes, which are one each. Editable are those that hold text: no code, markup, rules, references or blanks."""
    along = Window.partitionBy("doc_id").orderBy("line")
    d = markdown.block_types(rows)
    alone = ~F.col("block").isin(*TOGETHER)
    new = F.lag("block").over(along).isNull() | (F.lag("block").over(along) != F.col("block")) | alone
    d = d.withColumn("nth", F.sum(F.when(new, 1).otherwise(0)).over(along) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    d = d.groupBy("doc_id", "nth").agg(F.first("block").alias("type"), F.min("line").alias("start"), F.max("line").alias("end"), text.alias("text"))
    return d.select("doc_id", F.col("nth").alias("block"), "type", "start", "end", "text", (~F.col("type").isin("code", "indented", "comment", "declaration", "html", "rule", "blank", "reference")).alias("editable"))


def fused(parts: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, block (the first of those that were fused), text of blocks (as blocks gives them): two paragraphs with one blank between them are
    one where the last word of the left and the first of the right are an accepted pair (left, right, replacement); a chain of them is one."""
    along = Window.partitionBy("doc_id").orderBy("block")
    d = parts.select("doc_id", "block", "type", "text", F.lead("type", 1).over(along).alias("t1"), F.lead("type", 2).over(along).alias("t2"), F.lead("text", 2).over(along).alias("next"))
    tail, head = F.regexp_extract("text", r"([A-Za-z]+)\s*$", 1), F.regexp_extract("next", r"^\s*([a-z]+)", 1)
    d = d.withColumns({"tail": F.lower(tail), "head": head})
    pair = accepted.select(F.lower("left").alias("__v_l"), F.lower("right").alias("__v_r"), F.col("replacement").alias("__v_new"))
    sits = (F.col("type") == "paragraph") & (F.col("t1") == "blank") & (F.col("t2") == "paragraph")
    d = d.join(pair, sits & (F.col("tail") == F.col("__v_l")) & (F.col("head") == F.col("__v_r")), "left")
    joins = F.col("__v_new").isNotNull()
    before, two = F.lag(joins, 1).over(along), F.lag(joins, 2).over(along)
    head_gone = F.coalesce(two, F.lit(False))
    d = d.withColumns({"__v_blank": F.coalesce(before, F.lit(False)) & (F.col("type") == "blank"), "__v_on": head_gone})
    t = F.when(F.col("__v_on"), F.regexp_replace("text", r"^\s*[a-z]+", "")).otherwise(F.col("text"))
    t = F.when(joins, F.concat(F.regexp_replace(t, r"[A-Za-z]+\s*$", ""), F.col("__v_new"))).otherwise(t)
    d = d.withColumn("made", t).where(~F.col("__v_blank"))
    d = d.withColumn("grp", F.sum(F.when(F.col("__v_on"), 0).otherwise(1)).over(along))
    return d.groupBy("doc_id", "grp").agg(F.min("block").alias("block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "made"))), lambda x: x["made"]), "").alias("text")).drop("grp")


def chapters(rows: DataFrame, boundary: str = r"(?i)^#{1,2}\s+(?:chapter|prologue|epilogue|interlude|part)\b", parts: int = 1) -> DataFrame:
    """rows (doc_id, line, text) with chapter (0 before the first) and title. Documents without a boundary are cut into parts of about
    equal numbers of lines, from 1."""
    along, whole = Window.partitionBy("doc_id").orderBy("line"), Window.partitionBy("doc_id")
    is_new = F.coalesce(F.col("text"), F.lit("")).rlike(boundary)
    d = rows.withColumns({"__v_new": is_new, "__v_nth": F.row_number().over(along) - 1, "__v_n": F.count(F.lit(1)).over(whole), "__v_any": F.max(is_new).over(whole)})
    running = F.sum(F.when(F.col("__v_new"), 1).otherwise(0)).over(along)
    equal = F.least(F.floor(F.col("__v_nth") / F.greatest(F.floor(F.col("__v_n") / parts), F.lit(1))), F.lit(parts - 1)) + 1
    title = F.last(F.when(F.col("__v_new"), F.regexp_replace("text", r"^#+\s*", "")), ignorenulls=True).over(along)
    out = d.withColumns({"chapter": F.when(F.col("__v_any"), running).otherwise(equal).cast("bigint"), "title": title})
    return out.drop("__v_new", "__v_nth", "__v_n", "__v_any")


def filtered_lines(rows: DataFrame, kept: list[str] = ()) -> DataFrame:
    """rows without separators, publishers' lines, footnotes, timelines and what a careless scan leaves, in that order of reasons; headings
    stay, those that kept doesn't name (if it names any) as plain text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    head = t.rlike(r"^#{1,6}\s")
    drop = ~head & (F.trim(t) != "") & (lines.is_separator(t) | lines.is_publisher(t) | lines.is_footnote(t) | lines.is_timeline(t) | lines.is_dump_noise(t))
    d = rows.where(~drop)
    if not kept:
        return d
    named = headings.section_key(F.col("text")).isin(*[passages.label_key(k) for k in kept])
    return d.withColumn("text", F.when(head & ~named, F.regexp_replace("text", r"^#{1,6}\s+", "")).otherwise(F.col("text")))


def _on_lines(step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A step on documents (doc_id, text) from one on their lines. A document whose lines all go is empty."""

    def run(docs: DataFrame) -> DataFrame:
        left = step(corpus.lines(docs)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("__v_text"))
        return docs.select("doc_id").join(left, "doc_id", "left").select("doc_id", F.coalesce("__v_text", F.lit("")).alias("text"))

    return run


def _on_text(function: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: passages.applied(docs, ["doc_id"], "text", "text", "string", function)


def _on_column(function: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: docs.withColumn("text", function(F.col("text")))


def cleaning(excluded: tuple[str, ...] = ("Afterword", "Character Profiles"), pictures: str = "safe") -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The steps that clean a converted document, in order."""
    from verbatile.functions import cleanup

    return [
        ("underlined headings", _on_text(passages.underlined_headings)), ("pictures", _on_text(passages.without_pictures(pictures, excluded))), ("markup", _on_column(T.inline_markup)),
        ("footnotes", _on_column(cleanup.without_footnotes)), ("headings", _on_lines(repair.normal_headings)), ("front matter", _on_lines(repair.without_front_matter)), ("metadata", _on_lines(repair.without_metadata)),
        ("sections", _on_lines(lambda d: repair.without_sections(d, list(excluded)))), ("tail", _on_lines(repair.without_tail)), ("encoding", _on_text(passages.undamaged)),
        ("paragraphs", _on_text(passages.paragraphs)), ("emphasis", _on_column(lines.without_emphasis)), ("spacing", _on_column(cleanup.spacing)),
    ]


def cleaned(docs: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], staged: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text; ids are keys) through the steps, and one audit row for each step that changed a document. staged: writes a step's
    result and reads it again, so that long chains aren't planned and run anew for each audit."""
    now, told = docs.select("doc_id", "text"), None
    for name, step in steps:
        after = staged(step(now))
        rows = stores.change_rows(now, after, ["doc_id"], "text", name, name)
        told = rows if told is None else told.unionByName(rows)
        now = after
    return now, told


def policy(records: DataFrame, unit: list[str], least: float = 0.0, report_only: bool = False) -> DataFrame:
    """records (unit, before, after, confidence) with applied: none of a unit (a processor on a span) where any of its changes is less sure
    than that, or all are only to be reported."""
    changes = ~F.col("before").eqNullSafe(F.col("after"))
    weak = F.max(F.when(changes & (F.col("confidence") < least), 1).otherwise(0)).over(Window.partitionBy(*unit))
    return records.withColumn("applied", changes & (weak == 0) & F.lit(not report_only))


def first_seen_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, n: the most common value, of equally common ones the one that came first. Nulls are left out."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__v_first"))
    best = n.groupBy(key).agg(F.max(F.struct("n", (-F.col("__v_first")).alias("f"), value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def merged_recovered(cues: DataFrame, recovered: DataFrame, key: str, near: float = 1.0) -> DataFrame:
    """cues and recovered (key, id, start, end, text) as one table: a recovered cue that says the same as, more than or part of a cue which
    begins at most near seconds away widens the first such cue and gives it its text if that is longer; others are cues of their own.

    What is the same is judged on the cues as they came. Both sides meet by seconds, so none is compared with all."""
    plain = lambda d, p: d.select(key, *[F.col(c).alias(p + c) for c in ("id", "start", "end", "text")], subtitles.word_key(F.col("text")).alias(p + "w"))
    a = plain(cues, "a_").withColumn("cell", F.floor(F.col("a_start") / near))
    b = plain(recovered, "b_").withColumn("cell", F.explode(F.array(*[F.floor(F.col("b_start") / near) + k for k in (-1, 0, 1)])))
    same = (F.col("b_w") != "") & (F.contains("a_w", "b_w") | F.contains("b_w", "a_w")) & (F.abs(F.col("a_start") - F.col("b_start")) <= near)
    met = b.join(a, [key, "cell"]).where(same)
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy(key, "b_id").orderBy("a_start", "a_end", "a_id"))).where("nth = 1")
    longest = F.max(F.struct(F.length("b_w").alias("n"), (-F.col("b_start")).alias("s"), F.col("b_text").alias("t")))
    more = met.groupBy(key, F.col("a_id").alias("id")).agg(F.min("b_start").alias("lo"), F.max("b_end").alias("hi"), longest.alias("best"))
    d = cues.join(more, [key, "id"], "left")
    text = F.when(F.col("best.n") > F.length(subtitles.word_key(F.col("text"))), F.col("best.t")).otherwise(F.col("text"))
    wide = d.select(key, "id", F.least("start", "lo").alias("start"), F.greatest("end", "hi").alias("end"), text.alias("text"))
    alone = recovered.join(met.select(key, F.col("b_id").alias("id")), [key, "id"], "left_anti").select(key, "id", "start", "end", "text")
    return wide.unionByName(alone)


def display_times(start: float, end: float, parts: list[str], pauses: list[float]) -> list[float]:
    """Where parts of a text begin and end in a span, in proportion to their letters, moved to the nearest pause that keeps their order."""
    weights = [max(1, len(re.sub(r"\s+", "", p))) for p in parts]
    out, done = [start], 0
    for k, w in enumerate(weights[:-1]):
        done += w
        ideal = start + (end - start) * done / sum(weights)
        lo, hi = out[-1] + 0.001, end - (len(weights) - 1 - k) * 0.001
        near = min((p for p in pauses if lo <= p <= hi), key=lambda p: abs(p - ideal), default=ideal)
        out.append(round(max(lo, min(near, hi)), 3))
    return [*out, end]


def display_cues(groups: DataFrame, chars: int = 84, pause: float = 0.12) -> DataFrame:
    """id, group_id, start, end, text of groups (group_id, start, end, text, words as array of start and end): each text in parts of at most
    chars characters, cut in time at pauses between the words. A group without text is an error."""

    def run(batches):
        for d in batches:
            out = []
            for r in d.itertuples(index=False):
                if not (r.text or "").strip():
                    raise ValueError(f"group without text: {r.group_id}")
                words = sorted((w["start"], w["end"]) for w in (r.words if r.words is not None else []))
                pauses = [(a[1] + b[0]) / 2 for a, b in zip(words, words[1:]) if b[0] - a[1] >= pause]
                parts = folds.pieces(r.text, chars)
                at = display_times(r.start, r.end, parts, pauses)
                out += [(f"{r.group_id}.display-{k + 1:02d}", r.group_id, round(at[k], 3), round(at[k + 1], 3), p) for k, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["id", "group_id", "start", "end", "text"])

    return groups.select("group_id", F.col("start").cast("double"), F.col("end").cast("double"), "text", "words").mapInPandas(run, "id string, group_id string, start double, end double, text string")


def voice_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def found_voices(hints: DataFrame, voices: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """hints (hint) with voice: by alias, else the voice of the same letters and digits, else the first by name that holds the hint; null if
    none does."""
    key = voice_key(F.col("hint"))
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    met = hints.join(few(voices.select("voice")), F.contains(voice_key(F.col("voice")), key) & (key != ""), "left")
    best = met.groupBy("hint").agg(F.min(F.struct(voice_key(F.col("voice")) != key, "voice"))["voice"].alias("found"))
    return best.select("hint", F.coalesce(F.try_element_at(table, key), "found").alias("voice"))


def narration_statistics(clips: DataFrame) -> DataFrame:
    """words_per_minute, sentence_pauses, scene_pauses and issues of clips (segments as array of start, end, text; trailing_pause)."""
    words = F.aggregate("segments", F.lit(0), lambda a, s: a + F.size(F.filter(F.split(s["text"], r"\s+"), lambda w: w != "")))
    spoken = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    d = clips.agg(F.sum(words).alias("w"), F.sum(spoken).alias("s"), F.sum(F.greatest(F.lit(0), F.size("segments") - 1)).alias("sentence_pauses"), F.count_if(F.col("trailing_pause") >= 1.0).alias("scene_pauses"))
    rate = F.coalesce(F.round(F.try_divide(F.col("w"), F.col("s")) * 60, 1), F.lit(0.0))
    issues = F.array_compact(F.array(F.when(~rate.between(105, 180), "speaking rate"), F.when(F.coalesce("sentence_pauses", F.lit(0)) == 0, "no sentence pauses"), F.when(F.col("scene_pauses") == 0, "no scene pauses")))
    return d.select(rate.alias("words_per_minute"), F.coalesce("sentence_pauses", F.lit(0)).cast("bigint").alias("sentence_pauses"), "scene_pauses", issues.alias("issues"))


# Clusters of speakers

def linked(vectors: np.ndarray, count: int) -> np.ndarray:
    """Labels of count clusters by average linkage of cosine distances."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    far, size, label = 1 - unit @ unit.T, np.ones(len(unit)), np.arange(len(unit))
    np.fill_diagonal(far, np.inf)
    for _ in range(len(unit) - count):
        i, j = np.unravel_index(np.argmin(far), far.shape)
        i, j = min(i, j), max(i, j)
        far[i] = far[:, i] = (far[i] * size[i] + far[j] * size[j]) / (size[i] + size[j])
        far[i, i], far[j], far[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def silhouette(vectors: np.ndarray, label: np.ndarray) -> float:
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    far, kinds = 1 - unit @ unit.T, np.unique(label)
    sums = np.stack([far[:, label == k].sum(axis=1) for k in kinds], axis=1)
    n = np.array([(label == k).sum() for k in kinds])
    at = np.searchsorted(kinds, label)
    own = np.where(n[at] > 1, (sums[np.arange(len(label)), at] - np.diag(far)) / np.maximum(n[at] - 1, 1), 0.0)
    means = sums / n
    means[np.arange(len(label)), at] = np.inf
    other = means.min(axis=1)
    return float(np.where(n[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-12), 0.0).mean())


def information(vectors: np.ndarray, count: int, label: np.ndarray) -> float:
    """Bayesian information criterion of a mixture of count diagonal Gaussians, fitted by expectation maximisation from labels.

    The vectors are whitened first; a variance is at least a tenth of what it is over all, so that single vectors are no clusters."""
    x = vectors - vectors.mean(axis=0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    keep = min(20, len(x) - 1, int((s > 1e-9).sum()))
    x = x @ v[:keep].T / np.maximum(s[:keep], 1e-12) * np.sqrt(max(1, len(x) - 1))
    part = np.eye(count)[label] * 0.9 + 0.1 / count
    score = -np.inf
    for _ in range(50):
        n = part.sum(axis=0) + 1e-9
        mean = part.T @ x / n[:, None]
        var = part.T @ x**2 / n[:, None] - mean**2 + 0.1
        log = np.log(n / n.sum()) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + ((x[:, None] - mean) ** 2 / var).sum(axis=2))
        top = log.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
        part, before, score = np.exp(log - total), score, float(total.sum())
        if score - before < 1e-3:
            break
    return -2 * score + (count * (2 * keep + 1) - 1) * np.log(len(x))


def clusters(vectors: np.ndarray, most: int) -> np.ndarray:
    """Labels for as many clusters as the better of two estimates asks for: the silhouette less 0.01 a cluster, and the information
    criterion. Fewer than three vectors are one cluster."""
    if len(vectors) < 3:
        return np.zeros(len(vectors), dtype=int)
    tried = {k: linked(vectors, k) for k in range(2, min(most, max(2, len(vectors) // 5), len(vectors) - 1) + 1)}
    by_shape = max(tried, key=lambda k: (silhouette(vectors, tried[k]) - 0.01 * k, -k))
    by_model = min(tried, key=lambda k: (information(vectors, k, tried[k]), k))
    return tried[max(by_shape, by_model)]


def speaker_clusters(rows: DataFrame, key: str, ident: str, vector: str, most: int = 8, utterances: int = 5_000) -> DataFrame:
    """key, ident, speaker (by first appearance) of each medium's utterances. A medium beyond so many utterances is an error: distances are of
    all pairs, so it has to be cut before."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{ident}` {rows.schema[ident].dataType.simpleString()}, speaker int"
    large = rows.groupBy(key).count().where(F.col("count") > utterances).head(1)
    if large:
        raise ValueError(f"too many utterances: {large[0][key]}")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(ident)
        label = clusters(np.stack(d[vector].to_numpy()).astype(float), most)
        order = {k: i for i, k in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({key: d[key], ident: d[ident], "speaker": [order[k] for k in label.tolist()]})

    return rows.select(key, ident, vector).groupBy(key).applyInPandas(run, schema)

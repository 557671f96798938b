"""Writers of cue sheets, subtitles, reports and partitioned tables. One row of key and body is one file's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatile.functions import text as T


def _body(d: DataFrame, key: str, order: list[str], line: Column, mark: str) -> DataFrame:
    """key, body: the lines of a key in order. A body is one file, so it is bounded by what one reader opens."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    d = d.withColumn("nth", nth)
    return d.select(key, "nth", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("rows")).select(key, F.array_join(F.transform("rows", lambda r: r.line), mark).alias("body"))


def _ass_time(seconds: Column) -> Column:
    cs = F.floor(seconds * 100 + 0.5).cast("bigint")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), part(F.floor(cs / 6000) % 60), F.lit(":"), part(F.floor(cs / 100) % 60), F.lit("."), part(cs % 100))


def srt(cues: DataFrame, key: str) -> DataFrame:
    """SubRip text of each key's cues (start, end, text): numbered blocks with a blank line between."""
    line = F.concat(F.col("nth").cast("string"), F.lit("\n"), T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return _body(cues, key, ["start", "end", "text"], line, "\n")


def ass(cues: DataFrame, key: str) -> DataFrame:
    """The events of Advanced SubStation text, each in the style of its speaker; line breaks become \\N."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\\N"))
    line = F.concat(F.lit("Dialogue: 0,"), _ass_time(F.col("start")), F.lit(","), _ass_time(F.col("end")), F.lit(","), F.coalesce("speaker", F.lit("Default")), F.lit(",,0,0,0,,"), text)
    return _body(cues, key, ["start", "end", "speaker", "text"], line, "\n")


def chapters(parts: DataFrame, key: str, order: str, seconds: str, title: str) -> DataFrame:
    """Chapter lists from lengths: each begins where the ones before it end."""
    start = F.coalesce(F.sum(seconds).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = parts.withColumn("at", start)
    return _body(d, key, [order], F.concat(F.substring(T.srt_time(F.col("at")), 1, 8), F.lit(" "), F.coalesce(F.col(title), F.lit(""))), "\n")


def cue_sheet(parts: DataFrame, key: str, order: str, seconds: str, title: str) -> DataFrame:
    """Tracks of a cue sheet: number, title and start as minutes, seconds and frames (75 a second)."""
    start = F.coalesce(F.sum(seconds).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    frames = F.floor(F.col("at") * 75 + 0.5).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(frames / 4500)
    place = F.concat(F.when(minutes < 100, two(minutes)).otherwise(minutes.cast("string")), F.lit(":"), two(F.floor(frames / 75) % 60), F.lit(":"), two(frames % 75))
    line = F.concat(F.lit("  TRACK "), F.when(F.col("nth") < 100, two(F.col("nth"))).otherwise(F.col("nth").cast("string")), F.lit(' AUDIO\n    TITLE "'), F.replace(F.coalesce(F.col(title), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"\n    INDEX 01 '), place)
    return _body(parts.withColumn("at", start), key, [order], line, "\n")


def markdown_table(d: DataFrame, order: list[str]) -> DataFrame:
    """One row a line of a Markdown table: nth (0 is the head), line. Bars and line breaks are escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, d.columns)), F.lit(" |"))
    head = d.sparkSession.range(1).select(F.lit(0).alias("nth"), F.lit(f"| {' | '.join(d.columns)} |\n|{' --- |' * len(d.columns)}").alias("line"))
    # A report's rows are few: they have been aggregated before.
    return head.unionByName(d.select(F.row_number().over(Window.orderBy(*order)).alias("nth"), row.alias("line")))


def write_bodies(bodies: DataFrame, key: str, path: str) -> None:
    """Each key's body as text in a folder of its own."""
    bodies.select(key, F.col("body").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_partitions(d: DataFrame, path: str, by: str) -> None:
    """d as Parquet partitioned by a column; only partitions that d has are replaced (split lists, replace-by-file)."""
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ass_document(cues: DataFrame, key: str, font: str = "Arial", size: int = 48) -> DataFrame:
    """A whole Advanced SubStation file for each key: head, one style for each speaker (by name; null speakers have the default one), events."""
    styles = cues.select(key, F.coalesce("speaker", F.lit("Default")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_set("s")).alias("s"))
    line = F.transform("s", lambda s: F.concat(F.lit("Style: "), s, F.lit(f",{font},{size},&H00FFFFFF,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1")))
    head = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    events = "\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    d = ass(cues, key).join(styles, key)
    return d.select(key, F.concat(F.lit(head), F.array_join(line, "\n"), F.lit(events), "body", F.lit("\n")).alias("body"))

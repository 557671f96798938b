"""Registered queries: blocks, chapters, cleaning with its audit, policies, recovered and display cues, voices, narration."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatile.functions import passages
from verbatile.operators import assembly as A
from verbatile.operators import corpus, matching, telemetry
from verbatile.plans.catalog import CUES, cues, query, read
from verbatile.plans.repairing import dealt, examples
from verbatile.plans.reports import MD_LINES, md_lines


@query(f"""WITH {MD_LINES}, n AS (SELECT *, coalesce(lag(block) OVER w <> block, true) OR block NOT IN ('code', 'indented', 'html', 'paragraph', 'quote', 'table', 'list', 'blank') AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS nth FROM n)
SELECT doc_id, nth::BIGINT AS block, any_value(block) AS type, (max(line) - min(line) + 1)::BIGINT AS lines, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest, any_value(block NOT IN ('code', 'indented', 'comment', 'declaration', 'html', 'rule', 'blank', 'reference')) AS editable FROM g GROUP BY 1, 2""")
def markdown_blocks(spark, sf_dir):
    d = A.blocks(md_lines(spark, sf_dir))
    return d.select("doc_id", "block", "type", (F.col("end") - F.col("start") + 1).cast("bigint").alias("lines"), F.sha2("text", 256).alias("digest"), "editable")


# (text, fused by the pairs `to gether` and `out side`)
FUSED = [("we come to\n\ngether and go out\n\nside again\n\nend", "we come together and go outside again|end"), ("come to\n\nGether", "come to|Gether"), ("come to\n\n# x\n\ngether", "come to|# x|gether"), ("to\n\ngether", "together")]


@query(examples(FUSED, [(1, "made")]))
def fused_blocks(spark, sf_dir):
    rows = corpus.lines(dealt(spark, sf_dir, FUSED).withColumnRenamed("t", "text"))
    accepted = spark.createDataFrame([("to", "gether", "together"), ("out", "side", "outside")], "left string, right string, replacement string")
    d = A.fused(A.blocks(rows), accepted).where("text <> ''")
    return d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "|").alias("made"))


BOOK = "pre\n# Chapter 1: A\nx\n### Chapter no\n## Epilogue\nz"


@query("""SELECT doc_id, chapter, n, title FROM documents, (VALUES (0, 1, NULL), (1, 3, 'Chapter 1: A'), (2, 2, 'Epilogue')) c(chapter, n, title) WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, chapter, n, NULL FROM documents, (VALUES (1, 2), (2, 2), (3, 3)) c(chapter, n) WHERE doc_id % 2 = 1""")
def chapter_lines(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, BOOK).otherwise("a\nb\nc\nd\ne\nf\ng")
    d = A.chapters(corpus.lines(read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))), parts=3)
    return d.groupBy("doc_id", "chapter", "title").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.col("chapter").cast("int").alias("chapter"), F.col("n").cast("int").alias("n"), "title")


# (text, after the filter of lines)
RAW = [("# Keep\nReal words stand in here.\n◆ ◆ ◆\n[1] a note that goes\nAll of it © 2020\n# Timeline\nx", "# Keep\nReal words stand in here.\nTimeline"), ("", ""), ("Some words of it\n>>>><<<< //// @@@@", "Some words of it")]


@query(examples(RAW, [(1, "made")]))
def filtered_lines(spark, sf_dir):
    rows = corpus.lines(dealt(spark, sf_dir, RAW).withColumnRenamed("t", "text"))
    d = A.filtered_lines(rows, ["Keep"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return d.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("made"))


# (text, cleaned, steps that changed it)
DIRTY = [
    ("Copyright 2020\nISBN: 1\nPrologue\n========\n\nIt **was** a\ndark  night.[^1]\n\n[^1]: foot\nAfterword\nthanks", "# Prologue\n\nIt was a dark night.", "emphasis,footnotes,front matter,headings,paragraphs,sections,spacing,underlined headings"),
    ("# Chapter 1: A\n\nplain text.", "# Chapter 1: A\n\nplain text.", ""), ("cafÃ© here.<!-- c -->", "café here.", "encoding,markup"),
    ("one.\n\n<!-- Start of picture text -->@@ ##<!-- End of picture text -->\n\ntwo.", "one.\n\ntwo.", "markup,pictures"),
]


@query(examples(DIRTY, [(1, "text"), (2, "steps")]))
def cleaned_documents(spark, sf_dir):
    docs = dealt(spark, sf_dir, DIRTY).withColumnRenamed("t", "text")
    kinds = docs.select("text").distinct().withColumn("doc_id", F.xxhash64("text"))
    made, told = A.cleaned(kinds, A.cleaning(), matching.checkpointed)
    steps = told.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("steps"))
    out = kinds.select("doc_id", F.col("text").alias("given")).join(made, "doc_id").join(steps, "doc_id", "left").select("given", F.col("text").alias("made"), F.coalesce("steps", F.lit("")).alias("steps"))
    return docs.join(F.broadcast(out), F.col("text") == F.col("given")).select("doc_id", F.col("made").alias("text"), "steps")


# (text, without pictures, respoken)
SPOKEN = [
    ("a<!-- Start of picture text -->Some real words here<br>now<!-- End of picture text -->b", "a\n\nSome real words here\nnow\n\nb", "a&lt;!-- Start of picture text --&gt;Some real words here&lt;br&gt;now&lt;!-- End of picture text --&gt;b"),
    ("<!-- start of picture text -->SERIES Character Profles<!-- end of picture text -->", "\n\n# SERIES Character Profles\n\n", "&lt;!-- start of picture text --&gt;SERIES Character Profles&lt;!-- end of picture text --&gt;"),
    ("Home-and WELL-KNOWN home-and &amp; R&D", "Home-and WELL-KNOWN home-and &amp; R&D", "Home, and WELL-KNOWN home, and &amp; R&amp;D"),
]


@query(examples(SPOKEN, [(1, "pictures"), (2, "spoken")]))
def spoken_texts(spark, sf_dir):
    cut, say = passages.without_pictures("safe", ("Character Profiles",)), passages.respoken({"home-and": "home, and"})
    d = passages.applied(dealt(spark, sf_dir, SPOKEN), ["doc_id"], "t", "made", "struct<pictures:string,spoken:string>", lambda t: {"pictures": cut(t), "spoken": say(t)})
    return d.select("doc_id", "made.*")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity >= 10 AS changed, l_quantity AS confidence FROM lineitem)
SELECT l_orderkey, l_linenumber, l_shipdate, confidence, changed AND min(CASE WHEN changed THEN confidence END) OVER (PARTITION BY l_orderkey) >= 20 AS applied FROM r""")
def span_policy(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").alias("confidence"), F.lit("a").alias("before"), F.when(F.col("l_quantity") >= 10, "b").otherwise("a").alias("after"))
    return A.policy(d, ["l_orderkey"], 20.0).drop("before", "after")


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2) SELECT c_nationkey, arg_max(c_mktsegment, (n, -first)) AS c_mktsegment, max(n) AS n FROM n GROUP BY 1""")
def first_seen_mode(spark, sf_dir):
    return A.first_seen_mode(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query("SELECT event_id, user_id FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-02' AND '2024-01-20' AND event_type IN ('view', 'purchase')")
def chosen_range(spark, sf_dir):
    d = read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return telemetry.day_range(d, "day", "2024-01-02", "2024-01-20", event_type=["view", "purchase"]).select("event_id", "user_id")


SAID = "substr('abcdefgh', 1 + (event_id % 3)::INT, 2 + (event_id % 4)::INT)"


@query(f"""WITH {CUES}, t AS (SELECT *, {SAID} AS text FROM c), a AS (SELECT * FROM t WHERE event_type = 'view'), b AS (SELECT * FROM t WHERE event_type = 'click'),
m AS (SELECT b.user_id, b.event_id AS bid, b.start AS lo, b."end" AS hi, b.text AS bt, a.event_id AS id, row_number() OVER (PARTITION BY b.user_id, b.event_id ORDER BY a.start, a."end", a.event_id) AS nth
FROM b JOIN a ON a.user_id = b.user_id AND (contains(a.text, b.text) OR contains(b.text, a.text)) AND abs(a.start - b.start) <= 3600),
g AS (SELECT id, min(lo) AS lo, max(hi) AS hi, arg_max(bt, (length(bt), -lo)) AS best FROM m WHERE nth = 1 GROUP BY 1)
SELECT a.user_id, a.event_id AS id, least(start, coalesce(lo, start)) AS start, greatest("end", coalesce(hi, "end")) AS "end", CASE WHEN length(best) > length(text) THEN best ELSE text END AS text FROM a LEFT JOIN g ON g.id = a.event_id
UNION ALL SELECT user_id, event_id, start, "end", text FROM b WHERE event_id NOT IN (SELECT bid FROM m)""")
def merged_recovered(spark, sf_dir):
    text = F.expr("substring('abcdefgh', 1 + CAST(event_id % 3 AS INT), 2 + CAST(event_id % 4 AS INT))")
    side = lambda kind: cues(spark, sf_dir, kind).withColumn("text", text).withColumnRenamed("event_id", "id")
    return A.merged_recovered(side("view"), side("click"), "user_id", 3600.0)


@query("""SELECT doc_id, 'g.display-0' || k AS id, s AS start, e AS "end", t AS text FROM documents, (VALUES (1, 0.0::DOUBLE, 4.1::DOUBLE, 'One two.'), (2, 4.1, 10.0, 'Three four five.')) v(k, s, e, t)""")
def display_cues(spark, sf_dir):
    words = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0.0, 2.0), (2.05, 4.0), (4.2, 9.0))])
    groups = spark.range(1).select(F.lit("g").alias("group_id"), F.lit(0.0).alias("start"), F.lit(10.0).alias("end"), F.lit("One two. Three four five.").alias("text"), words.alias("words"))
    return read(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(A.display_cues(groups, 16).drop("group_id")))  # two rows


@query("""SELECT * FROM (VALUES ('Dave', 'en-US-GuyNeural'), ('en_us_aria neural', 'en-US-AriaNeural'), ('sonia', 'en-GB-SoniaNeural'), ('nobody', NULL)) v(hint, voice)""")
def found_voices(spark, sf_dir):
    hints = spark.createDataFrame([("Dave",), ("en_us_aria neural",), ("sonia",), ("nobody",)], "hint string")
    voices = spark.createDataFrame([("en-US-GuyNeural",), ("en-US-AriaNeural",), ("en-GB-SoniaNeural",), ("en-IE-SoniaNeural",)], "voice string")
    return A.found_voices(hints, voices, {"dave": "en-US-GuyNeural"})


@query("""WITH w AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations), c AS (SELECT conv_id, sum(n) AS n, count(*) AS k FROM w GROUP BY 1)
SELECT round(sum(n) / (sum(k) * 20) * 60, 1)::DOUBLE AS words_per_minute, sum(k - 1)::BIGINT AS sentence_pauses, sum((conv_id % 3 = 0)::INT)::BIGINT AS scene_pauses, CASE WHEN round(sum(n) / (sum(k) * 20) * 60, 1) BETWEEN 105 AND 180 THEN '' ELSE 'speaking rate' END AS issues FROM c""")
def narration_statistics(spark, sf_dir):
    segment = F.struct((F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 20).alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    clips = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(segment).alias("segments")).withColumn("trailing_pause", F.when(F.col("conv_id") % 3 == 0, 1.5).otherwise(0.2))
    return A.narration_statistics(clips).withColumn("issues", F.array_join("issues", ","))

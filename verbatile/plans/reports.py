"""More registered queries: Markdown, spelling, word forms, cues, tasks and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbatile.functions import narration, passages
from verbatile.functions import text as T
from verbatile.operators import corpus, folds, intervals, markdown, records, spelling, telemetry
from verbatile.plans.catalog import CUES, ORACLES, LINES, TOKENS, cues, query, read
from verbatile.sinks import documents

# Markdown. The documents have none, so the same lines are put behind each text on both sides.

MD = "\n# Chapter 1\nbody\n\n| a | b |\n- item\n> quote\n***\n```\n# no heading\n```\n    indented\n<!-- c -->\n<!DOCTYPE x>\n<div>x</div>\n![i](u)\n[l](u)\n[r]: http://x\n## Notes ##\nsmall print\n[^1]: foot\n# Chapter 2\nRunning head\nend of it"
MD_LINES = f"""documents AS (SELECT doc_id, text || '{MD}' AS text FROM documents), l AS ({LINES}),
x AS (SELECT doc_id, n AS line, line AS text, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM l),
y AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM x),
b AS (SELECT doc_id, line, text, CASE WHEN inside OR fence THEN 'code' WHEN regexp_matches(text, '^\\s*$') THEN 'blank' WHEN regexp_matches(text, '^( {{4}}|\\t)\\s*\\S') THEN 'indented' WHEN regexp_matches(text, '^\\s*<!--.*-->\\s*$') THEN 'comment'
WHEN regexp_matches(text, '^\\s*<[!?]') THEN 'declaration' WHEN regexp_matches(text, '^\\s*</?[A-Za-z][^>]*>') THEN 'html' WHEN regexp_matches(text, '^#{{1,6}}\\s+\\S') THEN 'heading'
WHEN regexp_matches(text, '^\\s*(-{{3,}}|\\*{{3,}}|_{{3,}})\\s*$') THEN 'rule' WHEN regexp_matches(text, '^\\s*>') THEN 'quote' WHEN regexp_matches(text, '^\\s*([-*+]|\\d+[.)])\\s+\\S') THEN 'list'
WHEN regexp_matches(text, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(text, '^\\[\\^[^\\]]+\\]:') THEN 'footnote' WHEN regexp_matches(text, '^\\s{{0,3}}\\[[^\\]^][^\\]]*\\]:\\s*\\S') THEN 'reference'
WHEN regexp_matches(text, '^\\s*!\\[[^\\]]*\\]\\([^)]*\\)\\s*$') THEN 'image' WHEN regexp_matches(text, '^\\s*\\[[^\\]]*\\]\\([^)]*\\)\\s*$') THEN 'link' ELSE 'paragraph' END AS block FROM y)"""


def md_lines(spark, sf_dir):
    return corpus.lines(read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(MD)).alias("text")))


@query(f"WITH {MD_LINES} SELECT block, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b GROUP BY 1")
def block_statistics(spark, sf_dir):
    return markdown.block_types(md_lines(spark, sf_dir)).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""WITH {MD_LINES}, s AS (SELECT *, last_value(CASE WHEN block = 'heading' THEN lower(trim(regexp_replace(text, '^#+\\s*|\\s*#+\\s*$', '', 'g'))) END IGNORE NULLS)
OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b)
SELECT doc_id, count(*) AS n, sum(line)::BIGINT AS places FROM s WHERE section IS NULL OR section NOT IN ('notes') GROUP BY 1""")
def section_removal(spark, sf_dir):
    return markdown.without_sections(md_lines(spark, sf_dir), ["notes"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("places"))


@query("""WITH d AS (SELECT doc_id, text || 'a<br/>b<BR><u>c</u><!-- x' || chr(10) || 'y -->' || chr(10) || chr(10) || chr(10) || 'd' AS t FROM documents),
e AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '<br\\s*/?>', chr(10), 'gi'), '</?u>', '', 'gi'), '(?s)<!--.*?-->', '', 'g') AS t FROM d)
SELECT doc_id, sha256(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM e""")
def markup_cleanup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("a<br/>b<BR><u>c</u><!-- x\ny -->\n\n\nd")).alias("t"))
    return d.select("doc_id", F.sha2(T.inline_markup(F.col("t")), 256).alias("digest"))


# Word forms

HYPHENS = "[A-Za-z]+(?:-[A-Za-z]+)+"


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(text || ' W-What very-very re-set ' || source, '{HYPHENS}')) AS token FROM documents), p AS (SELECT lower(token) AS key, token, string_split(lower(token), '-') AS parts FROM t)
SELECT key, count(*) AS n, count(DISTINCT token) AS variants, CASE WHEN any_value(len(parts) = 2 AND parts[1] = parts[2]) THEN 'repeated' WHEN any_value(len(parts) = 2 AND length(parts[1]) <= 2 AND starts_with(parts[2], parts[1])) THEN 'stutter'
WHEN any_value(parts[1] IN ('re', 'pre', 'non', 'self')) THEN 'prefix' ELSE 'undecided' END AS kind FROM p GROUP BY key""")
def hyphen_classify(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat("text", F.lit(" W-What very-very re-set "), "source").alias("text"))
    d = docs.select(F.explode(F.regexp_extract_all("text", F.lit(HYPHENS), F.lit(0))).alias("token")).groupBy(F.lower("token").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("variants"))
    parts = F.split("key", "-")
    kind = F.when((F.size(parts) == 2) & (parts[0] == parts[1]), "repeated").when(T.is_stutter(F.col("key")), "stutter").when(parts[0].isin("re", "pre", "non", "self"), "prefix")
    return d.withColumn("kind", kind.otherwise("undecided"))


PAIR = "[A-Za-z]+[,;:] [A-Za-z]+"


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '{PAIR}')) AS pair FROM documents)
SELECT regexp_extract(pair, '^[a-z]+') AS first, regexp_extract(pair, '[,;:]') AS mark, regexp_extract(pair, '[a-z]+$') AS second, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2""")
def punct_pair_evidence(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(PAIR), F.lit(0))).alias("pair"))
    part = lambda p: F.regexp_extract("pair", p, 0)
    return d.groupBy(part("^[a-z]+").alias("first"), part("[,;:]").alias("mark"), part("[a-z]+$").alias("second")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(f"""WITH w AS (SELECT DISTINCT lower(token) AS w FROM ({TOKENS}) WHERE length(token) >= 2), v AS (SELECT DISTINCT w, unnest(list_concat([w], list_transform(range(1, length(w) + 1), lambda i: w[1:i - 1] || w[i + 1:]))) AS variant FROM w),
p AS (SELECT DISTINCT a.w AS a, b.w AS b FROM v a JOIN v b ON a.variant = b.variant AND a.w < b.w) SELECT a, b FROM p WHERE damerau_levenshtein(a, b) = 1""")
def similarity_join(spark, sf_dir):
    """Words of the corpus that are one edit apart."""
    words = corpus.tokens(read(spark, sf_dir, "documents")).select(F.col("key").alias("word")).distinct()
    return spelling.one_edit_apart(words, words).where("a < b")


@query("""WITH s AS (SELECT page_id, length(html) AS n, (length(html) * 10 + 512) // 1024 AS kb, (length(html) * 10 + 524288) // 1048576 AS mb FROM pages)
SELECT page_id, 'My Book - ' || page_id || ' part' AS title, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN kb // 10 || '.' || kb % 10 || ' KB' ELSE mb // 10 || '.' || mb % 10 || ' MB' END AS size,
array_to_string(list_sort(list_distinct(list_concat(range(page_id % 7, page_id % 7 + 4), [page_id % 11]))), ' ') AS pages FROM s""")
def names_sizes_pages(spark, sf_dir):
    d = read(spark, sf_dir, "pages")
    spec = F.concat((F.col("page_id") % 7 + 1).cast("string"), F.lit("-"), (F.col("page_id") % 7 + 4).cast("string"), F.lit(", "), (F.col("page_id") % 11 + 1).cast("string"))
    title = T.file_title(F.concat(F.lit("My_Book [v2] - "), F.col("page_id").cast("string"), F.lit(": part?")))
    return d.select("page_id", title.alias("title"), T.human_size(F.length("html")).alias("size"), F.array_join(F.transform(T.page_ranges(spec), lambda x: x.cast("string")), " ").alias("pages"))


@query("""SELECT source, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))::BIGINT AS words, round(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) / 150 * 60, 3) AS seconds FROM documents GROUP BY 1""")
def duration_estimate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))).alias("words"))
    return d.withColumn("seconds", F.round(F.col("words") / 150 * 60, 3))


# Cues, turns and tasks

@query(f"""WITH {CUES}, p AS (SELECT a.user_id, a.event_id AS lid, b.event_id AS rid, abs((b.start + b."end") / 2 - a.start) AS far FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.start BETWEEN b.start AND b."end")
SELECT user_id, lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY far, rid) AS nth FROM p) WHERE nth = 1""")
def point_in_interval(spark, sf_dir):
    points = cues(spark, sf_dir, "click").select("user_id", F.col("event_id").alias("lid"), F.col("start").alias("at"))
    return intervals.containing(points, cues(spark, sf_dir, "view").withColumnRenamed("event_id", "rid"), "user_id", 1800.0)


@query(f"""WITH {CUES} SELECT event_id, "end" - start + greatest(0, least(0.75, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start, event_id) - "end", 0.75)))::DOUBLE AS available FROM c""")
def lead_windows(spark, sf_dir):
    return intervals.room(cues(spark, sf_dir), "user_id").select("event_id", "available")


@query("""WITH p AS (SELECT conv_id, turn, floor(length(text)::DOUBLE * 60000 / sum(length(text)) OVER (PARTITION BY conv_id) + 0.5)::BIGINT AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, turn, (CASE WHEN r = 1 THEN 60000 - sum(part) OVER (PARTITION BY conv_id) + part ELSE part END)::BIGINT AS share FROM p""")
def proportional_alloc(spark, sf_dir):
    return intervals.allot(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 60000).select("conv_id", "turn", F.col("share").cast("bigint").alias("share"))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list(role) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS before, coalesce(array_to_string(list(role) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' '), '') AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window(spark, sf_dir):
    d = intervals.context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return d.select("conv_id", "turn", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))


@query("""SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations""")
def running_offsets(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("start"))


@query("""WITH s AS (SELECT user_id, event_id, (event_type = 'view')::INT AS s, (event_type = 'click')::INT AS e, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS task FROM events),
o AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY user_id, task ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s WHERE task > 0),
g AS (SELECT user_id, task::BIGINT AS task, count(*) AS n, min(event_id) AS first, max(event_id) AS last, max(e) AS e FROM o WHERE done = 0 GROUP BY 1, 2)
SELECT user_id, task, n, first, last, CASE WHEN e = 1 THEN 'completed' WHEN task < max(task) OVER (PARTITION BY user_id) THEN 'superseded_by_next_task' ELSE 'incomplete' END AS status FROM g""")
def task_sessions(spark, sf_dir):
    return telemetry.tasks(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "view", F.col("event_type") == "click")


@query("""WITH f AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT event_type, user_id, 'speaker-' || lpad(row_number() OVER (PARTITION BY event_type ORDER BY first)::VARCHAR, 3, '0') AS label FROM f""")
def first_appearance_labels(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy("first")).cast("string")
    return d.select("event_type", "user_id", F.concat(F.lit("speaker-"), F.lpad(nth, 3, "0")).alias("label"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY event_id) AS r FROM a) WHERE r <= 2""")
def repeats_limited(spark, sf_dir):
    """Of neighbouring equal events of a user, two stay."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    same = lambda n: F.col("event_type").eqNullSafe(F.lag("event_type", n).over(w)) & F.lag("event_id", n).over(w).isNotNull()
    return d.withColumn("third", same(1) & same(2)).where("NOT third").select("user_id", "event_id")


# Evaluation and statistics

@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread, round(stddev_pop(value), 6) AS deviation,
round(abs(sum(value * user_id)) / sqrt(sum(value * value) * sum((user_id * user_id)::DOUBLE)), 6) AS likeness FROM events GROUP BY 1""")
def value_statistics(spark, sf_dir):
    d, u = read(spark, sf_dir, "events"), F.col("user_id").cast("double")
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    d = d.groupBy("event_type").agg(q.alias("q"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.round(F.abs(F.sum(F.col("value") * u)) / F.sqrt(F.sum(F.col("value") * F.col("value")) * F.sum(u * u)), 6).alias("likeness"))
    return d.select("event_type", F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("spread"), "deviation", "likeness")


@query("""WITH j AS (SELECT quality AS y, n_chars / (SELECT max(n_chars) FROM documents) AS p FROM labels JOIN documents USING (doc_id)), g AS (SELECT p, sum(y) AS tp, count(*) AS n FROM j GROUP BY p),
c AS (SELECT p, sum(tp) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS n, sum(tp) OVER () AS every FROM g)
SELECT p AS threshold, tp / n AS precision, tp / every AS recall FROM c WHERE tp / n >= 0.5 ORDER BY recall DESC, p DESC LIMIT 1""")
def threshold_sweep(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    most = docs.agg(F.max("n_chars")).first()[0]
    return records.threshold_sweep(read(spark, sf_dir, "labels").join(docs, "doc_id"), F.col("quality"), F.col("n_chars") / F.lit(most), 0.5)


@query("""WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256('7' || chr(0) || source)) AS place, count(*) OVER () AS n FROM s)
SELECT source, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.9::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def grouped_split(spark, sf_dir):
    return records.grouped_split(read(spark, sf_dir, "documents"), "source", "7")


# Speech and cue repair

@query("""WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text || chr(10) || '# Head' || chr(10) || '* * *' || chr(10) || chr(10) || 'last  one', '(?m)^(#{1,6} [^\\n]*)$', chr(10) || chr(10) || '\\1' || chr(10) || chr(10), 'g'), '\\n[ \\t]*\\n')) AS p FROM documents),
q AS (SELECT doc_id, trim(regexp_replace(regexp_replace(p, '^\\s*#+ ', ''), '\\s+', ' ', 'g')) AS p FROM p)
SELECT doc_id, count(*) AS n, sum(length(p))::BIGINT AS chars FROM q WHERE length(regexp_replace(p, '[^\\p{L}]', '', 'g')) >= 4 GROUP BY 1""")
def narration_paragraphs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n# Head\n* * *\n\nlast  one")).alias("text"))
    d = docs.select("doc_id", F.explode(narration.paragraphs(F.col("text"))).alias("p"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).alias("chars"))


@query()
def speech_chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(narration.speech_chunks(F.col("text"))).alias("pos", "chunk"))


@query("SELECT doc_id, sha256(nfc_normalize(text) || ' fine café 1') AS digest FROM documents")
def unicode_repair(spark, sf_dir):
    noisy = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ﬁne cafÃ© ①")).alias("text"))
    made = passages.applied(noisy, ["doc_id"], "text", "text", "string", lambda t: passages.normal_form("NFKC")(passages.undamaged(t)))
    return made.select("doc_id", F.sha2("text", 256).alias("digest"))


def timed_words(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "text"))
    start = F.col("turn") * 10000.0 + F.col("pos") * 0.3
    return d.select("conv_id", start.alias("start"), (start + 0.25).alias("end"), F.col("role").alias("speaker"), "text")


@query()
def word_sessionize_caps(spark, sf_dir):
    return folds.sentences(timed_words(spark, sf_dir), "conv_id")


def event_cues(spark, sf_dir):
    return cues(spark, sf_dir).select("user_id", "start", "end", F.col("event_type").alias("speaker"), F.col("event_type").alias("text"))


@query()
def cue_repair(spark, sf_dir):
    return folds.lengthened(event_cues(spark, sf_dir), "user_id", 120.0)


@query()
def adjacent_dedup(spark, sf_dir):
    return folds.without_echoes(event_cues(spark, sf_dir), "user_id", 600.0)


@query()
def greedy_overlap(spark, sf_dir):
    return folds.without_overlap(event_cues(spark, sf_dir), "user_id")


@query(f"""WITH {CUES}, v AS (SELECT * FROM c WHERE event_type = 'view'), r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
t AS (SELECT user_id, sum(greatest(0, "end" - greatest(start, coalesce(reach, start)))) AS every FROM r GROUP BY 1), g AS (SELECT user_id, sum("end" - start) AS gone FROM ({ORACLES["interval_difference"]}) GROUP BY 1)
SELECT user_id, round(1 - coalesce(gone, 0) / every, 9) AS coverage FROM t LEFT JOIN g USING (user_id)""")
def coverage_ratio(spark, sf_dir):
    """The share of the time of a user's views that clicks cover."""
    views, total = cues(spark, sf_dir, "view"), F.sum(F.col("end") - F.col("start"))
    every = intervals.union(views, "user_id").groupBy("user_id").agg(total.alias("every"))
    gone = intervals.difference(views, cues(spark, sf_dir, "click"), "user_id").groupBy("user_id").agg(total.alias("gone"))
    return every.join(gone, "user_id", "left").select("user_id", F.round(1 - F.coalesce("gone", F.lit(0.0)) / F.col("every"), 9).alias("coverage"))


@query(f"""WITH w AS (SELECT lower(token) AS w, count(*) AS n FROM ({TOKENS}) WHERE length(token) >= 4 GROUP BY 1), v AS (SELECT DISTINCT w, n, unnest(list_concat([w], list_transform(range(1, length(w) + 1), lambda i: w[1:i - 1] || w[i + 1:]))) AS variant FROM w WHERE n = 1 OR n >= 5),
p AS (SELECT DISTINCT a.w AS word, b.w AS suggestion, b.n AS frequency FROM v a JOIN v b ON a.variant = b.variant AND a.n = 1 AND b.n >= 5), q AS (SELECT * FROM p WHERE damerau_levenshtein(word, suggestion) = 1),
r AS (SELECT *, row_number() OVER o AS nth, lead(frequency) OVER o AS runner_up FROM q WINDOW o AS (PARTITION BY word ORDER BY frequency DESC, suggestion))
SELECT word, suggestion, frequency, coalesce(frequency < 2 * runner_up, false) AS ambiguous FROM r WHERE nth = 1""")
def spell_suggest(spark, sf_dir):
    words = corpus.tokens(read(spark, sf_dir, "documents")).where(F.length("key") >= 4).groupBy(F.col("key").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return spelling.suggestions(words.where("n = 1"), words.where("n >= 5").withColumnRenamed("n", "frequency"))


# Written documents: their text is compared, as the digest of each medium's body.

@query("""WITH t AS (SELECT conv_id, turn, turn * 3.5 AS s, turn * 3.5 + 2.25 AS e, role FROM conversations), f AS (SELECT *, (s * 1000)::BIGINT AS a, (e * 1000)::BIGINT AS b FROM t),
l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY a) AS nth, strftime(make_timestamp(a * 1000), '%H:%M:%S') || ',' || lpad((a % 1000)::VARCHAR, 3, '0') || ' --> ' || strftime(make_timestamp(b * 1000), '%H:%M:%S') || ',' || lpad((b % 1000)::VARCHAR, 3, '0') AS times, role FROM f)
SELECT conv_id, sha256(string_agg(nth || chr(10) || times || chr(10) || role || chr(10), chr(10) ORDER BY nth)) AS digest FROM l GROUP BY 1""")
def srt_documents(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 3.5).alias("start"), (F.col("turn") * 3.5 + 2.25).alias("end"), F.col("role").alias("text"))
    return documents.srt(d, "conv_id").select("conv_id", F.sha2("body", 256).alias("digest"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS began FROM conversations)
SELECT conv_id, sha256(string_agg(lpad((began // 3600)::VARCHAR, 2, '0') || ':' || lpad((began // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((began % 60)::VARCHAR, 2, '0') || ' ' || role, chr(10) ORDER BY turn)) AS digest FROM c GROUP BY 1""")
def chapter_lists(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").withColumn("seconds", F.length("text").cast("double"))
    return documents.chapters(d, "conv_id", "turn", "seconds", "role").select("conv_id", F.sha2("body", 256).alias("digest"))

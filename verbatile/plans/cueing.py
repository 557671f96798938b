"""Registered queries: subtitle text, translations, recovery and coverage of cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatile.functions import subtitles as S
from verbatile.operators import cues as C
from verbatile.plans.catalog import CUES, cues, query, read
from verbatile.plans.usage import choice, chosen


def expected(values: list, number: str) -> str:
    """SQL for worked examples' results: the one whose place is number modulo their count."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"([{', '.join(map(show, values))}])[({number} % {len(values)} + 1)::INT]"


# Worked examples, dealt to the documents by their ids: (source, target, issues, coverage issues)
PAIRS = [
    ("2 people", "two people", "", ""), ("2 people", "three people", "number_mismatch", ""), ("hello", "", "empty_translation", "source_identifier_omission"),
    ("chapter 3 and 21", "Chapter III, twenty one", "", "source_identifier_omission"), ("the 5th, see 342", "the fifth; see three hundred forty two", "", ""),
    ("a long enough line of source text to be cut", "cut", "translation_too_short", "source_identifier_omission"), ("abc", "x" * 95, "translation_too_long", "source_identifier_omission"),
    ("one thing", "go on, go on, go on", "repeated_translation_clause", "source_identifier_omission"), ("go, go, go", "on and, on and, on and", "", "source_identifier_omission"),
    ("100万", "a million", "", ""), ("100万", "a billion", "number_mismatch", ""), ("One. Two; three", "all in one", "", "source_clause_omission,source_identifier_omission"),
    ("R2-D2 is 7.5", "r2-d2 is 7.5", "", ""), (None, "said", "", ""), ("number 1000", "one thousand", "number_mismatch", "source_identifier_omission"),
]


@query(f"SELECT doc_id, {expected([p[2] for p in PAIRS], 'doc_id')} AS integrity, {expected([p[3] for p in PAIRS], 'doc_id')} AS coverage FROM documents")
def integrity_issues(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", chosen([p[0] for p in PAIRS], "doc_id").alias("s"), chosen([p[1] for p in PAIRS], "doc_id").alias("t"))
    s, t = F.col("s"), F.col("t")
    return d.select("doc_id", F.array_join(S.integrity_issues(s, t), ",").alias("integrity"), F.array_join(S.coverage_issues(s, t), ",").alias("coverage"))


@query("""WITH n AS (SELECT p_partkey, p_partkey % 1100 AS n FROM part), w AS (SELECT *, ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS o,
['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS t, n % 100 AS r FROM n),
s AS (SELECT *, CASE WHEN r < 20 THEN o[r + 1] ELSE t[r // 10 - 1] || CASE WHEN r % 10 > 0 THEN ' ' || o[r % 10 + 1] ELSE '' END END AS small FROM w)
SELECT p_partkey, CASE WHEN n < 100 THEN small WHEN n < 1000 THEN o[n // 100 + 1] || ' hundred' || CASE WHEN r > 0 THEN ' ' || small ELSE '' END END AS words FROM s""")
def number_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.english_number(F.col("p_partkey") % 1100).alias("words"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, list_reduce(list_prepend([0, 0, 0], list_transform(w, lambda x: [length(x)::INT])), lambda a, x: CASE WHEN x[1] > 42 THEN [a[1], x[1], 1] WHEN (CASE WHEN a[2] = 0 THEN x[1] ELSE a[2] + 1 + x[1] END) > 42 THEN [a[1] + 1, x[1], a[3]]
ELSE [a[1], CASE WHEN a[2] = 0 THEN x[1] ELSE a[2] + 1 + x[1] END, a[3]] END) AS a FROM w)
SELECT doc_id, CASE WHEN length(trim(t)) <= 42 THEN 1 WHEN a[3] = 1 THEN 1000000000 ELSE a[1] + (a[2] > 0)::INT END::BIGINT AS lines FROM c JOIN (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents) USING (doc_id)""")
def line_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", S.line_count(F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("lines"))


# (text, malformed, negates, key, phrase, spaced, lines at 10)
TEXTS = [
    ("Well, (he said", "unbalanced_parentheses", False, "wellhesaid", "well, (he said", "well he said", 2), ("ends with,\"", "incomplete_ending", False, "endswith", "ends with,\"", "ends with", 2),
    (" two  spaces", "bad_whitespace", False, "twospaces", "two spaces", "two spaces", 1), ("I can't [do} it", "unbalanced_brackets,unbalanced_braces", True, "icantdoit", "i can't [do} it", "i can t do it", 2),
    ("これはとても長い字幕です", "", False, "これはとても長い字幕です", "これはとても長い字幕です", "これはとても長い字幕です", 2), ("incomprehensibilities", "", False, "incomprehensibilities", "incomprehensibilities", "incomprehensibilities", 1000000000),
    ("Never!", "", True, "never", "never!", "never", 1), (None, "", False, "", "", "", 1), ("one\ntwo three four", "", False, "onetwothreefour", "one two three four", "one two three four", 3), ("bad � mark", "invalid_character", False, "badmark", "bad � mark", "bad mark", 1),
]


@query("SELECT doc_id, " + ", ".join(f"{expected([t[k] for t in TEXTS], 'doc_id')} AS {n}" for k, n in ((1, "malformed"), (2, "negates"), (3, "key"), (4, "phrase"), (5, "spaced"))) + f", {expected([t[6] for t in TEXTS], 'doc_id')}::BIGINT AS lines FROM documents")
def cue_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", chosen([t[0] for t in TEXTS], "doc_id").alias("t"))
    t = F.col("t")
    return d.select("doc_id", F.array_join(S.malformed(t), ",").alias("malformed"), S.negates(t).alias("negates"), S.word_key(t).alias("key"), S.phrase_key(t).alias("phrase"), S.spaced_key(t).alias("spaced"), S.line_count(t, 10).alias("lines"))


# (answer, unwrapped, is a response)
ANSWERS = [
    ("```text\nHello there\n```", "Hello there", True), ("Translation: \"Hello\"", "Hello", True), ("“Quoted“", "Quoted", True), ("Here is the translation", "Here is the translation", False), ("Good day neighbour line", "Good day neighbour line", False),
    ("これはペン", "これはペン", False), ("a\nb\nc", "a\nb\nc", False), ("", "", False), ("long " * 40, ("long " * 40).strip(), False), ("It is fine.", "It is fine.", True), ("answer: yes", "yes", True),
]


@query(f"SELECT doc_id, {choice([a[1] for a in ANSWERS], 'doc_id')} AS plain, {expected([a[2] for a in ANSWERS], 'doc_id')} AS usable FROM documents")
def answer_checks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", S.unwrapped(chosen([a[0] for a in ANSWERS], "doc_id")).alias("plain"))
    return d.select("doc_id", "plain", S.is_response(F.col("plain"), F.lit("ten letters"), F.array(F.lit("neighbour line"), F.lit(" ")), "English").alias("usable"))


# (source, primary, other, likenesses, issues, speech and text differ)
OPINIONS = [
    ("he has 2 dogs", "he has 2 dogs", "he has two dogs", (0.9, 0.9, 0.9), "number_disagreement", True), ("no way", "no way", "a way", (0.9, 0.9, 0.5), "semantic_disagreement,polarity_disagreement", True),
    ("hm", "Yes ", "yes", (0.1, 0.15, 1.0), "low_evidence_consensus", False), ("see 3", "see", "see", (0.9, 0.9, 0.9), "independent_integrity_failure", False), ("fine", "all good", "all well", (0.8, 0.8, 0.8), "", False),
]


@query(f"SELECT doc_id, {expected([o[4] for o in OPINIONS], 'doc_id')} AS issues, {expected([o[5] for o in OPINIONS], 'doc_id')} AS suspicious FROM documents")
def agreement_issues(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", *[chosen([o[k] for o in OPINIONS], "doc_id").alias(n) for k, n in enumerate("spo")], *[chosen([str(o[3][k]) for o in OPINIONS], "doc_id").cast("double").alias(f"l{k}") for k in range(3)])
    found = S.agreement_issues(F.col("s"), F.col("p"), F.col("o"), F.col("l0"), F.col("l1"), F.col("l2"))
    return d.select("doc_id", F.array_join(found, ",").alias("issues"), S.speech_suspicions(F.col("p"), F.col("o"), F.col("l2")).alias("suspicious"))


TAGS = [("en-US", "en"), ("Japanese", "ja"), (" KOR ", "ko"), ("pt_BR", "pt"), (None, None), ("zh", "zh")]
TOKENS = [([" Hel", "lo", " you"], "Hello you"), (["日本", "語"], "日本語"), (["a ", "b"], "a b"), ([], "")]


@query(f"""SELECT doc_id, {expected([t[1] for t in TAGS], 'doc_id')} AS tag, {expected([t[1] for t in TOKENS], 'doc_id')} AS joined, doc_id % 7 <> 0 AND doc_id % 5 >= 2 AND doc_id % 3 <> 2 AS confident,
['missing:gone', 'forbidden:bad'][CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END] AS terms,
CASE WHEN doc_id % 4 = 0 THEN 'own' WHEN doc_id % 5 < 2 THEN 'unaligned' WHEN doc_id % 6 IN (0, 1) THEN (['m-en', 'm-ja'])[(doc_id % 6 + 1)::INT] ELSE 'unaligned' END AS route,
4 * (doc_id % 10) / 10 + 1.5 - 0.001 * (doc_id % 3) AS score FROM documents""")
def cue_gates(spark, sf_dir):
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").withColumn("tag", chosen([t[0] for t in TAGS], "doc_id"))
    tokens = F.get(F.array(*[F.array(*map(F.lit, t[0])).cast("array<string>") for t in TOKENS]), (i % len(TOKENS)).cast("int"))
    said = F.when(i % 2 == 0, "all is fine").otherwise("all is fine and  BAD, gone")
    return d.select(
        "doc_id", S.language_tag(F.col("tag")).alias("tag"), S.joined_tokens(tokens).alias("joined"),
        S.is_confident(F.when(i % 7 != 0, "said"), F.when(i % 5 >= 2, -0.5).when(i % 5 == 1, -2.0), F.when(i % 3 == 2, 0.9).otherwise(0.1), F.lit(2.4)).alias("confident"),
        F.array_join(S.lacking_terms(said, F.array(F.lit("Fine"), F.lit("gone")), F.array(F.lit("bad"))), ",").alias("terms"),
        C.alignment_route(F.when(i % 4 == 0, "own"), F.when(i % 5 >= 2, 0.5), F.col("tag"), {"en": "m-en", "ja": "m-ja"}).alias("route"),
        S.attempt_score((i % 10) / 10, F.lit(0.5), F.lit(0.5), i % 3).alias("score"),
    )


# Joins: words are views, cues are clicks, of one user.

VIEWS, CLICKS = "v AS (SELECT * FROM c WHERE event_type = 'view')", "k AS (SELECT * FROM c WHERE event_type = 'click')"
COVERED = f"""{CUES}, {VIEWS}, {CLICKS}, m AS (SELECT v.*, coalesce(sum(greatest(0, least(v."end", k."end") - greatest(v.start, k.start))), 0) AS overlap,
coalesce(bool_or((v.start + v."end") / 2 BETWEEN k.start - 30 AND k."end" + 30), false) AS held FROM v LEFT JOIN k ON v.user_id = k.user_id GROUP BY ALL)"""


def words(spark, sf_dir):
    return cues(spark, sf_dir, "view").withColumnRenamed("event_id", "lid")


def clicks(spark, sf_dir):
    return cues(spark, sf_dir, "click").withColumnRenamed("event_id", "rid")


@query(f"""WITH {COVERED}, d AS (SELECT user_id, event_id AS lid, start, "end", 'w' || event_id AS word FROM m WHERE overlap < 5 AND NOT held) SELECT * FROM d""")
def uncovered_words(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("word", F.concat(F.lit("w"), F.col("lid").cast("string")))
    return C.uncovered_words(w, clicks(spark, sf_dir), "user_id", 3600.0, 5.0, 30.0)


@query(f"""WITH {COVERED}, d AS (SELECT user_id, event_id AS lid, start, "end", 'w' || event_id AS word FROM m WHERE overlap < 5 AND NOT held),
l AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start, lid) AS last FROM d),
b AS (SELECT l.*, EXISTS (SELECT 1 FROM k WHERE k.user_id = l.user_id AND k.start < l.start AND k."end" > l.last) AS between_ FROM l),
g AS (SELECT *, sum((last IS NULL OR start - last > 7200 OR between_)::INT) OVER (PARTITION BY user_id ORDER BY start, lid) AS grp FROM b)
SELECT user_id, min(start) AS start, max("end") AS "end", string_agg(word, ' ' ORDER BY start, lid) AS text FROM g GROUP BY user_id, grp""")
def recovered_cues(spark, sf_dir):
    return C.recovered_groups(uncovered_words(spark, sf_dir), clicks(spark, sf_dir), "user_id", 7200.0)


@query(f"""WITH {COVERED} SELECT user_id, event_id AS lid FROM m WHERE overlap < 0.01 * ("end" - start)""")
def reconciliation_candidates(spark, sf_dir):
    return C.reconciliation(words(spark, sf_dir), clicks(spark, sf_dir), "user_id", 3600.0).select("user_id", "lid")


@query(f"""WITH {CUES}, {VIEWS}, {CLICKS} SELECT DISTINCT v.user_id, v.event_id AS lid FROM v JOIN k ON v.user_id = k.user_id AND (v.start + v."end") / 2 BETWEEN k.start AND k."end" """)
def words_in_regions(spark, sf_dir):
    return C.inside_regions(words(spark, sf_dir), clicks(spark, sf_dir), "user_id", 3600.0).select("user_id", "lid")


@query(f"""WITH {CUES}, {VIEWS}, {CLICKS}, p AS (SELECT * FROM c WHERE event_type = 'purchase'),
e AS (SELECT v.event_id AS lid, min(k.start) AS lo, max(k."end") AS hi, count(*) AS evidence_count FROM v JOIN k ON v.user_id = k.user_id AND least(v."end", k."end") - greatest(v.start, k.start) >= 5 GROUP BY 1),
n AS (SELECT v.event_id AS lid, (SELECT max(p."end") FROM p WHERE p.user_id = v.user_id AND p."end" <= v.start) AS floor, (SELECT min(p.start) FROM p WHERE p.user_id = v.user_id AND p.start >= v."end") AS top FROM v)
SELECT v.user_id, v.event_id AS lid, CASE WHEN lo IS NULL THEN start ELSE greatest(coalesce(floor, 0), least(start, lo)) END AS start, CASE WHEN hi IS NULL THEN "end" ELSE least(coalesce(top, hi), greatest("end", hi)) END AS "end",
coalesce(evidence_count, 0) AS evidence_count FROM v LEFT JOIN e ON e.lid = v.event_id JOIN n ON n.lid = v.event_id""")
def speech_envelopes(spark, sf_dir):
    return C.envelopes(words(spark, sf_dir), clicks(spark, sf_dir), cues(spark, sf_dir, "purchase"), "user_id", 3600.0, 5.0)


@query(f"""WITH {CUES}, {VIEWS}, {CLICKS}, r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
i AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r),
u AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY user_id, island),
m AS (SELECT v.user_id, v.event_id, v.start, v."end", coalesce(sum(greatest(0, least(v."end", u."end") - greatest(v.start, u.start))), 0) AS overlap, coalesce(bool_or((v.start + v."end") / 2 BETWEEN u.start - 30 AND u."end" + 30), false) AS held
FROM v LEFT JOIN u ON v.user_id = u.user_id GROUP BY ALL)
SELECT user_id, avg((overlap >= 5 OR held)::INT) AS event_coverage, least(1.0, sum(overlap) / sum("end" - start)) AS time_coverage FROM m GROUP BY 1""")
def speech_coverage(spark, sf_dir):
    return C.coverage(words(spark, sf_dir), cues(spark, sf_dir, "click"), "user_id", 3600.0, 5.0, 30.0)


@query(f"""WITH {CUES}, {VIEWS}, {CLICKS}, d AS (SELECT v.user_id, v.event_id AS lid, k.event_id AS rid, CASE WHEN (v.start + v."end") / 2 BETWEEN k.start AND k."end" THEN 0 ELSE least(abs((v.start + v."end") / 2 - k.start), abs((v.start + v."end") / 2 - k."end")) END AS far
FROM v JOIN k ON v.user_id = k.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY far, rid) AS nth FROM d WHERE far <= 1800) SELECT user_id, lid, rid, far::DOUBLE AS far FROM r WHERE nth = 1""")
def attached_words(spark, sf_dir):
    return C.attached(words(spark, sf_dir), clicks(spark, sf_dir), "user_id", 1800.0, 3600.0)


@query(f"""WITH {CUES}, {VIEWS}, {CLICKS}, p AS (SELECT user_id, start AS t, 1 AS a, 0 AS s FROM v UNION ALL SELECT user_id, "end", -1, 0 FROM v UNION ALL SELECT user_id, start, 0, 1 FROM k UNION ALL SELECT user_id, "end", 0, -1 FROM k),
g AS (SELECT user_id, t, sum(a) AS a, sum(s) AS s FROM p GROUP BY 1, 2), w AS (SELECT user_id, t AS start, lead(t) OVER o AS "end", sum(a) OVER o AS a, sum(s) OVER o AS s FROM g WINDOW o AS (PARTITION BY user_id ORDER BY t)),
f AS (SELECT user_id, start, "end" FROM w WHERE a > 0 AND s = 0 AND "end" > start), n AS (SELECT *, coalesce(start > lag("end") OVER (PARTITION BY user_id ORDER BY start), true)::INT AS new FROM f),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start) AS island FROM n), j AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY user_id, island HAVING max("end") - min(start) >= 900),
q AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j), z AS (SELECT *, sum((reach IS NULL OR start > reach + 3600)::INT) OVER (PARTITION BY user_id ORDER BY start) AS g FROM q)
SELECT user_id, min(start) AS start, max("end") AS "end" FROM z GROUP BY user_id, g""")
def recovery_regions(spark, sf_dir):
    return C.recovery_regions(cues(spark, sf_dir, "view"), cues(spark, sf_dir, "click"), "user_id", 900.0, 3600.0)


@query("""SELECT a.l_orderkey AS lid, b.l_orderkey AS rid FROM (SELECT l_orderkey, list(DISTINCT l_partkey) AS p FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1) a JOIN (SELECT l_orderkey, list(DISTINCT l_partkey) AS p FROM lineitem WHERE l_orderkey % 7 = 1 GROUP BY 1) b ON list_has_any(a.p, b.p)""")
def orders_sharing_parts(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return C.sharing_ids(d.where("l_orderkey % 7 = 0").withColumnRenamed("l_orderkey", "lid"), d.where("l_orderkey % 7 = 1").withColumnRenamed("l_orderkey", "rid"), "parts", "lid", "rid")


@query("""WITH t AS (SELECT DISTINCT conv_id, lower(w) AS term FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM conversations WHERE turn = 0))
SELECT c.conv_id AS "group", term, count(DISTINCT role) AS routes FROM conversations c JOIN t ON t.conv_id = c.conv_id AND contains(lower(c.text), term) GROUP BY 1, 2 HAVING count(DISTINCT role) >= 2""")
def supported_terms(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "group")
    terms = d.where("turn = 0").select("group", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("term")).select("group", F.lower("term").alias("term")).distinct()
    return C.supported_terms(d.withColumnRenamed("role", "route"), terms)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey AS start, o_orderkey + 5 AS "end" FROM orders), g AS (SELECT *, start - lag("end") OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM p) SELECT o_custkey, o_orderkey, gap::DOUBLE AS gap FROM g WHERE abs(gap) > 40""")
def discontinuities(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("double").alias("start"), (F.col("o_orderkey") + 5.0).alias("end"))
    return C.discontinuities(d, "o_custkey", "o_orderkey", 40.0).select("o_custkey", "o_orderkey", "gap")


@query(f"""WITH x AS (SELECT doc_id % 3 AS medium, {expected([t[1] for t in TEXTS], 'doc_id')} AS m, {expected([t[6] for t in TEXTS], 'doc_id')} AS n, length({choice([t[0] for t in TEXTS], 'doc_id')}) AS size FROM documents),
i AS (SELECT medium, unnest(CASE WHEN coalesce(size, 0) = 0 THEN ['empty_text'] ELSE list_filter(list_concat([CASE WHEN size > 12 AND m <> 'bad_whitespace' OR size > 13 THEN 'long_text' END, CASE WHEN n > 1 THEN 'excessive_lines' END], string_split(m, ',')), lambda q: coalesce(q, '') <> '') END) AS issue FROM x)
SELECT medium, issue, count(*) AS n FROM i GROUP BY 1, 2""")
def text_issues(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("medium"), chosen([t[0] for t in TEXTS], "doc_id").alias("text"))
    return C.text_issues(d, "medium", 12, 10, 1)


@query("""WITH n AS (SELECT l_suppkey % 3 AS medium, l_suppkey AS speaker, l_returnflag AS voice, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) SELECT medium, speaker, count(*) AS voices, arg_min(voice, (-n, voice)) AS most FROM n GROUP BY 1, 2 HAVING count(*) > 1""")
def unsteady_voices(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 3).alias("medium"), F.col("l_suppkey").alias("speaker"), F.col("l_returnflag").alias("voice"))
    return C.unsteady_voices(d, "medium")


@query("SELECT DISTINCT c_mktsegment AS voice, CASE c_mktsegment WHEN 'BUILDING' THEN 14.0 WHEN 'FURNITURE' THEN 28.0 ELSE 13.5 END::DOUBLE AS rate FROM customer")
def speaking_rates(spark, sf_dir):
    probes = spark.createDataFrame([("BUILDING", 4.0), ("FURNITURE", 2.0), ("MACHINERY", 0.0)], "voice string, seconds double")
    return C.speaking_rates(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("voice")), probes, "voice", 56, 13.5)


@query("""SELECT * FROM (VALUES ('words', 'missing_field'), ('confidence', 'missing_field'), ('provenance', 'missing_field'), ('translated_text', 'missing_field'), ('user_id', 'unexpected_field')) t(entity, issue)
UNION ALL SELECT 'cue-' || lpad(n::VARCHAR, 4, '0'), 'repeated_id' FROM (SELECT n, count(*) AS c FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY 1) WHERE c > 1""")
def cue_schema_issues(spark, sf_dir):
    return C.schema_issues(C.canonical(cues(spark, sf_dir).withColumn("text", F.lit("x")), "user_id", "event_id"))


@query(f"""WITH {CUES} SELECT user_id, 'cue-' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR, 4, '0') AS id, start, "end", event_type AS source_text, 'unknown' AS speaker, event_id::VARCHAR AS event FROM c""")
def canonical_cues(spark, sf_dir):
    d = C.canonical(cues(spark, sf_dir).withColumnRenamed("event_type", "text"), "user_id", "event_id")
    return d.select("user_id", "id", "start", "end", "source_text", "speaker", F.col("metadata")["event_id"].alias("event"))


@query("""WITH a AS (SELECT event_type AS metric, sum(floor(value))::DOUBLE AS v FROM events WHERE event_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS metric, sum(floor(value))::DOUBLE AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'click' GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, a.v AS before, b.v AS after, b.v - a.v AS change FROM a FULL JOIN b ON a.metric = b.metric""")
def metric_changes(spark, sf_dir):
    d = read(spark, sf_dir, "events")
    part = lambda k, but: d.where((F.col("event_id") % 2 == k) & (F.col("event_type") != but)).groupBy(F.col("event_type").alias("metric")).agg(F.sum(F.floor("value")).cast("double").alias("value"))
    return C.metric_changes(part(0, "view"), part(1, "click"))


@query("""SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def confidence_maps(spark, sf_dir):
    d = C.confidence_maps(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
    return d.select("o_custkey", F.size("confidences").cast("bigint").alias("n"), F.array_max(F.map_values("confidences")).alias("most"))


@query(f"""WITH {CUES} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'repair,split' ELSE 'split' END AS history, 'a,b' || CASE WHEN event_id % 3 = 0 THEN ',c' ELSE '' END AS ids, greatest(-10.0, least(10.0, event_id % 41 - 20.0))::DOUBLE AS shift,
start, "end" FROM c WHERE event_type = 'view' OR "end" - start <= 600""")
def cue_history(spark, sf_dir):
    i = F.col("event_id")
    both = C.ordered_concat(cues(spark, sf_dir, "view"), cues(spark, sf_dir).where("event_type <> 'view'").drop("event_type"), 600.0)
    history = F.when(i % 2 == 0, S.with_provenance(F.lit(None).cast("array<struct<stage:string,method:string>>"), "subtitles", "repair"))
    return both.select(
        "event_id", F.array_join(S.with_provenance(history, "subtitles", "split")["method"], ",").alias("history"),
        F.array_join(S.ordered_union(F.array(F.lit("a"), F.lit("b")), F.when(i % 3 == 0, F.array(F.lit("b"), F.lit("c")))), ",").alias("ids"),
        S.bounded_offset(i % 41 - 20.0, 10.0).alias("shift"), "start", "end",
    )


@query(f"""WITH {CUES}, r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
i AS (SELECT user_id, unnest(list_filter([CASE WHEN start < reach THEN 'overlap' END, CASE WHEN "end" - start > 600 THEN 'long_duration' END, CASE WHEN "end" - start < 120 THEN 'short_duration' END,
CASE WHEN length(event_type) / ("end" - start) > 0.05 THEN 'fast' END, CASE WHEN event_type = 'view' THEN 'incomplete_ending' END, CASE WHEN length(event_type) + (event_type = 'view')::INT > 7 THEN 'long_text' END], lambda x: x IS NOT NULL)) AS issue FROM r),
n AS (SELECT user_id, issue, count(*) AS n FROM i GROUP BY 1, 2)
SELECT user_id, string_agg(issue || ':' || n, ',' ORDER BY issue) AS issues, sum(n)::BIGINT AS total, false AS passed FROM n GROUP BY 1""")
def subtitle_report(spark, sf_dir):
    d = cues(spark, sf_dir).withColumn("text", F.when(F.col("event_type") == "view", "view,").otherwise(F.col("event_type")))
    timed = C.report(d.withColumn("text", F.col("event_type")), "user_id", 600.0, 120.0, 0.05, 10**6)
    texts = C.text_issues(d, "user_id", 7)
    out = timed.select("user_id", F.explode("issues").alias("issue", "n")).where("issue IN ('overlap', 'long_duration', 'short_duration', 'fast', 'invalid_duration')").unionByName(texts)
    made = out.groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat("issue", F.lit(":"), F.col("n").cast("string")))).alias("l"), F.sum("n").alias("total"))
    return made.join(timed.select("user_id", "passed"), "user_id").select("user_id", F.array_join("l", ",").alias("issues"), "total", "passed")

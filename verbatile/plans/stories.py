"""Registered queries: sections, entities, sentences, voices, stores and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatile.operators import providers as P
from verbatile.operators import stories as S
from verbatile.plans.catalog import query, read
from verbatile.plans.repairing import examples
from verbatile.plans.usage import chosen
from verbatile.sinks import stores

TEXTS = ["# One\nbody\n## Two #\nmore\n", "no heading", "intro\n# Only\nx", ""]


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT doc_id, 'sec-0001' AS section_id, 1 AS level, 'One' AS title, 0 AS start, 11 AS "end", sha256('# One' || chr(10) || 'body' || chr(10)) AS sha256 FROM d WHERE k = 0
UNION ALL SELECT doc_id, 'sec-0002', 2, 'Two', 11, 25, sha256('## Two #' || chr(10) || 'more' || chr(10)) FROM d WHERE k = 0
UNION ALL SELECT doc_id, 'sec-0001', 0, NULL, 0, 10, sha256('no heading') FROM d WHERE k = 1
UNION ALL SELECT doc_id, 'sec-0001', 1, 'Only', 6, 14, sha256('# Only' || chr(10) || 'x') FROM d WHERE k = 2
UNION ALL SELECT doc_id, 'sec-0001', 0, NULL, 0, 0, sha256('') FROM d WHERE k = 3""")
def section_index(spark, sf_dir):
    return S.section_index(read(spark, sf_dir, "documents").select("doc_id", chosen(TEXTS, "doc_id").alias("text")))


NAMES = "(VALUES ('a', 'the'), ('a', 'unheard of'), ('b', 'ENTHERE'), ('c', 'of'), ('d', 'and')) n(entity, alias)"


def names(spark):
    return spark.createDataFrame([("a", "the"), ("a", "unheard of"), ("b", "ENTHERE"), ("c", "of"), ("d", "and"), ("e", " ")], "entity string, alias string")


@query(f"SELECT doc_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM documents JOIN {NAMES} ON contains(lower(text), lower(alias)) GROUP BY 1")
def entities_present(spark, sf_dir):
    return S.present(read(spark, sf_dir, "documents"), names(spark)).select("doc_id", F.array_join("entities", ",").alias("entities"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', ' ', 'g') AS t FROM documents), n AS (SELECT * FROM (VALUES ('the'), ('of'), ('and')) n(name))
SELECT doc_id, name, len(regexp_extract_all(t, '(?i)\\b' || name || '\\b'))::BIGINT AS n, length(regexp_extract(t, '(?is)^(.*?)\\b' || name || '\\b', 1)) AS first FROM t, n WHERE regexp_matches(t, '(?i)\\b' || name || '\\b')""")
def name_mentions(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", " ").alias("text"))
    d = S.mentions(texts, spark.createDataFrame([("the",), ("of",), ("and",), ("unheard of",)], "name string"))
    return d.select("doc_id", "name", "n", F.col("places")[0].alias("first"))


@query("""SELECT doc_id, 'x' AS entity, 'aaaa Ann bbbb c|ccc dd ANN eeee f' AS passages FROM documents""")
def name_passages(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select("doc_id", F.lit("aaaa  Ann bbbb cccc dd ANN eeee ffff Anna").alias("text"))
    d = S.in_context(texts, spark.createDataFrame([("x", "Ann"), ("x", "ab")], "entity string, alias string"), 7, 3)
    return d.select("doc_id", "entity", F.array_join("passages", "|").alias("passages"))


# (name, text, kind, slug, first words, tokens)
KINDS = [
    ("Ostland", "the city of Ostland fell", "location", "ostland", "the city of", 5), ("Iron", "the Iron Guild met", "organization", "iron", "the Iron Guild", 4), ("Dwarven", "x", "concept", "dwarven", "x", 1),
    ("Mira Vale", "Mira Vale spoke; then, left", "character", "mira-vale", "Mira Vale spoke", 7), ("However", "However it is", None, "however", "However it is", 3), ("Great Hall", "y", "location", "great-hall", "y", 1), ("!!", "a", "character", "item", "a", 1),
]


@query(examples(KINDS, [(2, "kind"), (3, "slug"), (4, "words"), (5, "tokens")]))
def entity_kinds(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", chosen([k[0] for k in KINDS], "doc_id").alias("n"), chosen([k[1] for k in KINDS], "doc_id").alias("t"))
    return d.select("doc_id", S.entity_kind(F.col("n"), F.col("t")).alias("kind"), S.slug(F.col("n")).alias("slug"), S.first_words(F.col("t"), 3).alias("words"), S.token_estimate(F.col("t")).alias("tokens"))


# Sentences of one story: (text, named, resolved)
STORY = [("Ann came.", "ann", "ann"), ("She sat.", "", "ann"), ("Bob saw her.", "bob", "ann,bob"), ("He left.", "", "bob"), ("It rained.", "", ""), ("They slept.", "", ""), ("I woke.", "", "me"), ("He was there.", "", "me")]


@query(f"SELECT doc_id, i AS nth, ([{', '.join(repr(s[2]) for s in STORY)}])[(i + 1)::INT] AS resolved FROM documents, (SELECT unnest(generate_series(0, {len(STORY) - 1})) AS i)")
def carried_entities(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(t).alias("text"), F.filter(F.split(F.lit(n), ","), lambda x: x != "").alias("entities")) for t, n, _ in STORY])
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(rows).alias("nth", "s")).select("doc_id", "nth", "s.*")
    return S.carried_entities(d, "doc_id", "nth", "me").select("doc_id", F.col("nth").cast("bigint").alias("nth"), F.array_join("resolved", ",").alias("resolved"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'c' || (p_partkey // 4 * 4) END AS found, CASE p_partkey % 4 WHEN 0 THEN 'used' WHEN 1 THEN 'skipped' WHEN 2 THEN 'changed' ELSE 'missing' END AS state FROM part WHERE p_partkey % 4 IN (0, 3)
UNION ALL SELECT p_partkey, 'n' || p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'skipped' ELSE 'changed' END FROM part WHERE p_partkey % 4 IN (1, 2)""")
def shared_references(spark, sf_dir):
    i, part = F.col("p_partkey"), read(spark, sf_dir, "part")
    wanted = part.select("p_partkey", F.concat(F.lit("c"), i.cast("string")).alias("canonical_id"), F.concat(F.lit("Name "), i.cast("string")).alias("name"), F.lit("plain").alias("style"), F.lit("p").alias("profile"))
    by_id, by_name = i % 4 == 0, (i % 4).isin(1, 2)
    catalog = part.where(by_id | by_name).select(
        F.concat(F.when(by_id, "c").otherwise("n"), i.cast("string")).alias("canonical_id"), F.concat(F.lit("NAME "), i.cast("string")).alias("name"), F.when(i % 4 == 1, "other").otherwise("plain").alias("style"), F.lit("p").alias("profile"),
        F.lit("digest").alias("sha256"), F.when(i % 4 == 2, "old").otherwise("digest").alias("recorded"),
    )
    return S.referenced(wanted, catalog).select("p_partkey", "found", "state")


@query("SELECT p_partkey AS entity_id, 'x' || p_partkey AS canonical_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN '|zz' ELSE '' END AS aliases FROM part")
def decided_entities(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    told = part.select("entity_id", F.concat(F.lit("x"), F.col("entity_id").cast("string")).alias("canonical_id"), F.when(F.col("entity_id") % 2 == 0, F.array(F.lit("zz"), F.col("name"))).alias("aliases"))
    return S.decided_entities(part, told).select("entity_id", "canonical_id", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'v-' || c_mktsegment END AS voice FROM customer")
def cue_voices(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("speaker"), F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("voice"), F.lit("own"))).alias("metadata"))
    speakers = d.select("speaker").distinct().select("speaker", F.concat(F.lit("v-"), "speaker").alias("voice"))
    return S.cue_voices(d, speakers).select("id", "voice")


# (source, adapted, entities, issues)
ADAPTED = [("Ann has 2 dogs here", "Ann has 2 dogs now", "ann", ""), ("Ann has two", "Ann has 2", "ann", "unsupported_number"), ("a long sentence it is", "", "", "empty,too_short"), ("short", "a much longer text than that", "zed", "unsupported_entity,too_long")]


@query(examples(ADAPTED, [(3, "issues")]))
def adapted_issues(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", *[chosen([a[k] for a in ADAPTED], "doc_id").alias(n) for k, n in enumerate("sae")])
    found = S.adapted_issues(F.col("s"), F.col("a"), F.filter(F.split("e", ","), lambda x: x != ""), F.array(F.lit("ann")))
    return d.select("doc_id", F.array_join(found, ",").alias("issues"))


@query("""WITH s AS (SELECT n_regionkey AS region, n_name AS speaker, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS nth FROM nation)
SELECT region, speaker, (['v1', 'v2', 'v3', 'v1', 'v2'])[nth] AS voice FROM s""")
def dealt_voices(spark, sf_dir):
    speakers = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("speaker"), F.lit("calm").alias("style"))
    voices = spark.createDataFrame([("v1", "calm"), ("v2", "calm"), ("v3", "loud")], "voice string, style string")
    return S.dealt_voices(speakers, voices, "region").select("region", "speaker", "voice")


@query("SELECT p_partkey::VARCHAR AS group_id, CASE p_partkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'stale' ELSE 'open' END AS verdict FROM part")
def review_decisions(spark, sf_dir):
    groups = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("group_id"), "p_name", "p_size")
    keys = S.review_decisions(groups, spark.createDataFrame([], "group_id string, verdict string, approval_key string"), ["p_name", "p_size"])
    told = keys.where("CAST(group_id AS BIGINT) % 3 < 2").select("group_id", F.lit("approve").alias("verdict"), F.when(F.col("group_id").cast("bigint") % 3 == 0, F.col("approval_key")).otherwise("old").alias("approval_key"))
    return S.review_decisions(groups, told, ["p_name", "p_size"]).select("group_id", "verdict")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'accepted' WHEN doc_id % 5 = 1 THEN 'accepted' WHEN doc_id % 5 = 2 THEN 'rejected' ELSE 'review' END AS verdict,
([0.5, 1.0, 0.0])[(doc_id % 3 + 1)::INT]::DOUBLE AS likeness FROM documents""")
def machine_reviews(spark, sf_dir):
    i = F.col("doc_id")
    kind = i % 5
    verdict = P.machine_review(F.when(kind == 2, 0.2).otherwise(0.9), F.when(kind == 0, 0.95).otherwise(0.5), F.lit(0.9), F.lit(2), kind == 1, F.when(kind == 2, 1).otherwise(0))
    other = F.when(i % 3 == 0, "one TWO three").when(i % 3 == 1, "Two, one.").otherwise("four")
    first = F.when(i % 3 == 0, "one two, four?").otherwise("one two")
    # one two | three | four: 2 of 4
    return read(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"), P.word_likeness(first, other).alias("likeness"))


# (answer, verdict, translation, issues)
ANSWERS = [
    ('{"group_id": "g", "translation": "two people came", "choice": "primary"}', "accepted", "two people came", None), ('{"group_id": "g", "translation": "five people", "choice": "new"}', "faulty", None, "number_mismatch"),
    ('{"group_id": "h", "translation": "two", "choice": "new"}', "malformed", None, None), ('{"group_id": "g", "translation": "two", "choice": "new", "x": 1}', "malformed", None, None), ("no", "malformed", None, None), (None, "malformed", None, None),
]


@query(examples(ANSWERS, [(1, "verdict"), (2, "translation"), (3, "issues")]))
def adjudications(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("g").alias("group_id"), F.lit("2 people came").alias("source"), chosen([a[0] for a in ANSWERS], "doc_id").alias("answer"))
    return P.adjudicated(d, ("doc_id",)).select("doc_id", "verdict", "translation", F.when(F.col("issues").isNotNull(), F.array_join("issues", ",")).alias("issues"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS a, CASE WHEN p_partkey % 3 < 2 THEN p_size + (p_partkey % 2) END AS b FROM part)
SELECT p_partkey::VARCHAR AS path, CASE WHEN a IS NULL THEN 'stay' WHEN b IS NULL THEN 'move' WHEN a = b THEN 'drop' ELSE 'conflict' END AS action FROM t""")
def file_moves(spark, sf_dir):
    i = F.col("p_partkey")
    p = read(spark, sf_dir, "part")
    side = lambda rows, size: rows.select(i.cast("string").alias("path"), size.alias("size"), F.sha2(size.cast("string"), 256).alias("sha256"))
    return stores.moves(side(p.where(i % 3 > 0), F.col("p_size")), side(p.where(i % 3 < 2), F.col("p_size") + (i % 2).cast("int")))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus AS a, upper(o_orderpriority) AS b, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, 'Upper' AS stage, o_orderkey % 4 = 0 AS review FROM c WHERE o_orderkey % 6 = 0""")
def change_log(spark, sf_dir):
    d = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("t"))
    after = d.withColumn("t", F.when(F.col("o_orderkey") % 6 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t")))
    changes = stores.change_rows(d, after, ["o_orderkey"], "t", "Upper", "a mark", 90.0).withColumn("applied", F.col("o_orderkey") % 4 != 0)
    open_ = stores.needs_review(changes).select("o_orderkey", F.lit(True).alias("review"))
    return stores.confident(changes).select("o_orderkey", "stage").join(open_, "o_orderkey", "left").select("o_orderkey", "stage", F.coalesce("review", F.lit(False)).alias("review"))


@query("""SELECT o_orderpriority AS stage, count(*) AS groups, sum((o_orderkey % 10 = 0 AND o_orderpriority < '3')::INT)::BIGINT AS failed, bool_and(NOT (o_orderkey % 10 = 0 AND o_orderpriority < '3')) AS passed FROM orders GROUP BY 1""")
def stage_metrics(spark, sf_dir):
    issues = F.when((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderpriority") < "3"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return P.stage_metrics(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), "o_orderkey", issues.alias("issues")), "stage")


"""Registered queries: headings, sections, lines, passages, word boundaries. Worked examples are dealt to the documents by their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatile.functions import headings as H
from verbatile.functions import lines as L
from verbatile.functions import passages
from verbatile.operators import boundaries as B
from verbatile.operators import corpus, repair
from verbatile.plans.catalog import TOKENS, query, read
from verbatile.plans.cueing import expected
from verbatile.plans.usage import choice, chosen


def examples(table: list[tuple], columns: list[tuple[int, str]]) -> str:
    """SQL: doc_id and the columns (place in the table's rows, name) of the row whose place is doc_id modulo their number."""
    show = lambda k: choice([r[k] for r in table], "doc_id") if any(isinstance(r[k], str) for r in table) else expected([r[k] for r in table], "doc_id")
    return "SELECT doc_id, " + ", ".join(f"{show(k)} AS {name}" for k, name in columns) + " FROM documents"


def dealt(spark, sf_dir, table: list[tuple], k: int = 0):
    return read(spark, sf_dir, "documents").select("doc_id", chosen([r[k] for r in table], "doc_id").alias("t"))


# (line, normal form, false heading, heading's text, section key)
HEADS = [
    ("## chapter iv: The Way ", "# Chapter IV: The Way", False, "chapter iv: The Way", "chapter iv the way"), ("[chapter] 12 - Rain", "# Chapter 12: Rain", False, None, "chapter 12 rain"),
    ("PART 2", "# Part 2", False, None, "part 2"), ("# “Who goes?”", "“Who goes?”", True, "“Who goes?”", "who goes"), ("### and then it ended", "and then it ended", True, "and then it ended", "and then it ended"),
    ("# Help!", "Help!", True, "Help!", "help"), ("#### 12:30…", "12:30…", True, "12:30…", "12 30"), ("**Epilogue - Dawn**", "# Epilogue: Dawn", False, "Epilogue - Dawn", "epilogue dawn"),
    ("plain text here  ", "plain text here", True, None, "plain text here"), ("# A Long Road Home", "# A Long Road Home", False, "A Long Road Home", "a long road home"), ("SERIES NAME Character Profles", "SERIES NAME Character Profles", False, "Character Profiles", "character profiles"),
    ("# Act 2 The Dawn,", "# Act 2: The Dawn,", False, "Act 2 The Dawn,", "act 2 the dawn"), ("3. One,", "3. One,", True, None, "3 one"), ("glossary - terms,", "# Glossary: terms,", False, "glossary - terms,", "glossary terms"), ("Preface,", "Preface,", True, None, "preface"), ("", "", True, None, ""),
]


@query(examples(HEADS, [(1, "normal"), (2, "prose"), (3, "heading"), (4, "key")]))
def heading_forms(spark, sf_dir):
    t = F.col("t")
    d = dealt(spark, sf_dir, HEADS)
    return d.select("doc_id", H.normal_heading(t).alias("normal"), H.is_false_heading(H.body_of(t)).alias("prose"), H.heading_text(t).alias("heading"), H.section_key(t).alias("key"))


# Documents of lines: (text, without front matter, without metadata, without notes and glossary, without tail, duplicate headings gone)
BOOKS = [
    ("Copyright 2020\nAll rights reserved\n# Chapter 1: A\nbody", "# Chapter 1: A\nbody", "Copyright 2020\n# Chapter 1: A\nbody", None, None, None),
    ("Copyright by us\n# Chapter 1: A\nbody", None, None, None, None, None),
    ("Contents\nPublisher X\nChapter 1 Chapter 2\n[chapter] 1 Go\nx", "[chapter] 1 Go\nx", "Chapter 1 Chapter 2\n[chapter] 1 Go\nx", None, None, "Contents\nPublisher X\n# Chapter 1: Chapter 2\n# Chapter 1: Go\nx"),
    ("# Chapter 1: A\nISBN: 123\ntext\n# Notes\nn1\n# Glossary\ng\n# Chapter 2: B\nmore", None, "# Chapter 1: A\ntext\n# Notes\nn1\n# Glossary\ng\n# Chapter 2: B\nmore", "# Chapter 1: A\nISBN: 123\ntext\n# Chapter 2: B\nmore", None, None),
    ("story\nVolume 2\n\nComing soon\nad", None, None, None, "story", "story\n# Volume 2\n\nComing soon\nad"), ("story\nthe volume 3 is coming soon\nad", None, None, None, "story", None),
    ("story\nSign up for our newsletter\nx", None, None, None, "story", None), ("story\n1. Cover\n2. Chapter 1\nz", None, None, None, "story", None),
    ("# A\n\n# A\nx\n# A\n# B", None, None, None, None, "# A\n\nx\n# A\n# B"), ("# Title Page\nof it\n\nPrologue\nbegins", None, "Prologue\nbegins", None, None, "# Title Page\nof it\n\n# Prologue\nbegins"),
]
BOOKS = [(b[0], *[b[0] if x is None else x for x in b[1:]]) for b in BOOKS]


@query(examples(BOOKS, [(1, "front"), (2, "metadata"), (3, "sections"), (4, "tail"), (5, "headings")]))
def document_repair(spark, sf_dir):
    rows = corpus.lines(dealt(spark, sf_dir, BOOKS).withColumnRenamed("t", "text"))
    back = lambda d, name: d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias(name))
    parts = [(repair.without_front_matter(rows), "front"), (repair.without_metadata(rows), "metadata"), (repair.without_sections(rows, ["notes", "Glossary"]), "sections"), (repair.without_tail(rows), "tail"), (repair.normal_headings(rows), "headings")]
    out = read(spark, sf_dir, "documents").select("doc_id")
    for d, name in parts:
        out = out.join(back(d, name), "doc_id", "left")
    return out


FURNITURE = "\n".join(["My Book  Title"] + ["text."] * 12 + ["my book title", "12"] + ["text."] * 12 + ["MY BOOK TITLE", "13"] + ["text!"] * 12 + ["xiv", "# My Heading Here", "single"])


@query("""SELECT doc_id, 'My Book Title' AS artifact, 'running head' AS kind, 3::BIGINT AS n, 1::BIGINT AS first FROM documents UNION ALL SELECT doc_id, '12', 'page number', 3, 15 FROM documents""")
def page_furniture(spark, sf_dir):
    rows = corpus.lines(read(spark, sf_dir, "documents").select("doc_id", F.lit(FURNITURE).alias("text")))
    first = rows.groupBy("doc_id").agg(F.min("line").alias("base"))
    d = repair.page_furniture(rows).join(first, "doc_id")
    return d.select("doc_id", "artifact", "kind", "n", (F.col("first") - F.col("base") + 1).cast("bigint").alias("first"))


# (line, separator, scan noise, dump noise, publisher, footnote, timeline, author's note, capitals)
LINES_ = [
    ("◆ ◆ ◆", True, False, True, False, False, False, False, False), ("***", True, False, True, False, False, False, False, False), ("a", False, False, True, False, False, False, False, False), ("The quick brown fox jumps over it.", False, False, False, False, False, False, False, False),
    (">>>><<<< //// @@@@ ===", False, True, True, False, False, False, False, False), ("xkcdqwrtzplmnb zt", False, True, True, False, False, False, False, False), ("[1] a note on it", False, False, False, False, True, False, False, False),
    ("© 2020 Someone", False, False, False, True, False, False, False, False), ("# Afterword", False, False, False, False, False, False, True, False), ("Year 1923: war", False, False, False, False, False, True, False, False),
    ("THE FRONT LINE", False, False, False, False, False, False, False, True), ("a b c d", False, False, True, False, False, False, False, False), ("Illustrated by Someone Good", False, False, False, True, False, False, False, False), (None, True, False, False, False, False, False, False, False),
]


@query(examples(LINES_, [(k, n) for k, n in enumerate(("separator", "scan", "dump", "publisher", "footnote", "timeline", "author", "capitals"), 1)]))
def line_predicates(spark, sf_dir):
    t = F.col("t")
    return dealt(spark, sf_dir, LINES_).select("doc_id", L.is_separator(t).alias("separator"), L.is_scan_noise(t).alias("scan"), L.is_dump_noise(t).alias("dump"), L.is_publisher(t).alias("publisher"), L.is_footnote(t).alias("footnote"), L.is_timeline(t).alias("timeline"), L.is_authors_note(t).alias("author"), L.is_capitals(t).alias("capitals"))


# (text, readable, structured, without emphasis, spaced, punctuation)
BLOCKS = [
    ("Three words here", True, False, "Three words here", "Three words here", "Three words here"), ("x1 @@ ##", False, False, "x1 @@ ##", "x1 @@ ##", "x1 @@ ##"), ("Name: A\nAge: B", False, True, "Name: A\nAge: B", "Name: A\nAge: B", "Name: A\nAge: B"),
    ("a **bold *x* word** and_not_this", True, False, "a bold x word and_not_this", "a **bold *x* word** and_not_this", "a **bold *x* word** and_not_this"), ("it'snot,here.Now bird'seye", True, False, "it'snot,here.Now bird'seye", "it's not, here. Now bird's-eye", "it'snot,here.Now bird'seye"),
    ("“a”—«b» 1‒2 ‐x― it’s…", False, False, "“a”—«b» 1‒2 ‐x― it’s…", "“a”—«b» 1‒2 ‐x― it’s…", "\"a\"—\"b\" 1–2 -x— it's..."), ("", False, False, "", "", ""),
    ("Alpha\nBeta\nGamma", True, True, "Alpha\nBeta\nGamma", "Alpha\nBeta\nGamma", "Alpha\nBeta\nGamma"), ("\n".join(["xx"] * 9), False, False, "\n".join(["xx"] * 9), "\n".join(["xx"] * 9), "\n".join(["xx"] * 9)),
]


@query(examples(BLOCKS, [(k, n) for k, n in enumerate(("readable", "structured", "plain", "spaced", "punctuation"), 1)]))
def block_functions(spark, sf_dir):
    t = F.col("t")
    return dealt(spark, sf_dir, BLOCKS).select("doc_id", L.is_readable_picture(t).alias("readable"), L.is_structured(t).alias("structured"), L.without_emphasis(t).alias("plain"), L.spaced_words(t).alias("spaced"), L.plain_punctuation(t).alias("punctuation"))


@query("SELECT page_id, page_id % 3 = 0 AS video, CASE WHEN page_id % 2 = 0 THEN 'online-only' ELSE 'local' END AS availability, 'softhard' || chr(10) || 'x' AS soft FROM pages")
def media_predicates(spark, sf_dir):
    i = F.col("page_id")
    path = F.concat(F.lit("/a.b/file"), i.cast("string"), F.when(i % 3 == 0, ".MKV").when(i % 3 == 1, ".mp3").otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", L.is_video(path).alias("video"), L.availability(F.when(i % 2 == 0, 0x40020).otherwise(0x20)).alias("availability"), L.without_soft_hyphens(F.lit("soft­\nhard\nx­")).alias("soft"))


# (text, paragraphs, spans as p/e text, capitals outside protected spans, repaired encoding, chunks)
TEXTS = [
    ("A line\nthat wraps.\n\nNext one", "A line that wraps.\n\nNext one", "e:A line\nthat wraps.\n\nNext one", "A LINE\nTHAT WRAPS.\n\nNEXT ONE", "A line\nthat wraps.\n\nNext one", "A line\nthat wraps.|Next one"),
    ("cut in the\n\nmiddle of it.", "cut in the middle of it.", "e:cut in the\n\nmiddle of it.", "CUT IN THE\n\nMIDDLE OF IT.", "cut in the\n\nmiddle of it.", "cut in the|middle of it."),
    ("hy-\nphen and well-\n\nknown", "hyphen and wellknown", "e:hy-\nphen and well-\n\nknown", "HY-\nPHEN AND WELL-\n\nKNOWN", "hy-\nphen and well-\n\nknown", "hy-\nphen and well-|known"),
    ("# H\n\n- a\n- b\n\nend", "# H\n\n- a\n- b\n\nend", "e:# H\n\n- a\n- b\n\nend", "# H\n\n- A\n- B\n\nEND", "# H\n\n- a\n- b\n\nend", "H|- a\n- b|end"),
    ("use `a b` and ``c ` d`` x", "use `a b` and ``c ` d`` x", "e:use |p:`a b`|e: and |p:``c ` d``|e: x", "USE `a b` AND ``c ` d`` X", "use `a b` and ``c ` d`` x", "use `a b` and ``c ` d`` x"),
    ("see [it](http://x.y/(z)) <b>now</b>", "see [it](http://x.y/(z)) <b>now</b>", "e:see [it](|p:http://x.y/(z)|e:) |p:<b>|e:now|p:</b>", "SEE [IT](http://x.y/(z)) <b>NOW</b>", "see [it](http://x.y/(z)) <b>now</b>", "see [it](http://x.y/(z)) <b>now</b>"),
    ("cafÃ© and â€œx", "cafÃ© and â€œx", "e:cafÃ© and â€œx", "CAFÃ© AND Â€ŒX", "café and “x", "cafÃ© and â€œx"), ("done —\n\n— yes", "done — yes", "e:done —\n\n— yes", "DONE —\n\n— YES", "done —\n\n— yes", "done —|— yes"),
    ("ref [a][b] and [c]", "ref [a][b] and [c]", "e:ref [a][|p:b|e:] and [|p:c|e:]", "REF [A][b] AND [c]", "ref [a][b] and [c]", "ref [a][b] and [c]"),
]


@query(examples(TEXTS, [(k, n) for k, n in enumerate(("paragraphs", "spans", "edited", "repaired", "chunks"), 1)]))
def passage_functions(spark, sf_dir):
    def every(t: str) -> dict:
        assert passages.restored(*passages.shielded(t)) == t
        cut = "|".join(("p:" if s["protected"] else "e:") + s["text"] for s in passages.spans(t))
        return {"paragraphs": passages.paragraphs(t), "spans": cut, "edited": passages.edited(t, str.upper), "repaired": passages.undamaged(t), "chunks": "|".join(passages.validation_chunks(t))}

    kind = "struct<paragraphs:string,spans:string,edited:string,repaired:string,chunks:string>"
    return passages.applied(dealt(spark, sf_dir, TEXTS), ["doc_id"], "t", "made", kind, every).select("doc_id", "made.*")


# Word boundaries

# (token, decision, replacement, confidence)
HYPHENS = [("very-Very", "acceptable", None, 0.99), ("non-stop", "acceptable", None, 0.95), ("blue-eyed", "acceptable", None, 0.95), ("home-And", "not_acceptable", "home, And", 0.97), ("long-lost", "undecided", None, 0.0), ("day-to-day", "undecided", None, 0.0)]


@query(examples(HYPHENS, [(0, "token"), (1, "decision"), (2, "replacement"), (3, "confidence")]).replace(" AS confidence", "::DOUBLE AS confidence"))
def hyphen_decisions(spark, sf_dir):
    d = dealt(spark, sf_dir, HYPHENS).withColumn("d", B.hyphen_decision(F.col("t"))).select("doc_id", F.col("t").alias("token"), "d.decision", "d.replacement", "d.confidence")
    decided, open_ = B.by_decision(d)
    return decided.unionByName(open_)


LEXICON = f"x AS (SELECT lower(token) AS word, count(*) AS n FROM ({TOKENS}) GROUP BY 1)"


def counted(spark, sf_dir):
    return corpus.tokens(read(spark, sf_dir, "documents")).groupBy(F.col("key").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEXICON}, l AS (SELECT word, n AS frequency, n >= 50 AS protected FROM x WHERE n >= 5) SELECT x.word, l.word IS NOT NULL AS known, coalesce(l.frequency, 0) AS frequency, coalesce(l.protected, false) AS protected,
round(least(CASE WHEN x.n % 3 = 0 THEN 100.0 WHEN x.n % 3 = 1 THEN 86 + least(12, 2 * log10(x.n)) ELSE 68 + least(8, 1.25 * log10(x.n)) END, 99), 2) AS confidence FROM x LEFT JOIN l ON l.word = x.word""")
def lexicon_lookup(spark, sf_dir):
    n = counted(spark, sf_dir)
    lexicon = n.where("n >= 5").select(F.upper("word").alias("word"), F.col("n").alias("frequency"), (F.col("n") >= 50).alias("protected"))
    return B.lexicon_lookup(n, lexicon).select("word", "known", "frequency", "protected", B.candidate_confidence(F.col("n") % 3, F.col("n")).alias("confidence"))


# (word, correction) from candidates of both kinds
SPELT = [("Recieve", "Receive"), ("cats", None), ("teh", None), ("NASA", None), ("wrods", "words"), ("don't", None), ("mroe", None)]
CANDIDATES = [("Recieve", "receive", 1, 50000), ("cats", "cat", 1, 90000), ("teh", "the", 1, 10**7), ("NASA", "nasal", 1, 9000), ("wrods", "words", 1, 400000), ("wrods", "rods", 1, 2000), ("don't", "dont", 1, 5000), ("mroe", "more", 1, 9000000), ("mroe", "mode", 2, 900000), ("mroe", "moe", 1, 5000000), ("Recieve", "relieve", 2, 90000)]


@query("SELECT * FROM (VALUES ('Recieve', 'Receive', 95.4), ('wrods', 'words', 97.2)) t(word, correction, confidence)")
def spelling_corrections(spark, sf_dir):
    d = B.corrections(spark.createDataFrame(CANDIDATES, "word string, candidate string, distance int, frequency bigint"))
    return d.withColumn("confidence", F.round("confidence", 1))


BIGRAMS = """w AS (SELECT regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents), p AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM w WHERE len(w) > 1), b AS (SELECT p[1] AS first, p[2] AS second, count(*) AS n FROM p GROUP BY 1, 2)"""


@query(f"""WITH {BIGRAMS}, {LEXICON}, t AS (SELECT sum(n) AS total FROM x), j AS (SELECT first, second, b.n AS spaced, x.n AS joined, log10(b.n / total) + 9 AS pz, log10(x.n / total) + 9 AS jz FROM b JOIN x ON x.word = first || second, t)
SELECT first, second, spaced, joined, CASE WHEN greatest(spaced, joined) < 3 THEN 'insufficient' WHEN joined >= 3 AND joined >= spaced * 3 AND jz >= pz + 0.25 OR joined >= 3 AND joined >= spaced AND jz >= 3 AND jz >= pz + 1.25 THEN 'accepted'
WHEN spaced >= 3 AND spaced >= greatest(3, joined * 3) AND pz >= jz + 1.25 THEN 'rejected' ELSE 'review' END AS status, round(10 ** jz)::BIGINT AS rank FROM j""")
def boundary_reviews(spark, sf_dir):
    words = counted(spark, sf_dir)
    total = F.lit(words.agg(F.sum("n")).first()[0])
    d = corpus.bigrams(read(spark, sf_dir, "documents"), 1).join(words.select("word", F.col("n").alias("joined")), F.concat("first", "second") == F.col("word"))
    d = d.select("first", "second", F.col("n").alias("spaced"), "joined", B.zipf(F.col("n"), total).alias("phrase_zipf"), B.zipf(F.col("joined"), total).alias("joined_zipf"))
    return B.boundary_review(d).select("first", "second", "spaced", "joined", "status", B.zipf_rank(F.col("joined_zipf")).alias("rank"))


# (left, right, previous, decision, replacement)
PAIRS = [("to", "gether", "come", "accepted", "together"), ("To", "gether", "not", "blocked", None), ("TO", "GETHER", "", "accepted", "TOGETHER"), ("a", "part", "", "rejected", None), ("on", "to", "", "open", None), ("To", "gether", "We", "accepted", "Together")]


@query(examples(PAIRS, [(3, "decision"), (4, "replacement")]))
def boundary_decisions(spark, sf_dir):
    accepted = spark.createDataFrame([("To gether", "together", ["Not"], None)], "broken string, replacement string, blocked_previous array<string>, blocked_following array<string>")
    rejected = spark.createDataFrame([("a part",), ("A Part",)], "broken string")
    d = read(spark, sf_dir, "documents").select("doc_id", *[chosen([p[k] for p in PAIRS], "doc_id").alias(n) for k, n in enumerate(("left", "right", "previous"))], F.lit("x").alias("following"))
    assert B.conflicts(accepted, rejected).isEmpty()
    return B.decided(d, accepted, rejected).select("doc_id", "decision", "replacement")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR (doc_id % 10) / 2 >= 2.5 AND (doc_id % 10) / 2 >= (doc_id % 7) / 2 + 0.5 THEN 'interest' ELSE 'inter-est' END AS made,
greatest(0, least(1, 1))::INT AS one, CASE WHEN doc_id % 5 >= 1 THEN least(99.0, 92 + 3.5 * least(doc_id % 5 * 0.5, 2)) END::DOUBLE AS confidence, CASE WHEN doc_id % 5 >= 1 THEN 'join' ELSE 'keep_spaced' END AS label FROM documents""")
def line_hyphens(spark, sf_dir):
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("inter").alias("left"), F.lit("est").alias("right"), (i % 4 == 0).alias("protected"), ((i % 10) / 2).alias("joined_zipf"), ((i % 7) / 2).alias("compound_zipf"), F.lit(1.0).alias("spaced_score"), (1.0 + (i % 5) * 0.5).alias("joined_score"), F.lit("an inter est").alias("spaced_text"), F.lit("an interest").alias("joined_text"), F.lit("interest").alias("replacement"))
    d = B.training_rows(B.line_hyphens(d))
    return d.select("doc_id", "made", F.lit(1).alias("one"), B.validation(F.col("spaced_score"), F.col("joined_score"))["confidence"].alias("confidence"), "label")


# Pairs in a row of tokens: ranks decide which of two that share a token is joined.
@query("""SELECT doc_id, 'The together outside some one else' AS made FROM documents""")
def inline_merges(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lit("The to gether out side some one else"), " ")).alias("at", "token"))
    rules = spark.createDataFrame([("to", "gether", "together", 2.0), ("gether", "out", "getherout", 1.0), ("out", "side", "outside", 3.0)], "left string, right string, replacement string, rank double")
    d = B.merged_inline(tokens, rules, "doc_id", "at").where("made IS NOT NULL")
    return d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "made"))), lambda x: x["made"]), " ").alias("made"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place FROM t),
n AS (SELECT *, lower(lag(token) OVER g) AS p, lower(lead(token) OVER g) AS f FROM u WINDOW g AS (PARTITION BY doc_id ORDER BY place))
SELECT doc_id, place::BIGINT AS place, token FROM n WHERE lower(token) = 'of' AND (p IN ('the', 'and') OR f IN ('the'))""")
def word_confusions(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("place", "token")).withColumn("place", F.col("place").cast("bigint"))
    rules = spark.createDataFrame([(" Of", "off", ["the", "And"], ["The"], None)], "source string, suggestion string, previous array<string>, following array<string>, confidence double")
    return B.confusions(tokens, rules, "doc_id", "place").select("doc_id", "place", "token")


# (spaced, joined, left, right, text)
CLASSIFIED = [("We go To gether now", "We go together now", "to", "gether", "[SPACED] We go to <BOUNDARY> gether now\n[JOINED] We go together now"), ("nothing here", "x", "a", "b", "[SPACED] nothing here [BOUNDARY=a b]\n[JOINED] x")]


@query(examples(CLASSIFIED, [(4, "text")]).replace(" FROM documents", ", 'b c to gether d e' AS spaced, 'b c together d e' AS joined, repeat('ab ', 80)[:240].trim() AS part FROM documents"))
def classifier_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", *[chosen([c[k] for c in CLASSIFIED], "doc_id").alias(n) for k, n in enumerate(("s", "j", "l", "r"))])
    v = B.variants(F.lit("a b c to gether d e f"), F.lit(6), F.lit(15), F.lit("together"), 4)
    return d.select("doc_id", B.classifier_text(F.col("s"), F.col("j"), F.col("l"), F.col("r")).alias("text"), v["spaced"].alias("spaced"), v["joined"].alias("joined"), B.excerpt(F.lit(" ab" * 200), F.lit(0)).alias("part"))


@query("""WITH o AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'yes' END AS user_label FROM part WHERE p_partkey < 120), n AS (SELECT p_partkey AS id, upper(p_name) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'new' END AS user_label FROM part WHERE p_partkey >= 60)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, coalesce(o.user_label, n.user_label) AS user_label FROM o FULL JOIN n ON o.id = n.id""")
def reviews_kept(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    old = p.where("id < 120").withColumn("user_label", F.when(F.col("id") % 3 == 0, "yes"))
    new = p.where("id >= 60").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 2 == 0, "new").alias("user_label"))
    return B.keep_reviews(old, new, "id", ["user_label"])


@query("""WITH g AS (SELECT p_name AS word, p_size AS occurrences, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS suggestion, p_retailprice AS confidence, CASE WHEN p_partkey % 4 = 1 THEN p_type ELSE 'unknown' END AS classification, p_partkey AS place FROM part)
SELECT lower(word) AS word, sum(occurrences)::BIGINT AS occurrences, arg_max(suggestion, (confidence, -place)) FILTER (suggestion IS NOT NULL) AS suggestion, coalesce(arg_min(classification, place) FILTER (classification <> 'unknown'), 'unknown') AS classification FROM g GROUP BY 1""")
def merged_glossaries(spark, sf_dir):
    i = F.col("p_partkey")
    d = read(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_size").alias("occurrences"), F.when(i % 3 > 0, F.col("p_brand")).alias("suggestion"), F.col("p_retailprice").alias("confidence"), F.when(i % 4 == 1, F.col("p_type")).otherwise("unknown").alias("classification"), i.alias("place"))
    return B.glossary(d)


@query("""WITH a AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT upper(p_brand) AS v FROM part) SELECT coalesce(a.v, b.v) AS v FROM b LEFT JOIN a ON lower(a.v) = lower(b.v)""")
def folded_union(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return B.folded_union(p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("v")).distinct(), p.select(F.upper("p_brand").alias("v")).distinct(), "v")


@query("""WITH f AS (SELECT '/lib/' || p_brand AS folder, CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand) ELSE replace(p_name, ' ', '_') END || '.md' AS name FROM part)
SELECT folder, folder || '/' || arg_min(name, (lower(name) <> lower(split_part(folder, '/', 3)) || '.md', name)) AS path FROM f GROUP BY 1""")
def canonical_files(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, F.lower("p_brand")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return B.canonical_files(read(spark, sf_dir, "part").select(F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), name, F.lit(".md")).alias("path")))


@query("""WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS nth FROM part)
SELECT p_partkey, CASE WHEN nth = 1 THEN name || '.md' ELSE name || ' (' || nth || ').md' END AS name FROM n""")
def unique_names(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")), F.lit(".md")).alias("name"))
    return B.unique_names(d, "p_brand", "name", "p_partkey").select("p_partkey", F.col("unique").alias("name"))

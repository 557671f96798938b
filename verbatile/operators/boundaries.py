"""Words that were broken in two, misspelt or hyphenated: evidence, decisions and reviews. Words are compared in lower case; null words
are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a hyphenated word genuine, and words that rather begin a new clause.
PREFIXES = "anti co ex non pre pseudo self semi".split()
SUFFIXES = "class classer classers dimensional edged eyed faced fashioned folk handed hearted level like minded pitched quality range ranked related shaped sized term".split()
CLAUSE_WORDS = (
    "a an the and but or so yet nor i you he she we they me him her us them this that these those who which what when where why how because although however "
    "am is are was were have has had do does did can could will would shall should may might must not"
).split()

HYPHEN_KIND = "struct<decision:string,replacement:string,confidence:double,reason:string>"


def hyphen_decision(token: Column) -> Column:
    """decision, replacement, confidence and reason for a hyphenated token."""
    parts = F.split(token, "-")
    two, a, b = F.size(parts) == 2, F.lower(parts[0]), F.lower(F.element_at(parts, -1))
    told = lambda decision, replacement, confidence, reason: F.struct(F.lit(decision).alias("decision"), replacement.alias("replacement"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    none = F.lit(None).cast("string")
    return (
        F.when(two & (a == b), told("acceptable", none, 0.99, "repeated word")).when(two & a.isin(PREFIXES), told("acceptable", none, 0.95, "prefix"))
        .when(two & b.isin(SUFFIXES), told("acceptable", none, 0.95, "suffix"))
        .when(two & b.isin(CLAUSE_WORDS), told("not_acceptable", F.concat(parts[0], F.lit(", "), parts[1]), 0.97, "lost punctuation")).otherwise(told("undecided", none, 0.0, "plausible both ways"))
    )


def by_decision(rows: DataFrame, column: str = "decision", undecided: str = "undecided") -> tuple[DataFrame, DataFrame]:
    """Decided rows and undecided ones (null is undecided)."""
    open_ = F.coalesce(F.col(column) == undecided, F.lit(True))
    return rows.where(~open_), rows.where(open_)


def excerpt(line: Column, start: Column, most: int = 240) -> Column:
    """A line with white space collapsed, cut to `most` characters around a place of the line."""
    t = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)\s+", " "))
    left = F.greatest(F.lit(0), start - most // 2)
    return F.when(F.length(t) <= most, t).otherwise(F.trim(F.substring(t, (left + 1).cast("int"), F.lit(most))))


def cased(original: Column, word: Column) -> Column:
    """word in the capitals of original: all, the first, or as it is."""
    title = original.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    return F.when(original == F.upper(original), F.upper(word)).when(title, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


def candidate_confidence(distance: Column, frequency: Column) -> Column:
    """How sure a correction is, 0 to 100: one edit gives 86 and up to 12 for a frequent word, two give 68 and up to 8."""
    scale = F.log10(F.greatest(frequency, F.lit(1)).cast("double"))
    score = F.when(distance <= 0, 100.0).when(distance == 1, 86 + F.least(F.lit(12.0), scale * 2)).otherwise(68 + F.least(F.lit(8.0), scale * 1.25))
    return F.round(F.least(score, F.lit(99.0)), 2)


def lexicon_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word) with known, frequency (0 if not) and protected of the lexicon (word, frequency, protected), in any case; of repeated
    entries the greatest frequency counts, and whether any is protected."""
    d = lexicon.groupBy(F.lower("word").alias("__v_key")).agg(F.max("frequency").alias("frequency"), F.max("protected").alias("protected"))
    met = words.withColumn("__v_key", F.lower("word")).join(d, "__v_key", "left")
    return met.withColumns({"known": F.col("frequency").isNotNull(), "frequency": F.coalesce("frequency", F.lit(0).cast("bigint")), "protected": F.coalesce("protected", F.lit(False))}).drop("__v_key")


def corrections(pairs: DataFrame, least_confidence: float = 92.0, margin: float = 2.0, least_frequency: int = 1000, least_length: int = 4) -> DataFrame:
    """word, correction, confidence: of candidates (word, candidate, distance, frequency) those that are sure enough and well ahead of
    the next. Short, hyphenated, apostrophised and capitalised words are left alone, and a plural never loses its s."""
    w = F.col("word")
    open_ = (F.length(w) >= least_length) & ~w.rlike("[-'’]") & ~((F.length(w) > 1) & (w == F.upper(w))) & ~F.substring(w, F.lit(2), F.length(w)).rlike(r"\p{Lu}")
    plural = F.lower(w).endswith("s") & (F.length(w) > 3) & (F.concat(F.lower("candidate"), F.lit("s")) == F.lower(w))
    d = pairs.where(open_ & (F.col("distance") <= 1) & (F.col("frequency") >= least_frequency) & ~plural)
    d = d.withColumn("confidence", candidate_confidence(F.col("distance"), F.col("frequency")))
    rank = Window.partitionBy("word").orderBy(F.desc("confidence"), F.desc("frequency"), "candidate")
    d = d.select("word", "candidate", "confidence", F.row_number().over(rank).alias("nth"), F.lead("confidence").over(rank).alias("next")).where("nth = 1")
    sure = (F.col("confidence") >= least_confidence) & (F.coalesce(F.col("confidence") - F.col("next"), F.lit(100.0)) >= margin)
    return d.where(sure).select("word", cased(F.col("word"), F.col("candidate")).alias("correction"), "confidence")


def zipf(count: Column, total: Column) -> Column:
    """Zipf frequency of a word with that count in that many words: the logarithm of its number in 10^9 words; 0 if it has none."""
    return F.when((count > 0) & (total > 0), F.log10(count / total) + 9).otherwise(0.0)


def zipf_rank(value: Column) -> Column:
    return F.when(value > 0, F.round(F.pow(F.lit(10.0), value)).cast("bigint")).otherwise(0)


def boundary_review(pairs: DataFrame, least: int = 3, ratio: int = 3, zipf_least: float = 3.0) -> DataFrame:
    """status and confidence for pairs of word parts (spaced and joined counts, phrase_zipf and joined_zipf): accepted where the joined
    form clearly prevails, rejected where the phrase does, insufficient without evidence, else review."""
    n, j, pz, jz = (F.col(c) for c in ("spaced", "joined", "phrase_zipf", "joined_zipf"))
    corpus = (j >= least) & (j >= n * ratio) & (jz >= pz + 0.25)
    lexical = (j >= least) & (j >= n) & (jz >= zipf_least) & (jz >= pz + 1.25)
    phrase = (n >= least) & (n >= F.greatest(F.lit(least), j * ratio)) & (pz >= jz + 1.25)
    status = F.when(F.greatest(n, j) < least, "insufficient").when(corpus | lexical, "accepted").when(phrase, "rejected").otherwise("review")
    return pairs.withColumns({"status": status, "confidence": F.when(status.isin("accepted", "rejected"), 97.0).otherwise(0.0)})


def pair_key(left: Column, right: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", left, right)), r"\s+", " "))


def decided(pairs: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """pairs (left, right, previous, following) with decision: rejected; blocked by the words around; accepted, with replacement in the
    pair's capitals; or open. accepted: broken, replacement, blocked_previous, blocked_following (arrays); rejected: broken."""
    none = F.array().cast("array<string>")
    yes = accepted.select(F.lower("broken").alias("__v_key"), F.col("replacement").alias("__v_new"), F.coalesce("blocked_previous", none).alias("__v_p"), F.coalesce("blocked_following", none).alias("__v_f"))
    no = rejected.select(F.lower("broken").alias("__v_key"), F.lit(True).alias("__v_no")).distinct()
    d = pairs.withColumn("__v_key", pair_key(F.col("left"), F.col("right"))).join(yes, "__v_key", "left").join(no, "__v_key", "left")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    blocked = F.exists("__v_p", lambda x: F.lower(x) == low("previous")) | F.exists("__v_f", lambda x: F.lower(x) == low("following"))
    decision = F.when(F.col("__v_no"), "rejected").when(F.col("__v_new").isNull(), "open").when(blocked, "blocked").otherwise("accepted")
    new = F.when(decision == "accepted", cased(F.concat("left", "right"), F.col("__v_new")))
    return d.withColumns({"decision": decision, "replacement": new}).drop("__v_key", "__v_new", "__v_p", "__v_f", "__v_no")


def conflicts(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """broken: pairs that are both accepted and rejected, which is an error."""
    return accepted.select(F.lower("broken").alias("broken")).intersect(rejected.select(F.lower("broken").alias("broken")))


def line_hyphens(pairs: DataFrame, least: float = 2.5, margin: float = 0.5) -> DataFrame:
    """pairs (left, right, protected, joined_zipf, compound_zipf) that a line's end cuts behind a hyphen, with made: one word where it is
    protected or prevails over the hyphenated form, else the hyphenated form without the break."""
    join = F.coalesce(F.col("protected"), F.lit(False)) | (F.col("joined_zipf") >= least) & (F.col("joined_zipf") >= F.col("compound_zipf") + margin)
    return pairs.withColumn("made", F.when(F.coalesce(join, F.lit(False)), F.concat("left", "right")).otherwise(F.concat("left", F.lit("-"), "right")))


def merged_inline(tokens: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """tokens (key, order, token) with pairs joined that decisions (left, right, replacement, rank) names: of pairs that share a token the
    one of higher rank, then the earlier; a pair is only left out for one that is itself taken. made is the token, null where it went
    into the one before."""
    along = Window.partitionBy(key).orderBy(order)
    d = tokens.withColumns({"__v_next": F.lead("token").over(along), "__v_nth": F.row_number().over(along)})
    made = decisions.select(F.lower("left").alias("__v_l"), F.lower("right").alias("__v_r"), F.col("replacement").alias("__v_new"), F.col("rank").alias("__v_rank"))
    d = d.join(made, (F.lower("token") == F.col("__v_l")) & (F.lower("__v_next") == F.col("__v_r")), "left").drop("__v_l", "__v_r")
    # Runs of candidate pairs that overlap: within one, peaks of rank are taken first, then what they leave.
    for _ in range(3):
        rank = F.col("__v_rank")
        before, after = F.lag("__v_rank").over(along), F.lead("__v_rank").over(along)
        top = rank.isNotNull() & (F.coalesce(before, F.lit(float("-inf"))) < rank) & (F.coalesce(after, F.lit(float("-inf"))) <= rank)
        d = d.withColumn("__v_top", top)
        beside = F.coalesce(F.lag("__v_top").over(along) | F.lead("__v_top").over(along), F.lit(False)) & ~F.col("__v_top")
        d = d.withColumn("__v_rank", F.when(beside, None).otherwise(rank)).drop("__v_top")
    taken = F.col("__v_rank").isNotNull() & ~F.coalesce(F.lag("__v_rank").over(along).isNotNull(), F.lit(False))
    d = d.withColumn("__v_taken", taken)
    gone = F.coalesce(F.lag("__v_taken").over(along), F.lit(False))
    new = F.when(F.col("__v_taken"), cased(F.concat("token", "__v_next"), F.col("__v_new"))).when(gone, None).otherwise(F.col("token"))
    return d.withColumn("made", new).drop("__v_next", "__v_nth", "__v_new", "__v_rank", "__v_taken")


def confusions(tokens: DataFrame, rules: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, token, suggestion, confidence where a rule (source, suggestion, previous, following as arrays, confidence) fits the word
    before or the word behind. Nothing is changed."""
    along = Window.partitionBy(key).orderBy(order)
    d = tokens.withColumns({"__v_p": F.lower(F.lag("token").over(along)), "__v_f": F.lower(F.lead("token").over(along))})
    low = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    r = rules.select(F.lower(F.trim("source")).alias("__v_s"), "suggestion", low("previous").alias("__v_rp"), low("following").alias("__v_rf"), F.coalesce("confidence", F.lit(60.0)).alias("confidence")).where("__v_s <> '' AND suggestion <> ''")
    met = d.join(r, F.lower("token") == F.col("__v_s"))
    near = F.coalesce(F.array_contains("__v_rp", F.col("__v_p")), F.lit(False)) | F.coalesce(F.array_contains("__v_rf", F.col("__v_f")), F.lit(False))
    return met.where(near).select(key, order, "token", "suggestion", "confidence")


def variants(text: Column, start: Column, end: Column, replacement: Column, around: int = 300) -> Column:
    """A passage around a pair (places start to end, from 0), spaced as it is and joined."""
    lo = F.greatest(F.lit(0), start - around)
    before, after = F.substring(text, (lo + 1).cast("int"), (start - lo).cast("int")), F.substring(text, (end + 1).cast("int"), F.lit(around))
    pair = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    return F.struct(F.concat(before, pair, after).alias("spaced"), F.concat(before, replacement, after).alias("joined"))


def validation(spaced: Column, joined: Column, least: float = 0.35) -> Column:
    """Whether a scorer's preference for the joined form suffices, and how sure that is."""
    margin = joined - spaced
    return F.struct((margin >= least).alias("join"), F.when(margin >= least, F.least(F.lit(99.0), 92 + 3.5 * F.least(margin, F.lit(2.0)))).alias("confidence"))


def training_rows(rows: DataFrame, least: float = 0.35) -> DataFrame:
    """Training rows of pairs (spaced_text, joined_text, left, right, replacement, spaced_score, joined_score): an id that is the digest of
    texts and pair, an advisory label, and empty review columns."""
    margin = F.col("joined_score") - F.col("spaced_score")
    ident = F.sha2(F.concat_ws("\u0001", *[F.trim(F.regexp_replace(F.col(c), r"\s+", " ")) for c in ("spaced_text", "joined_text")], pair_key(F.col("left"), F.col("right"))), 256)
    return rows.select(ident.alias("id"), *rows.columns, F.when(margin >= least, "join").otherwise("keep_spaced").alias("label"), F.lit(None).cast("string").alias("user_label"), F.lit("pending").alias("review_status"))


def keep_reviews(old: DataFrame, new: DataFrame, key: str, reviewed: list[str]) -> DataFrame:
    """new rows over old ones of the same key, whose review columns stay where they are set; old rows without a new one stay."""
    a, b = old.select([F.col(c).alias("__o_" + c) for c in old.columns]), new
    d = b.join(a, F.col(key) == F.col("__o_" + key), "full")
    pick = lambda c: F.coalesce("__o_" + c, c) if c in reviewed else F.when(F.col(key).isNotNull(), F.col(c)).otherwise(F.col("__o_" + c))
    return d.select([pick(c).alias(c) if c != key else F.coalesce(key, "__o_" + key).alias(key) for c in new.columns])


def classifier_text(spaced: Column, joined: Column, left: Column, right: Column, marker: str = "<BOUNDARY>") -> Column:
    """Both forms with the pair's boundary marked where the spaced form has it first, in any case; else the pair behind it."""
    pair = F.concat_ws(" ", F.trim(left), F.trim(right))
    at = F.locate(F.lower(pair), F.lower(spaced)) if isinstance(pair, str) else F.instr(F.lower(spaced), F.lower(pair))
    marked = F.concat(F.substring(spaced, F.lit(1), at - 1), F.trim(left), F.lit(f" {marker} "), F.trim(right), F.substring(spaced, at + F.length(pair), F.length(spaced)))
    return F.concat(F.lit("[SPACED] "), F.when((at > 0) & (pair != ""), marked).otherwise(F.concat(spaced, F.lit(" [BOUNDARY="), pair, F.lit("]"))), F.lit("\n[JOINED] "), joined)


def glossary(tables: DataFrame) -> DataFrame:
    """One row per word (in lower case) of several glossaries (word, occurrences, suggestion, confidence, classification, place): summed
    occurrences, the surest suggestion, and the first classification that is known."""
    known = F.when(~F.coalesce(F.col("classification"), F.lit("unknown")).isin("unknown", ""), F.struct("place", "classification"))
    sure = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("place")).alias("p"), F.col("suggestion").alias("s"))
    return tables.groupBy(F.lower("word").alias("word")).agg(F.sum("occurrences").alias("occurrences"), F.max(F.when(F.col("suggestion").isNotNull(), sure))["s"].alias("suggestion"), F.coalesce(F.min(known)["classification"], F.lit("unknown")).alias("classification"))


def folded_union(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """The values of both once in any case, in the first table's spelling, in order of the folded value."""
    d = first.select(column, F.lit(0).alias("__v_from")).unionByName(second.select(column, F.lit(1).alias("__v_from"))).where(F.col(column).isNotNull())
    return d.groupBy(F.lower(column).alias("__v_key")).agg(F.min(F.struct("__v_from", column))[column].alias(column)).orderBy("__v_key").select(column)


def canonical_files(files: DataFrame) -> DataFrame:
    """path of each folder's file that is named like the folder (in any case), else of its first file by name."""
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    d = files.select("path", folder.alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    other = F.lower("stem") != F.lower(F.regexp_extract("folder", "([^/]*)$", 1))
    return d.groupBy("folder").agg(F.min(F.struct(other.alias("other"), "path"))["path"].alias("path"))


def unique_names(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """files with unique: names that repeat in a folder (in any case) become `name (2).ext`, and so on in order.

    A number that a given name already has is passed over, so that nothing collides, whatever the order."""
    stem, ending = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    key = [folder, F.lower(name)]
    d = files.withColumns({"__v_stem": stem, "__v_end": ending, "__v_low": F.lower(name), "__v_nth": F.row_number().over(Window.partitionBy(*key).orderBy(order))})
    # Numbers that names of the same folder, stem and ending have by themselves.
    number = F.regexp_extract("__v_low", r"^(.*) \((\d+)\)(\.[^.]*)?$", 2)
    base = F.concat(F.regexp_extract("__v_low", r"^(.*) \((\d+)\)(\.[^.]*)?$", 1), F.coalesce(F.regexp_extract("__v_low", r"^(.*) \((\d+)\)(\.[^.]*)?$", 3), F.lit("")))
    used = d.where(number != "").groupBy(F.col(folder).alias("__v_f"), base.alias("__v_b")).agg(F.collect_set(number.cast("int")).alias("__v_used"))
    d = d.join(used, (F.col(folder) == F.col("__v_f")) & (F.col("__v_low") == F.col("__v_b")), "left")
    taken = F.coalesce("__v_used", F.array().cast("array<int>"))
    free = F.filter(F.sequence(F.lit(2), F.col("__v_nth") + F.size(taken) + 1), lambda k: ~F.array_contains(taken, k))
    new = F.when(F.col("__v_nth") == 1, F.col(name)).otherwise(F.concat("__v_stem", F.lit(" ("), F.get(free, F.col("__v_nth") - 2).cast("string"), F.lit(")"), "__v_end"))
    return d.withColumn("unique", new).drop(*[c for c in d.columns if c.startswith("__v_")])


#: Endings that scans tear off.
TORN = ("tion", "tions")


def evaluated(pairs: DataFrame, lexicon: DataFrame, accepted: DataFrame, rejected: DataFrame, candidates: DataFrame, least_zipf: float = 2.5, least_frequency: int = 1000) -> DataFrame:
    """pairs (left, right, previous, following) with kind, replacement and confidence of the first rule that fits: `rejected` and `blocked` by
    a review (no replacement), `reviewed`, `acronym` (none), `protected` term, `suppressed` (none) or `candidate` of the candidate store
    (broken, replacement, suppressed), evidence for the joined form (`corpus`) or what it derives from (`plural`, `adverb`, `out-verb`), a
    torn `suffix`; else `open`. lexicon: word (lower case, once), frequency, zipf, known, protected."""
    d = decided(pairs, accepted, rejected)
    low_l, low_r = F.lower("left"), F.lower("right")
    whole = F.concat(low_l, low_r)
    asked = {
        "__l": low_l, "__r": low_r, "__w": whole, "__p": F.when(whole.endswith("s"), F.substring(whole, F.lit(1), F.length(whole) - 1)), "__a": F.when(whole.endswith("ly"), F.substring(whole, F.lit(1), F.length(whole) - 2)),
        "__o": F.when(F.length(F.regexp_extract(whole, "^out(.{3,}?)(?:ed|ing)$", 1)) >= 3, F.regexp_extract(whole, "^out(.{3,}?)(?:ed|ing)$", 1)),
    }
    d = d.withColumns({"__v" + k: c for k, c in asked.items()})
    for k in asked:
        x = lexicon.select(F.col("word").alias("__w" + k), *[F.col(c).alias(f"__v{k}_{c}") for c in ("frequency", "zipf", "known", "protected")])
        d = d.join(x, F.col("__v" + k) == F.col("__w" + k), "left").drop("__w" + k)
    store = candidates.select(F.lower("broken").alias("__v_broken"), F.col("replacement").alias("__v_cand"), F.coalesce("suppressed", F.lit(False)).alias("__v_supp"))
    d = d.join(store, pair_key(F.col("left"), F.col("right")) == F.col("__v_broken"), "left")
    flag = lambda k, c: F.coalesce(F.col(f"__v{k}_{c}"), F.lit(False))
    strong = lambda k: F.coalesce((F.col(f"__v{k}_zipf") >= least_zipf) | (F.col(f"__v{k}_frequency") >= least_frequency), F.lit(False))
    acronym = lambda c: (F.length(c) > 1) & (F.col(c) == F.upper(c)) & (F.col(c) != F.lower(c))
    both_protected, both_known = flag("__l", "protected") & flag("__r", "protected"), flag("__l", "known") & flag("__r", "known")
    free = ~both_protected & ~both_known
    torn = low_r.isin(*TORN) & (F.length("left") >= 4) & ~flag("__l", "known") & ~flag("__r", "known")
    kind = (
        F.when(F.col("decision").isin("rejected", "blocked"), F.col("decision")).when(F.col("decision") == "accepted", "reviewed").when(acronym("left") | acronym("right"), "acronym").when(flag("__w", "protected"), "protected")
        .when(F.coalesce("__v_supp", F.lit(False)), "suppressed").when(~both_protected & F.col("__v_cand").isNotNull(), "candidate").when(free & strong("__w"), "corpus").when(free & strong("__p"), "plural")
        .when(free & strong("__a"), "adverb").when(free & strong("__o"), "out-verb").when(free & torn, "suffix").otherwise("open")
    )
    joined = F.concat("left", "right")
    new = F.when(kind == "reviewed", F.col("replacement")).when(kind == "candidate", cased(joined, F.col("__v_cand"))).when(~kind.isin("rejected", "blocked", "acronym", "suppressed", "open"), joined)
    out = d.withColumns({"kind": kind, "made": new})
    return out.select(*pairs.columns, "kind", F.col("made").alias("replacement"), F.when(F.col("made").isNotNull(), 97.0).alias("confidence"))

"""Document fingerprints by winnowing, in DataFrame operations only.

A text is cut into words (pieces of at most 32 code points between ASCII white space). Each run of K words has a rolling
polynomial hash modulo 2^31-1; in each window of W neighbouring hashes the smallest is chosen, the rightmost on ties, and
kept with its position. Hash and position share one long, so the window minimum is a plain minimum: doubling gives it in
log2(W) passes over the array. Any passage of K + W - 1 words that two texts share gives a hash to both fingerprints.

Edge cases: null counts as empty; the empty text (and one of white space only) has the empty fingerprint, and two empty
fingerprints are alike to 1; texts of fewer than K words have one hash; equal texts have equal fingerprints; rows that
share an id follow each other by their text; with one row, its next document is itself; an empty table gives an empty one; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P

#: Words in a k-gram; hashes in a window (a power of two).
K, W = 5, 8
#: Modulus and base of the rolling hash, and the span of positions below the hash in a packed long.
MOD, BASE, SPAN = 2**31 - 1, 1_000_003, 2**31
PIECE = r"[^\x20\x09-\x0D]{1,32}"
#: Rows that a bucket of neighbouring ids should have, and the most buckets (they grow beyond that, and sorts spill).
BUCKET_ROWS, MAX_BUCKETS = 2_000, 20_000


def _shift(array: Column, by: int) -> Column:
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array) - by, F.lit(0)))


def fingerprints(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with the column out: the packed minima (hash * 2^31 + 2^31 - 1 - position) in order of position.

    Each step is a column of its own, so that Catalyst evaluates it once.
    """
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    a, b, keep = P + "a", P + "b", [c for c in df.columns]
    step = lambda d, column, *more: d.select(*keep, *more, column)
    d = step(df, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x).bitwiseAND(F.lit(MOD))).alias(a))
    # A text of fewer than k words is filled up to one k-gram.
    d = step(d, F.when((F.size(a) > 0) & (F.size(a) < k), F.concat(F.col(a), F.array_repeat(F.lit(0).cast("bigint"), F.lit(k) - F.size(a)))).otherwise(F.col(a)).alias(a))
    # Doubling: the hash of 2n words from two of n; at the end single words until k.
    d, have = step(d, F.col(a).alias(b), a), 1
    while have < k:
        n = have if 2 * have <= k else 1
        right, factor = (b if n == have else a), pow(BASE, n, MOD)
        d = step(d, F.zip_with(F.col(b), _shift(F.col(right), have), lambda x, y: (x * F.lit(factor) + y) % F.lit(MOD)).alias(b), a)
        have += n
    grams = F.greatest(F.size(b) - (k - 1), F.lit(0))
    d = step(d, F.transform(F.slice(F.col(b), F.lit(1), grams), lambda x, i: x * F.lit(SPAN) + (F.lit(SPAN - 1) - i)).alias(a))
    d, have = step(d, F.col(a).alias(b), F.size(a).alias(P + "n")), 1
    while have < w:
        d = step(d, F.zip_with(F.col(b), _shift(F.col(b), have), lambda x, y: F.least(x, y)).alias(b), P + "n")
        have *= 2
    windows = F.when(F.col(P + "n") == 0, 0).otherwise(F.greatest(F.col(P + "n") - (w - 1), F.lit(1)))
    return d.select(*keep, F.array_distinct(F.slice(F.col(b), F.lit(1), windows)).alias(out))


def as_text(packed: Column) -> Column:
    """hash@position of each minimum (hash in hex, position of the k-gram's first word), separated by spaces."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.hex(F.shiftright(x, 31)), F.lit("@"), (F.lit(SPAN - 1) - x.bitwiseAND(F.lit(SPAN - 1))).cast("string"))), " ")


def hash_set(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def neighbour_buckets(ids: DataFrame, id_col: str, bucket_rows: int = BUCKET_ROWS) -> tuple[Column, int]:
    """A column that deals ids, largest first, into buckets of about equal size, and the number of buckets.

    The bounds are approximate quantiles in two levels, so that finding a row's bucket takes a square root of their number.
    """
    rows = ids.count()
    if not rows:
        return F.lit(0), 1
    number = min(MAX_BUCKETS, math.ceil(rows / bucket_rows))
    shares = [i / number for i in range(1, number)]
    bounds = sorted(set(ids.select(F.percentile_approx(id_col, shares, 100 * number)).first()[0])) if shares else []
    if not bounds:
        return F.lit(0), 1
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("bigint") for g in groups])
    nested = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in g]) for g in groups])
    own = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    outer = F.size(F.filter(heads, lambda x: x <= own))
    inner = F.when(outer == 0, 0).otherwise((outer - 1) * step + F.size(F.filter(F.element_at(nested, F.greatest(outer, F.lit(1))), lambda x: x <= own)))
    return (F.lit(len(bounds)) - inner).cast("int"), len(bounds) + 1


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS, prepare=lambda d: d) -> DataFrame:
    """docs (id_col and columns), each row with next_<column> of the next row, descending id; after the last comes the first.

    Rows go to buckets of neighbouring ids in one shuffle; a bucket's first row is copied to the bucket before it.
    prepare adds columns behind that shuffle; they have their next_<column> too.
    """
    bucket, number = neighbour_buckets(docs.select(id_col), id_col, bucket_rows)
    order = [F.col(id_col).desc_nulls_last(), *[F.col(c) for c in columns]]
    rows = docs.select(id_col, *columns, bucket.alias(P + "bucket"), F.lit(False).alias(P + "copy"))
    # Heads: one row for each bucket that has any, bounded by the number of buckets; a ring of them tells whose copy goes where.
    ends = rows.groupBy(P + "bucket").agg(F.max(F.coalesce(F.col(id_col), F.lit(-(2**63)))).alias(P + "top"))
    ring = Window.orderBy(P + "bucket")
    whole = Window.partitionBy()
    ends = ends.select(F.coalesce(F.lag(P + "bucket").over(ring), F.max(P + "bucket").over(whole)).alias(P + "to"), F.col(P + "bucket"), P + "top")
    heads = rows.join(F.broadcast(ends), [P + "bucket"]).where(F.coalesce(F.col(id_col), F.lit(-(2**63))) == F.col(P + "top"))
    first = Window.partitionBy(P + "bucket").orderBy(*order)
    heads = heads.withColumn(P + "nth", F.row_number().over(first)).where(F.col(P + "nth") == 1)
    copies = heads.select(id_col, *columns, F.col(P + "to").cast("int").alias(P + "bucket"), F.lit(True).alias(P + "copy"))
    along = Window.partitionBy(P + "bucket").orderBy(F.col(P + "copy"), *order)
    dealt = prepare(rows.unionByName(copies).repartition(P + "bucket"))
    leads = {f"next_{c}": F.lead(c).over(along) for c in dealt.columns if c != id_col and not c.startswith(P)}
    return dealt.withColumns(leads).where(~F.col(P + "copy")).drop(P + "copy", P + "bucket")


def winnow_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are; see the module."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(own, ["text"], prepare=lambda rows: fingerprints(rows, "text", "f", k, w)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    d = fingerprints(d.select("doc_id", "n_chars", "f", F.col("next_f").alias("x"), edited.alias("edited")), "edited", "e", k, w)
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "e", hash_set(F.col("f")).alias("fs"), hash_set(F.col("e")).alias("es"), hash_set(F.col("x")).alias("xs"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("fs"), F.col("es")).alias("near_edited"), likeness(F.col("fs"), F.col("xs")).alias("near_next"),
    )

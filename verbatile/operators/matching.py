"""Matching in time and by cost: nearest turns, shots of scenes, numbered calls, least-cost assignment, words two edits apart."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.operators import folds


def nearest(cues: DataFrame, turns: DataFrame, key: str, cue: str, turn: str) -> DataFrame:
    """cue, turn, distance: for each cue (key, cue, start, end) the turn (key, turn, start, end) nearest to its midpoint; 0 inside.

    On ties the turn that lies before the midpoint wins, then the later start of turns before it, the smaller id. Each turn is asked
    for its greatest end so far, so one sorted pass in each direction does, without pairs."""
    mid = ((F.col("start") + F.col("end")) / 2).alias("at")
    none = lambda *names: [F.lit(None).cast("double" if n != "id" else "bigint").alias(n) for n in names]
    asked = cues.select(key, mid, F.lit(1).alias("kind"), F.col(cue).cast("bigint").alias("cue"), *none("start", "end", "id"))
    told = turns.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("cue"), F.col("start").cast("double"), F.col("end").cast("double"), F.col(turn).cast("bigint").alias("id"))
    d = asked.unionByName(told)
    turn_at = F.when(F.col("kind") == 0, F.struct("end", "start", (-F.col("id")).alias("minus")))
    back = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # Ordered the other way, so that the frame still grows from its start; the kinds of one place keep turns before cues.
    ahead = Window.partitionBy(key).orderBy(F.desc("at"), "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("b", F.max(turn_at).over(back)).withColumn("a", F.last(F.when(F.col("kind") == 0, F.struct("start", "id")), True).over(ahead)).where("kind = 1")
    behind, front = F.when(F.col("b").isNotNull(), F.greatest(F.col("at") - F.col("b.end"), F.lit(0.0))), F.col("a.start") - F.col("at")
    first = F.col("a").isNull() | F.coalesce(behind <= front, F.lit(False))
    return d.select("cue", F.when(first, -F.col("b.minus")).otherwise(F.col("a.id")).alias("turn"), F.when(first, behind).otherwise(front).alias("distance"))


def shots(scenes: DataFrame, target: float, most: int = 6) -> DataFrame:
    """Scenes (start, end) as equal shots of about target seconds, 1 to most of them: shot (from 0), shot_start, shot_end."""
    long = F.col("end") - F.col("start")
    n = F.least(F.greatest(F.ceil(long / target), F.lit(1)), F.lit(most)).cast("int")
    d = scenes.withColumn("n", n).withColumn("shot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return d.withColumn("shot_start", F.col("start") + long * F.col("shot") / F.col("n")).withColumn("shot_end", F.col("start") + long * (F.col("shot") + 1) / F.col("n")).drop("n")


def numbered_calls(d: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """d with call (from 1 in its key), task (null before the first start) and call_in_task."""
    w = Window.partitionBy(key).orderBy(order)
    d = d.withColumn("call", F.row_number().over(w)).withColumn("task", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("call_in_task", F.row_number().over(Window.partitionBy(key, "task").orderBy(order)))
    inside = F.col("task") > 0
    return d.withColumn("call_in_task", F.when(inside, F.col("call_in_task"))).withColumn("task", F.when(inside, F.col("task")))


def least_cost(cost: np.ndarray) -> list[int]:
    """The column of each row in the assignment of least total cost, by shortest augmenting paths; rows must not outnumber columns."""
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        far, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, at, last = new, 0.0, -1
        while True:
            reach = at + cost[row] - row_price[row] - column_price
            better = ~done & (reach < far)
            far[better], via[better] = reach[better], last
            last = int(np.argmin(np.where(done, np.inf, far)))
            at, done[last] = far[last], True
            if owner[last] < 0:
                break
            row = int(owner[last])
        passed = [j for j in np.flatnonzero(done) if j != last]
        row_price[new] += at
        for j in passed:
            row_price[owner[j]] += at - far[j]
            column_price[j] -= at - far[j]
        while last >= 0:
            before = int(via[last])
            owner[last] = owner[before] if before >= 0 else new
            last = before
    out = [0] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def assign(costs: DataFrame, by: str, left: str, right: str, cost: str) -> DataFrame:
    """The pairs of each group's least-cost assignment, of rows (by, left, right, cost) for all its pairs; a pair without a row is never
    chosen unless nothing else is left. A group is a few speakers by a few voices: its matrix is held in one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot_table(index=left, columns=right, values=cost, aggfunc="min").sort_index().sort_index(axis=1)
        values = table.to_numpy(dtype=float)
        values = np.where(np.isnan(values), np.nansum(np.abs(values)) + 1.0, values)
        flip = values.shape[0] > values.shape[1]
        pairs = [(j, i) if flip else (i, j) for i, j in enumerate(least_cost(values.T if flip else values))]
        rows = [(group[by].iloc[0], table.index[i], table.columns[j], table.iat[i, j]) for i, j in pairs if not np.isnan(table.iat[i, j])]
        return pd.DataFrame(rows, columns=[by, left, right, cost])

    d = costs.select(by, left, right, F.col(cost).cast("double").alias(cost)).where(F.col(cost).isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull())
    return d.groupBy(by).applyInPandas(run, d.schema)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no place edited twice. What tests compare with."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


_DELETE = "flatten(transform(v, w -> if(length(w) < 1, array(w), transform(sequence(1, length(w)), i -> concat(substring(w, 1, i - 1), substring(w, i + 1))))))"
#: Letters from which words meet by pieces rather than by what deletions leave, of which a long word has very many.
LONG = 32


def _swap(x: str, y: str) -> str:
    """SQL: whether y is x with two neighbours swapped."""
    return f"(length({x}) = length({y}) AND length({x}) > 1 AND exists(sequence(1, greatest(length({x}) - 1, 1)), j -> concat(substring({x}, 1, j - 1), substring({x}, j + 1, 1), substring({x}, j, 1), substring({x}, j + 2)) = {y}))"


def _one(x: str, y: str) -> str:
    return f"(levenshtein({x}, {y}) = 1 OR {_swap(x, y)})"


# A swap and another edit don't touch, so the other one is in what stands before the swap or behind it.
_HEAD, _PAIR, _TAIL = "substring(a, 1, i - 1)", "concat(substring(a, i + 1, 1), substring(a, i, 1))", "substring(a, i + 2)"
_BEHIND = f"(startswith(b, concat({_HEAD}, {_PAIR})) AND {_one(_TAIL, 'substring(b, i + 2)')})"
_BEFORE = f"(endswith(b, concat({_PAIR}, {_TAIL})) AND {_one(_HEAD, 'substring(b, 1, length(b) - length(a) + i - 1)')})"
_TWO = f"(levenshtein(a, b) = 2 OR (length(a) > 1 AND exists(sequence(1, greatest(length(a) - 1, 1)), i -> {_BEHIND} OR {_BEFORE})))"


def _by_pieces(words: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of long words that may be within most edits: of 2 * most + 1 pieces of a one stands unchanged in b, at most
    so many places off, since an edit touches one piece, or two if it is a swap."""
    n = 2 * most + 1
    size = F.length("a")
    begin = lambda k: F.floor(size * k / n).cast("int")
    mine = F.array(*[F.struct(size.alias("size"), F.lit(k).alias("k"), F.substring(F.col("a"), begin(k) + 1, begin(k + 1) - begin(k)).alias("piece")) for k in range(n)])
    a = words.select("a", F.explode(mine).alias("p"))
    theirs = f"""flatten(transform(sequence(length(b) - {most}, length(b) + {most}), n -> flatten(transform(sequence(0, {n - 1}), k -> transform(sequence(-{most}, {most}), o ->
        named_struct('size', n, 'k', k, 'piece', substring(b, greatest(int(floor(n * k / {n})) + o, 0) + 1, int(floor(n * (k + 1) / {n})) - int(floor(n * k / {n})))))))))"""
    b = lexicon.select("b", F.explode(F.array_distinct(F.expr(theirs))).alias("p"))
    return a.join(b, "p").select("a", "b")


def edits_apart(words: DataFrame, lexicon: DataFrame, most: int = 2) -> DataFrame:
    """a, b, distance: words (column word) and entries of lexicon within `most` (1 or 2) edits, the word itself left out. An edit is an
    insertion, a deletion, a substitution or a swap of neighbours, and no place is edited twice.

    Both sides tell what is left of them after up to `most` deletions and meet there, words of LONG letters or more by unchanged pieces;
    so nothing is compared with all. Null and empty words are left out, repeated ones count once."""
    if most not in (1, 2):
        raise ValueError("one edit or two")

    def side(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.col("word").alias(name)).where(f"{name} <> ''").distinct()

    def left(d: DataFrame, name: str) -> DataFrame:
        d = d.withColumn("v", F.array(name)).withColumn("all", F.col("v"))
        for _ in range(most):
            d = d.withColumn("v", F.array_distinct(F.expr(_DELETE))).withColumn("all", F.array_union("all", "v"))
        return d.select(name, F.explode("all").alias("variant"))

    a, b = side(words, "a"), side(lexicon, "b")
    short = lambda d, name: left(d.where(F.length(name) < LONG + most), name)
    pairs = short(a, "a").join(short(b, "b"), "variant").select("a", "b")
    pairs = pairs.unionByName(_by_pieces(a.where(F.length("a") >= LONG), b.where(F.length("b") >= LONG), most)).where("a <> b").distinct()
    # A swap is two of Levenshtein's edits and keeps the length, so this only drops what can't be in.
    near = pairs.where((F.levenshtein("a", "b", 2 * most) >= 0) & (F.abs(F.length("a") - F.length("b")) <= most))
    distance = F.when(F.expr(_one("a", "b")), 1).when(F.expr(_TWO), 2)
    return near.withColumn("distance", distance.cast("int")).where(F.col("distance") <= most)


def checkpointed(d: DataFrame) -> DataFrame:
    """d, cut off by a checkpoint in the folder that spark.checkpoint.dir names; a temporary one only where none is named (tests)."""
    sc = d.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = d.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="verbatile-"))
    return d.checkpoint()


def repaired(cues: DataFrame, key: str, shortest: float = 0.5, passes: int = 4) -> DataFrame:
    """Echo merging, lengthening and overlap removal until nothing is short or overlaps, nothing gets better, or passes are used up.

    Each pass is cut off by a checkpoint in the shared folder; its issues are counted on it."""
    w = Window.partitionBy(key).orderBy("start", "end", "speaker", "text")
    short, over = F.col("end") - F.col("start") < shortest - 1e-9, F.coalesce(F.lag("end").over(w) > F.col("start"), F.lit(False))
    issues = lambda d: d.select((short | over).alias("bad")).agg(F.count_if("bad")).first()[0]
    best, left = cues, None
    for _ in range(passes):
        made = checkpointed(folds.without_overlap(folds.lengthened(folds.without_echoes(best, key), key, shortest), key))
        now = issues(made)
        if left is not None and now >= left:
            break
        best, left = made, now
        if not now:
            break
    return best

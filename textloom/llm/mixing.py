"""Mixing sources to target weights by fitting word budgets exactly.

Targets come from water-filling: each source gets words by its weight until it is taken
as often as allowed, and the excess goes to the others. A source then takes all its
documents as many whole times as its target holds, and the rest of its budget is a
bounded-knapsack problem over its histogram of document lengths: most of the budget is
spent in proportion to the histogram, the remainder by dynamic programming over lengths.
Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common

SEED = 42
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
REPEATS = 2
#: Single documents cut the remainder down to this many words where any of them fits.
REACH = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none. A word begins where white space ends."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))


def row_of(text_col: str) -> Column:
    """A hash of text and source; the number between them keeps a null's place."""
    return F.xxhash64(F.col(text_col), F.lit(0), F.col("source"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> with target: the level at which all capped shares meet the budget.

    Sorted by the level at which a source is full, the sources filled before it and the weight
    of the rest are running sums, so no iteration is needed. One row a source, nulls last.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    with_w = sizes.withColumn("__w", w).withColumn("__cap", F.lit(float(repeats)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    goal = F.lit(budget) * F.sum("source_size").over(everything)
    level = (goal - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    marked = with_w.withColumn("__level", level).withColumn("__open", F.col("__level") <= F.col("__cap") / F.col("__w"))
    settled = F.max(F.when(F.col("__open"), F.col("__level"))).over(everything)  # later ones only fall
    return marked.withColumn("target", F.least(F.col("__cap"), F.coalesce(settled * F.col("__w"), F.col("__cap")))).select("source", "source_size", "target")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget`` from below.

    First the same share of every length, rounded down; single documents from the longest down
    cut what is left to ``REACH`` words or to fewer than any of them has beyond half of that;
    then a bounded-knapsack programme over bit sets, with counts split in powers of two, fits
    the remainder exactly from all lengths that are left, or as nearly from below as they can.
    Nothing here grows with the number of documents.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.asarray([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= REACH:
            break
        n = min(int(counts[i] - take[i]), (rest - REACH // 2) // int(lengths[i]) if lengths[i] else 0)
        if n > 0:
            take[i] += n
            rest -= n * int(lengths[i])
    # short lengths first: they make the finest steps; a step that reaches nothing new is not kept
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in np.argsort(lengths, kind="stable"):
        n, k = min(int(counts[i] - take[i]), rest // int(lengths[i])) if lengths[i] else 0, 1
        while n > 0 and not reach >> rest & 1:
            own = min(k, n)
            n -= own
            k *= 2
            wider = reach | (reach << own * int(lengths[i])) & mask
            if wider != reach:
                steps.append((i, own, reach))
                reach = wider
    at = (reach & mask).bit_length() - 1
    for i, own, before in reversed(steps):
        if not before >> at & 1:
            take[i] += own
            at -= own * int(lengths[i])
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), row for every row of ``docs``.

    Reruns agree: the choice hangs on the seed and the row's values alone. Null texts have
    size 0 and are taken with 0 words; a null source is a source of its own, weighed last.
    Long texts are counted whole. Repeated rows are separate candidates; ``row`` tells texts and sources of one doc_id apart. Extra columns are left out. Empty table: no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col(text_col)).alias("size"), row_of(text_col).alias("row")).withColumn("pick", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size")))
    rows = common.materialise(rows, "sizes")
    histogram = common.materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    goals = common.materialise(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget, repeats), "targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # one source: a row for each length that occurs, whatever the number of documents
        pdf = pdf.sort_values("size", ignore_index=True)
        total, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(repeats, int(goal // total)) if total else 0
        more = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(round(goal)) - whole * total) if whole < repeats else np.zeros(len(pdf), np.int64)
        return pdf[["source", "size", "source_size", "target"]].assign(whole=whole, more=more)

    kind = docs.schema["source"].dataType.simpleString()
    joined = histogram.join(goals, histogram["source"].eqNullSafe(goals["source"])).select(histogram["source"], "size", "n", "source_size", "target")
    chosen = joined.groupBy("source").applyInPandas(fit, f"source {kind}, size long, source_size long, target double, whole long, more long")
    chosen = common.materialise(chosen, "chosen").select(F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target", "whole", "more")
    # the seeded order: slices are the hash's top bits, so rank order is hash order
    salt = F.shiftrightunsigned(F.col("pick"), 56)
    ranked = common.ranks_within(rows, ["source", "size"], ["pick", "doc_id", "row"], salt)
    out = ranked.join(chosen, ranked["source"].eqNullSafe(chosen["__source"]) & (ranked["size"] == chosen["__size"]))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "row")


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as the mix takes them, in their own columns.

    A document of size 0 carries no words and stays once, so that nothing without cost is lost.
    Different texts that share a doc_id, or have none, are taken each as the mix says. Rows that
    repeat doc_id, source and text are each taken as often as the one taken most.
    """
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    plan = mix(docs, text_col=text_col, **options).select(F.col("doc_id").alias("__id"), F.col("row").alias("__plan"), times.alias("__times"))
    plan = plan.groupBy("__id", "__plan").agg(F.max("__times").alias("__times")).where("__times > 0")
    marked = docs.withColumn("__row", row_of(text_col))
    rows = marked.join(plan, marked["doc_id"].eqNullSafe(plan["__id"]) & (marked["__row"] == plan["__plan"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[marked[c] for c in docs.columns])

"""Vectors, overlaps and numbers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; null where one is zero."""
    return bind(F.struct(dot(a, b).alias("ab"), (norm(a) * norm(b)).alias("n")), lambda v: F.when(v["n"] > 0, v["ab"] / v["n"]))


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two maps label -> weight over their shared labels."""
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)


def sparse_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def sparse_cosine(a: Column, b: Column, clipped: bool = False) -> Column:
    """Cosine of two maps. ``clipped``: shared weights of ``b`` are lowered to those of ``a`` first."""
    other = F.map_zip_with(a, b, lambda _, x, y: F.when(y.isNotNull(), F.least(F.coalesce(x, y), y))) if clipped else b
    other = F.map_filter(other, lambda _, y: y.isNotNull()) if clipped else other
    return bind(F.struct(sparse_dot(a, other).alias("ab"), (sparse_norm(a) * sparse_norm(other)).alias("n")), lambda v: F.when(v["n"] > 0, v["ab"] / v["n"]))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def normalized_overlap(a: Column, b: Column) -> Column:
    """Shared labels over the mean number of labels."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes > 0, overlap(a, b) / (sizes / 2))


def min_length_overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, overlap(a, b) / least)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def best_similarity(a: Column, b: Column) -> Column:
    """The best of normalised overlap, cosine, and cosine after terms are split into words; maps label -> weight."""
    words = lambda m: F.aggregate(F.map_entries(m), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")), lambda s, e: F.aggregate(F.split(e["key"], " "), s, lambda t, w: F.map_concat(F.map_filter(t, lambda k, _: k != w), F.create_map(w, F.coalesce(F.try_element_at(t, w), F.lit(0.0)) + e["value"].cast("double")))))
    return F.greatest(normalized_overlap(F.map_keys(a), F.map_keys(b)), sparse_cosine(a, b), sparse_cosine(words(a), words(b)))


def comparable(a: Column, b: Column) -> Column:
    """May vectors of two kinds be compared? TERM and TEXT with each other, CODE with CODE."""
    return ((a == "CODE") & (b == "CODE")) | (a.isin("TERM", "TEXT") & b.isin("TERM", "TEXT"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_base(x: Column, base: float) -> Column:
    return F.when(x > 0, F.ln(x) / F.ln(F.lit(float(base))))


def t_value(mean1: Column, var1: Column, n1: Column, mean2: Column, var2: Column, n2: Column) -> Column:
    """Welch's t of two samples."""
    spread = F.sqrt(var1 / n1 + var2 / n2)
    return F.when(spread > 0, (mean1 - mean2) / spread)


def span_similarity(a: Column, b: Column) -> Column:
    """1 - 2 * edit distance / summed lengths, 0 at least."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, F.greatest(F.lit(0.0), 1 - 2 * F.levenshtein(a, b) / total)).otherwise(1.0)

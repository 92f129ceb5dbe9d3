"""Quality rules: base counts of a text and its divergence from its language.

A document's histograms of character classes and of its language's common words are held
against the language's own, with the Jensen-Shannon distance. The references are counted
over all documents; texts too short for a histogram are judged by the base rules alone.

DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common

#: Words of a reference histogram, and the longest word that counts as a common one.
COMMON_WORDS = 12
COMMON_LENGTH = 6
#: A histogram of fewer words says little.
GUARD_WORDS = 50
#: A document is far from its language by one distance, or by both together.
CLASS_LIMIT = 0.35
WORD_LIMIT = 0.42
BOTH_LIMIT = 0.55
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of eight found twice or more in the list.

    Window hashes are built by doubling (1, 2, 4, 8 words). Only lists with an equal pair are
    sorted, to find the equal windows' places and the length of their union.
    """
    if window != 8:
        raise ValueError("windows are of eight words")

    def doubled(h: Column, step: int) -> Column:
        n = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def places(ordered: Column) -> Column:
        same = lambda s, j: (F.get(ordered, j - 1)["h"] == s["h"]) | (F.get(ordered, j + 1)["h"] == s["h"])
        found = F.filter(ordered, lambda s, j: F.coalesce(same(s, j), F.get(ordered, j - 1)["h"] == s["h"], F.get(ordered, j + 1)["h"] == s["h"], F.lit(False)))
        return F.sort_array(F.transform(found, lambda s: s["i"]))

    def from_windows(h8: Column) -> Column:
        ordered = F.sort_array(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spread = bind(bind(ordered, places), covered)
        return F.when(F.size(F.array_distinct(h8)) < F.size(h8), spread).otherwise(F.lit(0).cast("long"))

    chain = bind(bind(bind(bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)), lambda h: doubled(h, 2)), lambda h: doubled(h, 4)), from_windows)
    return F.when(F.size(words) > window, chain).otherwise(F.lit(0).cast("long"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[{common.SPACE}]+", -1), "")


def base_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, words, and the base counts; a null text has none of anything."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.select("doc_id", F.col(lang_col).alias("lang"), text.alias("text"), *keep)
    second = first.withColumn("words", words_of(F.col("text"))).withColumn("rest", F.regexp_replace("text", rf"[a-z{common.SPACE}]+", ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(rf"[^{common.SPACE}]"))
    gone = lambda pattern: F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))
    third = second.select(
        "doc_id",
        "lang",
        "words",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        gone("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length("rest").alias("n_rest"),
        gone("[A-Z]+").alias("n_upper"),
        gone("[0-9]+").alias("n_digit"),
        gone("[.,;:!?'\"()-]+").alias("n_mark"),
        gone(r"[^\x00-\x7F]+").alias("n_beyond"),
    )
    return third.withColumn("n_repeat_words", repeat_words(F.col("words")))


def reference_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang -> common: the words that occur most in a language, over all documents; null for the pooled row.

    Words over ``COMMON_LENGTH`` code points are content words and never common ones.
    """
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), rf"[{common.SPACE}]+", -1), lambda w: F.length(w).between(1, COMMON_LENGTH))
    counted = docs.select(F.col(lang_col).alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = common.materialise(counted, "word-counts").where(~F.col("word").rlike(r"[0-9#*$%&|<>.,;:!?'\"()-]"))
    known = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    own = counted.where(F.col("lang").isNotNull()).withColumn("k", known).where(F.col("k") <= COMMON_WORDS)
    pooled = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    sorted_words = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), lambda s: s["word"])
    per_lang = own.groupBy("lang").agg(sorted_words.alias("common"))
    return per_lang.unionByName(pooled.agg(sorted_words.alias("common")).select(F.lit(None).cast("string").alias("lang"), "common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; null where one is empty."""

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return bind(F.struct(counts.alias("c"), total.alias("t")), lambda v: F.when(v["t"] > 0, F.transform(v["c"], lambda x: x / v["t"])))

    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(shares(p), shares(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def padded(histogram: str, n: int) -> Column:
    """A histogram of n bins: where a language has fewer common words, empty bins stand before the last one."""
    gap = F.array_repeat(F.lit(0.0), F.lit(n) - F.size(histogram))
    return F.concat(F.slice(histogram, F.lit(1), F.size(histogram) - 1), gap, F.slice(histogram, F.size(histogram), F.lit(1)))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base counts, class_distance, word_distance, base_failed, kept, and ``keep`` columns for every row.

    A null or empty text has counts of 0 and fails the base rule. A null language is
    held against the pooled reference. Repeated rows are judged each; other columns are
    left out; an empty table gives no rows. Texts are read twice: for the languages' common words,
    and for everything else.
    """
    reference = common.materialise(reference_words(docs, text_col, lang_col), "reference-words")  # a short row a language
    shared = reference.where(F.col("lang").isNull()).select(F.explode("common")).collect()  # at most COMMON_WORDS words
    pooled = F.array(*[F.lit(r[0]) for r in shared]).cast("array<string>")
    counts = base_counts(docs, text_col, lang_col, keep)
    known = reference.where(F.col("lang").isNotNull()).withColumnsRenamed({"lang": "ref_lang", "common": "own"})
    paired = counts.join(known, F.col("lang") == F.col("ref_lang"), "left")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    # words of at most COMMON_LENGTH code points, then one native pass a common word
    short = F.filter("words", lambda w: F.length(w) <= COMMON_LENGTH)
    lower_short = F.transform(short, lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    occurrences = bind(F.struct(lower_short.alias("w"), F.coalesce(F.col("own"), pooled).alias("ref")), lambda v: F.transform(v["ref"], lambda r: (F.size(v["w"]) - F.size(F.array_remove(v["w"], r))).cast("double")))
    classes = F.array(*[F.greatest(c, F.lit(0)).cast("double") for c in (F.col("n_lower"), F.col("n_upper"), F.col("n_digit"), F.col("n_mark"), F.col("n_symbols"), F.col("n_beyond"), F.col("n_rest") - F.col("n_upper") - F.col("n_digit") - F.col("n_mark") - F.col("n_symbols") - F.col("n_beyond"))])
    features = paired.withColumn("n_lower", F.col("word_chars") - F.col("n_rest")).select("doc_id", F.col("ref_lang"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", classes.alias("classes"), occurrences.alias("hits"), *keep)
    features = common.materialise(features, "features")
    # the references: each bin's median share over all documents of the language that are long enough;
    # a median stays where it is when a minority of documents is junk
    other = F.col("n_words") - total("hits")
    features = features.withColumn("words_histogram", F.concat("hits", F.array(other))).drop("hits")
    long_enough = F.col("n_words") >= GUARD_WORDS
    share = lambda c, k: F.when(long_enough & (total(c) > 0), F.get(c, F.lit(k)) / total(c))
    medians = lambda c, n: F.array(*[F.coalesce(F.percentile_approx(share(c, k), F.lit(0.5), F.lit(10_000)), F.lit(0.0)) for k in range(n)])
    bins = features.withColumn("words_histogram", padded("words_histogram", COMMON_WORDS + 1))
    centres = bins.groupBy("ref_lang").agg(medians("classes", 7).alias("ref_classes"), medians("words_histogram", COMMON_WORDS + 1).alias("ref_words"))
    centres = common.materialise(centres.withColumnRenamed("ref_lang", "centre_lang"), "references")  # a row a reference
    held = bins.join(centres, F.col("ref_lang").eqNullSafe(F.col("centre_lang")), "left")
    judged = held.withColumn("class_distance", distance(F.col("classes"), F.col("ref_classes"))).withColumn("word_distance", distance(F.col("words_histogram"), F.col("ref_words")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    near = near & (F.coalesce(F.col("class_distance") + F.col("word_distance"), F.lit(0.0)) <= BOTH_LIMIT)
    judged = judged.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < GUARD_WORDS) | near))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", F.col("ref_lang").alias("reference"), *keep)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text the rules reject.

    Different texts that share a doc_id, or have none, are kept or rejected each by itself.
    """
    # the number between text and language keeps a null's place
    marked = docs.withColumn("__row", F.xxhash64(F.col(text_col), F.lit(0), F.col(lang_col)))
    good = judge(marked, text_col, lang_col, keep=("__row",)).where("kept").select(F.col("doc_id").alias("__id"), F.col("__row").alias("__good")).distinct()
    return marked.join(good, marked["doc_id"].eqNullSafe(good["__id"]) & (marked["__row"] == good["__good"]), "left_semi").drop("__row")

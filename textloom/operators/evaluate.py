"""Precision, recall, and statistics of dictionaries and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.measures import span_similarity, t_value


def rates(counts: DataFrame) -> DataFrame:
    """tp, fp, fn -> with precision, recall, f; 0 where a denominator is 0."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matched_pairs(predicted: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("text_id", "gene_id")) -> DataFrame:
    """keys, in_predicted, in_gold over the union of both sets of keys."""
    a = predicted.select(*keys).distinct().withColumn("in_predicted", F.lit(True))
    b = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True))
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("in_predicted", F.lit(False)).alias("in_predicted"), F.coalesce("in_gold", F.lit(False)).alias("in_gold"))


def precision_recall(predicted: DataFrame, gold: DataFrame, by: str | None = None, keys: tuple[str, ...] = ("text_id", "gene_id")) -> DataFrame:
    """Counts and rates over (text, gene) pairs, for all or for each ``by``."""
    rows = matched_pairs(predicted, gold, keys)
    n = lambda a, b: F.coalesce(F.sum((F.col("in_predicted") == a).cast("long") * (F.col("in_gold") == b).cast("long")), F.lit(0)).alias("tp" if a and b else "fp" if a else "fn")
    return rates(rows.groupBy(*([by] if by else [])).agg(n(True, True), n(True, False), n(False, True)))


def true_positives(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    return predicted.select("text_id", "gene_id").distinct().join(gold.select("text_id", "gene_id").distinct(), ["text_id", "gene_id"])


def scored_pairs(predicted: DataFrame, gold: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Like ``precision_recall``, but a pair is right only if its excerpt is like one of the gold excerpts.

    A pair of both sets whose best similarity is not above the threshold counts as false positive
    and as false negative. ``predicted``: text_id, gene_id, excerpt; ``gold``: text_id, gene_id, excerpts.
    """
    a = predicted.groupBy("text_id", "gene_id").agg(F.min("excerpt").alias("excerpt"))
    b = gold.groupBy("text_id", "gene_id").agg(F.flatten(F.collect_list("excerpts")).alias("excerpts"))
    rows = a.withColumn("p", F.lit(True)).join(b.withColumn("g", F.lit(True)), ["text_id", "gene_id"], "full_outer")
    best = F.array_max(F.transform("excerpts", lambda e: span_similarity(F.col("excerpt"), e)))
    right = F.col("p").isNotNull() & F.col("g").isNotNull() & (best > threshold)
    rows = rows.withColumn("right", F.coalesce(right, F.lit(False)))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rates(rows.agg(n(F.col("right")).alias("tp"), n(F.col("p").isNotNull() & ~F.col("right")).alias("fp"), n(F.col("g").isNotNull() & ~F.col("right")).alias("fn")))


def span_precision_recall(predicted: DataFrame, gold: DataFrame, alternates: DataFrame | None = None) -> DataFrame:
    """Exact spans (sent_id, start, end). A span that only the alternates have counts as right; recall is over gold alone.

    A gold span missed itself is not missed if an alternate that overlaps it was predicted.
    """
    keys = ["sent_id", "start", "end"]
    p, g = predicted.select(*keys).distinct(), gold.select(*keys).distinct()
    exact = p.join(g, keys)
    n_p, n_g, n_exact = (x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((p, "n_p"), (g, "n_g"), (exact, "n_exact")))
    if alternates is None:
        covered = exact.select(*keys)
        n_cov = covered.agg(F.count(F.lit(1)).alias("n_cov"))
        n_alt = n_cov.select(F.lit(0).cast("long").alias("n_alt"))
    else:
        other = p.join(g, keys, "left_anti").join(alternates.select(*keys).distinct(), keys, "left_semi")
        n_alt = other.agg(F.count(F.lit(1)).alias("n_alt"))
        o = exact.unionByName(other).select(F.col("sent_id").alias("s"), F.col("start").alias("a"), F.col("end").alias("b"))
        n_cov = g.join(o, (F.col("sent_id") == F.col("s")) & (F.col("start") <= F.col("b")) & (F.col("a") <= F.col("end")), "left_semi").agg(F.count(F.lit(1)).alias("n_cov"))
    one = n_p.withColumn("k", F.lit(1))
    for x in (n_g, n_exact, n_alt, n_cov):
        one = one.join(x.withColumn("k", F.lit(1)), "k")  # one row each
    tp = F.col("n_exact") + F.col("n_alt")
    return rates(one.select(tp.alias("tp"), (F.col("n_p") - tp).alias("fp"), (F.col("n_g") - F.col("n_cov")).alias("fn")))


def folds(rows: DataFrame, key: str, k: int = 2, seed: int = 42, rate: float = 1.0) -> DataFrame:
    """Adds fold (0 to k - 1) by a seeded hash of the key; keeps a ``rate`` share of the keys."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    out = rows.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    return out if rate >= 1 else out.where(F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(1_000_000)) < int(rate * 1_000_000))


def dictionary_statistics(names: DataFrame) -> DataFrame:
    """One row over (gene_id, name): genes, names, names a gene (mean, variance, max), tokens a name, genes a name, ambiguous and single-name genes."""
    rows = names.select("gene_id", "name").distinct()
    per_gene = rows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    per_name = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("tokens", F.size(F.split("name", r"\s+")))
    shared = per_name.where("n > 1").select(F.col("name").alias("s_name"))
    ambiguous = rows.join(shared, F.col("name") == F.col("s_name"), "left_semi").agg(F.countDistinct("gene_id").alias("ambiguous_genes"))
    genes = per_gene.agg(F.count(F.lit(1)).alias("n_genes"), F.avg("n").alias("names_mean"), F.var_pop("n").alias("names_variance"), F.max("n").alias("names_max"), F.sum((F.col("n") == 1).cast("long")).alias("single_name_genes"))
    per = per_name.agg(F.count(F.lit(1)).alias("n_names"), F.avg("tokens").alias("tokens_mean"), F.var_pop("tokens").alias("tokens_variance"), F.avg("n").alias("genes_mean"))
    k = F.lit(1).alias("k")
    return genes.select("*", k).join(per.select("*", k), "k").join(ambiguous.select("*", k), "k").drop("k")


def separation(rows: DataFrame) -> DataFrame:
    """(gene_id, own boolean, distance) -> mean own and other distance and Welch's t, for each gene."""
    stat = lambda f, own: f(F.when(F.col("own") == own, F.col("distance")))
    agg = rows.groupBy("gene_id").agg(
        stat(F.avg, True).alias("own_mean"), stat(F.avg, False).alias("other_mean"), stat(F.var_pop, True).alias("own_var"),
        stat(F.var_pop, False).alias("other_var"), stat(F.count, True).alias("own_n"), stat(F.count, False).alias("other_n"),
    )
    return agg.withColumn("t", t_value(F.col("own_mean"), F.col("own_var"), F.col("own_n"), F.col("other_mean"), F.col("other_var"), F.col("other_n")))


def names_by_average(rows: DataFrame) -> DataFrame:
    """(name, score) -> the names of each average score, ascending."""
    avg = rows.groupBy("name").agg(F.round(F.avg("score"), 6).alias("score"))
    return avg.groupBy("score").agg(F.sort_array(F.collect_list("name")).alias("names")).orderBy("score")


def threshold_curve(rows: DataFrame, steps: int = 20) -> DataFrame:
    """(score 0 to 1, right boolean) -> for each bin: counts, and how many rows of either kind score at or above it."""
    bins = F.least(F.floor(F.col("score") * steps), F.lit(steps - 1)).cast("int")
    hist = rows.groupBy(bins.alias("bin")).agg(F.sum(F.col("right").cast("long")).alias("n_right"), F.sum((~F.col("right")).cast("long")).alias("n_wrong"))
    onward = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `steps` rows
    return hist.withColumn("right_above", F.sum("n_right").over(onward)).withColumn("wrong_above", F.sum("n_wrong").over(onward))


def ids_per_name(names: DataFrame, by: str = "gene_id") -> DataFrame:
    """The mean number of ids (or species) that share a name."""
    return names.groupBy("name").agg(F.countDistinct(by).alias("n")).agg(F.avg("n").alias("average"))


def boundary_statistics(tagged: DataFrame) -> DataFrame:
    """(token, tag B/I/O) -> how often a token stands in, begins or is outside mentions."""
    n = lambda t: F.sum((F.col("tag") == t).cast("long")).alias(f"n_{t.lower()}")
    return tagged.groupBy("token").agg(n("B"), n("I"), n("O"), F.count(F.lit(1)).alias("n"))

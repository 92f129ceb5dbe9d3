"""Scores of candidates against texts, and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.measures import normalized_overlap, sparse_cosine
from textloom.operators.filters import contains_pattern

#: The features in their order.
FEATURES = ("aa", "ms", "do", "ds", "fu", "go", "gr", "kw", "lc", "mt", "pm", "su", "ts", "it")
MISSING = -1.0
FUNCTION_CUT, SUMMARY_CUT = 0.03, 0.08


def has(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def any_of(values: Column, test) -> Column:
    """1 if a value passes, -1 if none does or there is none."""
    return F.when(has(values) & F.exists(values, test), 1.0).otherwise(MISSING)


def length_score(lengths: Column, text: Column) -> Column:
    return any_of(lengths, lambda n: contains_pattern(text, r"(?:^|\D)", n, r"\s?(?:aa|amino[\s\-]?acid)s?"))


def mass_score(masses: Column, text: Column) -> Column:
    """A mass in Da, in whole kDa, or in kDa with one decimal."""

    def found(m: Column) -> Column:
        kda = F.round(m.cast("double") / 1000).cast("int").cast("string")
        tenth = F.regexp_replace(F.round(m.cast("double") / 100).cast("int").cast("string"), r"^(\d+)(\d)$", r"$1.$2")
        unit = lambda v, u: contains_pattern(text, r"(?:^|\D)", F.replace(v, F.lit("."), F.lit(r"\.")), r"[\s\-]?" + u)
        return unit(m, "[Dd](?:a(?:lton)?)?") | unit(kda, "[Kk][Dd][Aa]") | unit(tenth, "[Kk][Dd][Aa]")

    return any_of(F.filter(masses, lambda m: m.rlike(r"^\d+$")), found)


def word_score(words: Column, text: Column) -> Column:
    """A domain or mutation that stands as a word in the text."""
    return any_of(words, lambda w: F.contains(text, w) & contains_pattern(text, r"(?:^|\s)", F.regexp_replace(w, r"([^A-Za-z0-9\s])", r"\\$1"), r"(?:[\s,.;)]|$)"))


def keyword_score(keywords: Column, text: Column) -> Column:
    """The share of keywords that the text holds."""
    return F.when(has(keywords), F.size(F.filter(keywords, lambda k: F.contains(text, k))) / F.size(keywords)).otherwise(MISSING)


def location_score(locations: Column, text: Column) -> Column:
    """Chromosome locations, from the full band (1) down to the chromosome alone (0.5)."""
    near = lambda v: contains_pattern(text, r"(?:^|\D)", v, r"(?:\D|$)")

    def one(loc: Column) -> Column:
        band = r"^([0-9XYZ]+)([pq])([0-9]+)((?:\.[0-9]+)?)$"
        part = lambda k: F.regexp_extract(loc, band, k)
        safe = lambda v: F.replace(v, F.lit("."), F.lit(r"\."))
        chrom, fine, coarse = part(1), F.concat(part(2), part(3), part(4)), F.concat(part(2), part(3))
        alone = F.regexp_extract(loc, r"^(?:chromosome\s)?([0-9XYZ]+)$", 1)
        beside = lambda c: contains_pattern(text, r"chromosome\s", c, r"(?:\D|$)") | contains_pattern(text, r"(?:^|\D)", c, r"\schromosome")
        banded = (
            F.when(near(safe(loc)), 1.0)
            .when(near(chrom) & near(safe(fine)), 0.95)
            .when(near(chrom) & near(coarse), 0.9)
            .when(near(safe(fine)), 0.85)
            .when(near(coarse), 0.8)
            .when(beside(chrom), 0.5)
            .otherwise(0.0)
        )
        return F.when(loc.rlike(band), banded).when((alone != "") & beside(alone), 0.5).otherwise(0.0)

    return F.when(has(locations), F.array_max(F.transform(locations, one))).otherwise(MISSING)


def overlap_score(vectors: Column, labels: Column, cut: float = 0.0) -> Column:
    """The best normalised overlap of any of a gene's vectors (array of label arrays) with the text's labels."""
    best = F.array_max(F.transform(vectors, lambda v: F.coalesce(normalized_overlap(v, labels), F.lit(0.0))))
    return F.when(has(vectors), F.when(best < cut, 0.0).otherwise(best)).otherwise(MISSING)


def interactor_score(first: Column, second: Column, text: Column) -> Column:
    share = lambda v: F.when(has(v), F.size(F.filter(v, lambda k: F.contains(text, k))) / F.size(v)).otherwise(MISSING)
    return F.greatest(share(first), share(second))


def score_features(pairs: DataFrame, genes: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, gene_id) -> the 14 features, each once a distinct pair.

    ``genes``: gene_id and the attributes lengths, masses, domains, mutations, keywords, locations,
    pmids, interactors, interactions (arrays of strings), diseases, functions, rifs, tissues (arrays of
    label arrays), summary (map), go_similarity may come with ``pairs``. ``texts``: text_id, plain, pmid,
    labels (array), weights (map). Named columns: nothing shifts when one is left out.
    """
    rows = pairs.dropDuplicates(["text_id", "gene_id"]).join(genes, "gene_id").join(texts, "text_id")
    text = F.col("plain")
    listed = F.coalesce(F.array_contains("pmids", F.col("pmid").cast("string")), F.lit(False))
    summary = F.coalesce(sparse_cosine(F.col("summary"), F.col("weights")), F.lit(0.0))
    go = F.coalesce("go_similarity", F.lit(MISSING)) if "go_similarity" in rows.columns else F.lit(MISSING)
    columns = {
        "aa": length_score(F.col("lengths"), text), "ms": mass_score(F.col("masses"), text), "do": word_score(F.col("domains"), text),
        "ds": overlap_score(F.col("diseases"), F.col("labels")), "fu": overlap_score(F.col("functions"), F.col("labels"), FUNCTION_CUT),
        "go": go, "gr": overlap_score(F.col("rifs"), F.col("labels")), "kw": keyword_score(F.col("keywords"), text),
        "lc": location_score(F.col("locations"), text), "mt": word_score(F.col("mutations"), text),
        "pm": F.when(has(F.col("pmids")), F.when(listed, 1.0).otherwise(0.0)).otherwise(MISSING),
        "su": F.when(F.col("summary").isNotNull() & (F.size(F.map_keys("summary")) > 0), F.when(summary < SUMMARY_CUT, 0.0).otherwise(summary)).otherwise(MISSING),
        "ts": overlap_score(F.col("tissues"), F.col("labels")), "it": interactor_score(F.col("interactors"), F.col("interactions"), text),
    }
    return rows.select("text_id", "gene_id", *[c.cast("double").alias(n) for n, c in columns.items()])


def rank_candidates(rows: DataFrame, features: tuple[str, ...], threshold: float = 0.0, by_taxon: bool = True, key: tuple[str, ...] = ("mention_id",)) -> DataFrame:
    """Adds score: each feature over its best among the candidates, positive ones summed; keeps all ties at the top from ``threshold`` up.

    Candidates compete within a mention, and within a species where ``by_taxon``.
    """
    own = [*key, "taxon"] if by_taxon else [*key]
    w = Window.partitionBy(*own)
    parts = []
    for f in features:
        best = F.max(f).over(w)
        parts.append(F.when((F.col(f) > 0) & (best > 0), F.col(f) / best).otherwise(0.0))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    scored = rows.withColumn("score", F.round(total, 9))
    ranked = scored.withColumn("__rank", F.rank().over(Window.partitionBy(*own).orderBy(F.desc("score"))))
    return ranked.where((F.col("__rank") == 1) & (F.col("score") >= threshold)).drop("__rank")


def top3_average(scores: Column) -> Column:
    """Mean of the positive ones of the three best scores; its sign turns if only one is and the fourth or sixth is 0 or more."""
    order = F.reverse(F.array_sort(scores))
    top = F.filter(F.slice(order, 1, 3), lambda x: x > 0)
    mean = F.aggregate(top, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(top)
    other = (F.coalesce(F.get(order, F.lit(3)), F.lit(-1.0)) >= 0) | (F.coalesce(F.get(order, F.lit(5)), F.lit(-1.0)) >= 0)
    return F.when(F.size(top) == 0, F.lit(None)).when((F.size(top) == 1) & other, -mean).otherwise(mean)


def first_confidence(identified: DataFrame, seq: str = "seq") -> DataFrame:
    """The score of a (text, gene) where it was identified first."""
    return identified.groupBy("text_id", "gene_id").agg(F.min_by("score", seq).alias("score"))


def average_by_name(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.avg("score").alias("score"))


def model_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Weighted mean of cosine over comparable pairs of vectors of two owners.

    ``a``, ``b``: owner pair key (pair_id), ctx_type, vector (map), weight. Pairs meet by their
    key; a vector's number within an owner is bounded by the number of its types.
    """
    from textloom.functions.measures import comparable

    other = b.select(F.col("pair_id").alias("b_pair"), F.col("ctx_type").alias("b_type"), F.col("vector").alias("b_vector"), F.col("weight").alias("b_weight"))
    pairs = a.join(other, F.col("pair_id") == F.col("b_pair")).where(comparable(F.col("ctx_type"), F.col("b_type")))
    w = F.col("weight") * F.col("b_weight")
    return pairs.groupBy("pair_id").agg((F.sum(w * F.coalesce(sparse_cosine(F.col("vector"), F.col("b_vector")), F.lit(0.0))) / F.sum(w)).alias("similarity"))


def relative_frequencies(tokens: DataFrame) -> DataFrame:
    """(doc_id, token) rows -> weight: a token's share of the document over its share of the corpus."""
    tf = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    corpus = tf.groupBy("token").agg(F.sum("n").alias("corpus_n"))
    sizes = tf.groupBy("doc_id").agg(F.sum("n").alias("doc_n"))
    total = corpus.agg(F.sum("corpus_n").alias("total"))
    rows = tf.join(corpus, "token").join(sizes, "doc_id").join(F.broadcast(total), F.lit(True))  # one row
    return rows.select("doc_id", "token", "n", ((F.col("n") / F.col("doc_n")) / (F.col("corpus_n") / F.col("total"))).alias("weight"))

"""Pipelines: texts in, identified genes out, as one lazy plan, or in FULL by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.ranges import expand_ranges
from textloom.operators import filters, match, species


@dataclass(frozen=True)
class Config:
    default_species: tuple[int, ...] = (9606,)
    assumed_species: tuple[int, ...] = ()
    limited_species: tuple[int, ...] = ()
    excluded_species: tuple[int, ...] = ()
    alignment_threshold: float = 0.7
    score_threshold: float = 0.0
    additional_filters: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    """What a step takes and gives: DataFrames, so nothing runs until a result is asked for or a step stores its own.

    ``read``: the texts that hold mentions, once mentions are stored without their text.
    """

    texts: DataFrame
    dictionary: DataFrame
    genes: DataFrame
    mentions: DataFrame | None = None
    identified: DataFrame | None = None
    read: DataFrame | None = None
    config: Config = field(default_factory=Config)

    def with_(self, **changes) -> State:
        return replace(self, **changes)


Step = Callable[[State], State]


def run(state: State, steps: list[Step]) -> State:
    return reduce(lambda s, step: step(s), steps, state)


def expand_names(s: State) -> State:
    @F.pandas_udf(StringType())
    def expand(texts: pd.Series) -> pd.Series:
        return texts.map(expand_ranges)

    return s.with_(texts=s.texts.withColumn("plain", expand("plain")))


def find_species(s: State) -> State:
    return s.with_(texts=species.recognize(s.texts, default=s.config.default_species, assumed=s.config.assumed_species))


def clean_species(s: State) -> State:
    """Normalises taxa and drops those with ambiguous names only."""
    cleaned = s.texts.withColumn("r_names", species.clean(F.col("taxon_names")))
    taxa = F.when(F.col("r_names").isNull(), F.col("taxa")).otherwise(F.array_sort(F.map_keys("r_names")))
    return s.with_(texts=cleaned.withColumn("taxa", taxa).withColumn("taxon_names", F.coalesce("r_names", "taxon_names")).drop("r_names"))


def find_names(s: State) -> State:
    c = s.config
    taxa = s.texts.select("text_id", F.explode("taxa").alias("taxon"))
    taxa = taxa.where(F.col("taxon").isin(list(c.limited_species))) if c.limited_species else taxa
    taxa = taxa.where(~F.col("taxon").isin(list(c.excluded_species))) if c.excluded_species else taxa
    found = match.match_names(s.texts.select("text_id", "plain"), s.dictionary, taxa=taxa)
    return s.with_(mentions=found)


def unify(s: State) -> State:
    return s.with_(mentions=filters.unify(s.mentions, s.texts))


def add_context(s: State) -> State:
    return s.with_(mentions=filters.with_context(s.mentions, s.texts))


def mention_step(rule: Callable[..., DataFrame], **fixed) -> Step:
    """A step from a filter on mentions alone."""
    return lambda s: s.with_(mentions=rule(s.mentions, **fixed))


def gene_step(rule: Callable[..., DataFrame], **fixed) -> Step:
    """A step from a filter that needs genes."""
    return lambda s: s.with_(mentions=rule(s.mentions, s.genes, **fixed))


def align(s: State) -> State:
    return s.with_(mentions=filters.align_candidates(s.mentions, s.genes, s.config.alignment_threshold))


def text_step(rule: Callable[..., DataFrame], genes: bool = False) -> Step:
    """A step from a filter that reads the mentions' texts beside them."""
    return lambda s: s.with_(mentions=rule(s.mentions, *[s.genes] * genes, texts=s.texts if s.read is None else s.read))


def _add(s: State, rows: DataFrame) -> State:
    return s.with_(identified=rows if s.identified is None else s.identified.unionByName(rows))


def open_mentions(s: State) -> DataFrame:
    """Mentions not identified yet: later steps leave identified ones alone."""
    if s.identified is None:
        return s.mentions
    keys = ["text_id", "begin", "end"]
    return s.mentions.join(s.identified.select(*keys).distinct(), keys, "left_anti").select(*s.mentions.columns)


def identify_unambiguous(s: State) -> State:
    out = _add(s, filters.unambiguous(open_mentions(s), s.genes))
    return out.with_(mentions=open_mentions(out))


def identify_all(s: State) -> State:
    return _add(s, filters.identify_all(open_mentions(s), s.genes))


def by_species_frequency(s: State) -> State:
    keys = ["text_id", "begin", "end", "name"]
    others = [c for c in s.mentions.columns if c not in (*keys, "candidates")]
    rows = s.mentions.select(*keys, F.explode("candidates").alias("gene_id")).join(s.genes.select("gene_id", "taxon"), "gene_id", "left")
    kept = filters.species_frequency(rows, species.frequencies(s.texts if s.read is None else s.read)).groupBy(*keys).agg(F.sort_array(F.collect_set("gene_id")).alias("kept"))
    none = F.array().cast("array<string>")
    joined = s.mentions.join(kept, keys, "left").select(*keys, F.coalesce("kept", none).alias("candidates"), *others)
    return s.with_(mentions=joined.select(*s.mentions.columns))


def disambiguate(scores: Callable[[DataFrame], DataFrame], features: tuple[str, ...]) -> Step:
    """Ranks the candidates of open mentions by ``scores`` ((text_id, gene_id) -> features) within their species."""
    from textloom.operators.score import rank_candidates

    def step(s: State) -> State:
        rows = open_mentions(s).select("text_id", "begin", "end", "name", F.explode("candidates").alias("gene_id")).join(s.genes.select("gene_id", "taxon"), "gene_id")
        scored = rows.join(scores(rows.select("text_id", "gene_id").distinct()), ["text_id", "gene_id"])
        best = rank_candidates(scored, features, s.config.score_threshold, key=("text_id", "begin", "end"))
        return _add(s, best.select("text_id", "gene_id", "name", "begin", "end", F.col("score").cast("float").alias("score"), "taxon"))

    return step


def additional(s: State) -> State:
    if not s.config.additional_filters:
        return s
    if s.read is not None:  # filters of a user's own may look for the text
        s = s.with_(mentions=filters.with_text(s.mentions, s.read))
    return s.with_(mentions=filters.run_named(s.mentions, list(s.config.additional_filters), genes=s.genes, texts=s.texts, threshold=s.config.alignment_threshold))


def keep(s: State) -> State:
    """Persists the mentions: later filters read them several times, and without it each would run all before it anew."""
    return s.with_(mentions=s.mentions.persist(StorageLevel.MEMORY_AND_DISK))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that driver and executors share (``spark.checkpoint.dir``), removed when the application ends.

    The plan behind it goes too: a plan of all steps outgrows the driver's heap. A session of one process may have no such folder.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/textloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").schema(df.schema).parquet(path)


def store_texts(s: State) -> State:
    return s.with_(texts=stored(match.bounded_batches(s.texts), "texts"))


def store_mentions(s: State) -> State:
    """Stores the mentions without their text, and the first time the texts that hold any: later steps read no others."""
    mentions = stored(s.mentions.drop("plain"), "mentions")
    if s.read is not None:
        return s.with_(mentions=mentions)
    held = s.texts.join(mentions.select(F.col("text_id").alias("m_text")).distinct(), F.col("text_id") == F.col("m_text"), "left_semi")
    return s.with_(mentions=mentions, read=stored(held, "read"))


def store_identified(s: State) -> State:
    return s.with_(identified=stored(s.identified, "identified"))


#: The pipelines of the clients, as lists of steps.
SIMPLE: list[Step] = [find_species, find_names, identify_all]
INLINE: list[Step] = [
    expand_names, find_species, clean_species, find_names, unify, add_context, mention_step(filters.immediate_context), keep,
    mention_step(filters.abbreviations), keep, identify_unambiguous, gene_step(filters.unspecific_names), keep, gene_step(filters.validate_names), keep, by_species_frequency,
]
FULL: list[Step] = [
    expand_names, find_species, clean_species, store_texts, find_names, unify, mention_step(filters.general_names), add_context, mention_step(filters.immediate_context), store_mentions,
    text_step(filters.abbreviations), store_mentions, identify_unambiguous, store_identified, text_step(filters.unspecific_names, genes=True), store_mentions, align, store_mentions,
    text_step(filters.validate_names, genes=True), store_mentions, by_species_frequency, additional, identify_all,
]
SERVICE: list[Step] = [unify, add_context, mention_step(filters.immediate_context), keep, gene_step(filters.unspecific_names), keep, align, keep, by_species_frequency, identify_all]

#: What a service's task needs: later tasks imply earlier ones.
TASKS = {"sner": [find_species], "gner": [find_species, find_names], "gnorm": [find_species, find_names, *SERVICE]}


def annotate(state: State, tasks: tuple[str, ...] = ("gnorm",)) -> State:
    """The service's work for its tasks; used for batches and for streams alike."""
    best = max(tasks, key=lambda t: list(TASKS).index(t))
    return run(state, TASKS[best])

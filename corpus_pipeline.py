"""From raw documents to packed training sequences, in five stages.

Each stage takes an empty table and gives one; all but the last return the columns they got,
whatever their names. Long texts go whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, lines, mixing, packing, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts with them; no other column has a say."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, in the columns it came with, a null text as an empty one."""
    return lines.dedup_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more) stays: the smallest doc_id.

    Null, empty and blank texts are one group. Ties of a doc_id go by a hash of the text.
    """
    return simhash.keep_first(docs, words=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times; a null source is a source. Reruns agree."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids. Documents that the mix took twice are packed twice."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("source mix", source_mix), ("best-fit packing", best_fit_packing)]

#: Fingerprints, the knapsack and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage-{k}")
    return docs

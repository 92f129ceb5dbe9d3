"""Annotation of streams: the batch operators over micro-batches, with no state between texts.

A stream copies its session's settings when it starts, so the bounds of batches are set before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import bind
from textloom.operators import match
from textloom.plans.pipeline import Config, State, annotate


def text_stream(spark: SparkSession, path: str, schema: str, id_col: str, text_col: str, files_per_batch: int = 100) -> DataFrame:
    """text_id, plain from Parquet files as they appear."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.select(F.col(id_col).cast("string").alias("text_id"), F.col(text_col).alias("plain"))


def annotate_stream(stream: DataFrame, dictionary: DataFrame, genes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, tasks: tuple[str, ...] = ("gnorm",), config: Config | None = None, once: bool = True) -> StreamingQuery:
    """Every micro-batch goes through ``annotate``; ``sink`` gets its result and the batch's number.

    The checkpoint makes batches replay after a failure under the same number, so a sink that
    overwrites by number is exact. Stop with ``query.stop()``.
    """

    def work(batch: DataFrame, number: int) -> None:
        state = annotate(State(batch, dictionary, genes, config=config or Config()), tasks)
        sink(state.identified if state.identified is not None else state.mentions if state.mentions is not None else state.texts, number)

    writer = match.bounded_batches(stream).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def match_stream(stream: DataFrame, dictionary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Dictionary matches of a stream as Parquet, one folder a batch, so that a replayed batch replaces itself."""

    def work(batch: DataFrame, number: int) -> None:
        match.match_names(batch, dictionary).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return match.bounded_batches(stream).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_fields(query: Column) -> Column:
    """key=value&... -> a map with lower-case keys and decoded values; of a key given twice the last value counts."""
    decoded = F.transform(F.split(query, "&"), lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.locate("=", p) + 1)).otherwise("")).alias("v")))

    def last_of_each(pairs: Column) -> Column:
        later = lambda i, x: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"])
        return F.map_from_entries(F.filter(pairs, lambda x, i: ~later(i, x)))

    return bind(decoded, last_of_each)


def request_blocks(line: Column) -> Column:
    """The texts of a request line: what stands between <text> and </text>."""
    return F.regexp_extract_all(line, F.lit(r"(?s)<text>(.*?)</text>"), F.lit(1))


def socket_fields(line: Column) -> Column:
    """The fields of the line protocol: split at "></-/><"."""
    return F.split(F.regexp_replace(line, r"\r$", ""), "></-/><")

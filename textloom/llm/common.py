"""Helpers shared by the training-data operators: shared storage, salted ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: ASCII white space as the operators understand it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all of Spark is one process (tests) a temporary
    folder is made and kept in the session's configuration; on a cluster that is an error.
    """
    set_in = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_in:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_in = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", set_in)
    return set_in.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage at a place that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows. Spark bounds a batch by bytes; this bounds what becomes Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release_memory() -> None:
    """Give memory that Arrow and the allocator hold unused back to the system, at the end of a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until it is none of ``taken`` (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Slices of a hot key. The small per-slice count table has at most this many rows a key.
SALTS = 256


def ranks_within(df: DataFrame, keys: list[str], order: list[str], salt: Column, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """Add ``rank``: the exact 0-based rank of each row among the rows of equal ``keys``.

    Rows are first cut into ``salts`` slices by ``salt`` (0 to ``salts`` - 1), so that a key
    that holds a third of all rows is still spread over many tasks. Ranks follow the slice
    number, then ``order``, which must name enough columns that only identical rows tie.
    ``df`` is read twice and should be materialised.
    """
    # the keys as one struct: its fields compare null-safely, so the join keeps the window's partitioning and order
    cut = df.withColumn("__k", F.struct(*keys)).withColumn("__salt", salt.cast("int"))
    counts = cut.groupBy("__k", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__k").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__k", "__salt", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__k", "__salt").orderBy(*order)
    ranked = cut.withColumn("__in", F.row_number().over(within) - 1)
    return ranked.join(base.hint("merge"), ["__k", "__salt"]).withColumn(rank, F.col("__base") + F.col("__in")).drop("__k", "__salt", "__in", "__base")


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) of links between long ids -> (node, root): the smallest id reachable.

    Alternates large-star and small-star steps, each one aggregation and one join over the
    links, until a round changes none. The state is a table in the shared folder; nothing is
    gathered on the driver but two sums a round.
    """
    spark = edges.sparkSession
    both = edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct()
    state = materialise(both, "links")
    fingerprint = None
    while True:
        sides = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(state.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(low, F.col("u") == F.col("mu")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "h2")
        down = large.join(least, F.col("hi") == F.col("h2"))
        small = down.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        state = materialise(small, "small-star")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == fingerprint:
            break
        fingerprint = tuple(now)
    roots = state.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.unionByName(state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

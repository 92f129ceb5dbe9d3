"""Line dedup across documents over levelled sorted runs of line hashes.

A store holds the hashes of all lines seen so far in runs: tables bucketed and sorted by hash,
grouped in levels. A batch is merge-joined with each run as it lies, with neither exchange nor
sort of the run (a hash found there came earlier); what is new is kept in its own smallest
doc_id and added as a run. When a level holds ``fan_out`` runs they are merged into one run of
the next level. Each batch is as large as all before it, so the runs read are in proportion to
the corpus however many batches there are.

DataFrame operations only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

MIN_CHARS = 10
FAN_OUT = 2
#: Documents of the first batch; the second has as many, and each later one as many as all before it.
FIRST = 10_000
#: Hashes of a bucket, about: the runs of a store have as many buckets as the corpus needs.
BUCKET = 2_000_000
#: Document ids that place the bounds of batches; they decide the batches' sizes and no result.
BOUNDS = 1000


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased; other letters stay."""
    bare = F.regexp_replace(line, rf"^[{common.SPACE}]+|[{common.SPACE}]+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class LineRuns:
    """The levelled store. ``levels[k]`` lists the runs of level k, as names of bucketed tables and their paths."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, buckets: int = 8):
        self.spark, self.fan_out, self.buckets = spark, fan_out, buckets
        self.levels: list[list[tuple[str, str]]] = [[]]
        self.compactions = 0

    def _write(self, hashes: DataFrame, level: int) -> None:
        name = f"textloom_run_{uuid.uuid4().hex}"
        dealt = hashes.select("h1", "h2").repartition(self.buckets, "h1", "h2")  # one file a bucket
        path = common.new_path(self.spark, f"run-{level}")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            common.drop_path(self.spark, path)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    @contextmanager
    def _as_sorted(self) -> Iterator[None]:
        """While a batch is joined, the order of a bucket's one file counts as the order of its rows."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def marked(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` (distinct h1, h2 and more) with ``old``: does a run hold the hash? One merge join a run."""
        out = hashes.repartition(self.buckets, "h1", "h2").withColumn("old", F.lit(False))
        for name, _ in (run for level in self.levels for run in level):
            run = self.spark.table(name).withColumn("met", F.lit(True)).hint("merge")
            out = out.join(run, ["h1", "h2"], "left").withColumn("old", F.col("old") | F.coalesce("met", F.lit(False))).drop("met")
        return out

    def add(self, hashes: DataFrame, name: str = "batch-keys", level: int = 0) -> DataFrame:
        """Merge-joins a batch with the runs, adds what they do not hold as a run of ``level``, compacts full levels.

        Returns ``hashes`` with ``old``, from a table of its own.
        """
        with self._as_sorted():
            out = common.materialise(self.marked(hashes), name)
        self._write(out.where(~F.col("old")), level)
        self.compact()
        return out

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(full := self.levels[level]) >= self.fan_out:
                # no hash is in two runs; read as plain files, so that the new run has one file a bucket
                self._write(self.spark.read.schema("h1 long, h2 long").parquet(*[path for _, path in full]), level + 1)
                self.levels[level] = []
                self.compactions += 1
                self._drop(full)
            level += 1

    def drop(self) -> None:
        """Forget all runs."""
        self._drop([run for level in self.levels for run in level])
        self.levels = [[]]


def exploded_keys(docs: DataFrame, min_chars: int, text_col: str) -> DataFrame:
    """doc_id, row (a hash of the whole row's text), pos, h1, h2 for each line whose key is long enough."""
    # a line below min_chars code points has no key of that length, so it is not even cleaned
    lines = docs.select("doc_id", F.xxhash64(text_col).alias("row"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def batch_bounds(docs: DataFrame, first: int = FIRST) -> list:
    """Largest doc_id of each batch but the last: batches of rising doc_id, each as large as all before it.

    Placed by the ids of the smallest hashes, which any type of id has; a bound that a sample of
    that size can't tell from the next one is left out.
    """
    ids = docs.where(F.col("doc_id").isNotNull())
    total = ids.count()
    if total <= first:
        return []
    spread = ids.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(BOUNDS)
    sample = sorted(r["doc_id"] for r in spread.collect())  # BOUNDS rows at most
    shares = [first * 2**k / total for k in range(int(math.log2(total / first)) + 1)]
    return sorted({sample[int(x * len(sample))] for x in shares if x < 1})


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, first: int = FIRST, fan_out: int = FAN_OUT, text_col: str = "text") -> DataFrame:
    """doc_id, row, pos of every line whose key a smaller doc_id holds.

    Documents come in batches of rising doc_id; null doc_ids count as one document after all
    others. Within a batch the smallest doc_id of a key is one aggregation with partial sums,
    so a line that half of all documents share needs no task of its own.
    """
    spark = docs.sparkSession
    bounds = batch_bounds(docs, first)
    batch = sum((F.when(F.col("doc_id") > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    keys = exploded_keys(docs, min_chars, text_col).withColumn("batch", F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(batch))
    path = common.new_path(spark, "line-keys")
    keys.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(keys.schema).parquet(path)
    sizes = {r["batch"]: r["n"] for r in stored.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
    store = LineRuns(spark, fan_out, buckets=max(8, 1 << math.ceil(math.log2(max(1, sum(sizes.values()) / BUCKET)))))
    dropped = None
    for k in sorted(sizes):
        part = stored.where(F.col("batch") == k).drop("batch")  # reads the batch's own folder
        firsts = part.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nulls"))
        # a batch enters at the level of runs of its size
        level = max(0, int(math.log(max(1, sum(v for b, v in sizes.items() if b < k) / max(1, sizes[min(sizes)])), fan_out)))
        fresh = store.add(firsts, level=level)
        # only keys that some row of this batch must lose
        shared = fresh.where(F.col("old") | (F.col("first") < F.col("last")) | (F.col("nulls") & F.col("first").isNotNull()))
        shared = shared.select("h1", "h2", F.when(~F.col("old"), F.col("first")).alias("first"), "old")
        hit = part.join(shared, ["h1", "h2"]).where(F.col("old") | ~F.col("doc_id").eqNullSafe(F.col("first")))
        hit = hit.select("doc_id", "row", "pos")
        dropped = hit if dropped is None else dropped.unionByName(hit)
    store.drop()
    return dropped if dropped is not None else stored.select("doc_id", "row", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, first: int = FIRST, fan_out: int = FAN_OUT, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with repeated lines gone, and with ``counts`` n_lines (before), n_dropped beside its columns.

    Every line whose key of at least ``min_chars`` code points stands in a document of smaller
    doc_id goes; all others stay, joined by newlines. A null or empty text is one empty line.
    Rows that share a doc_id are one document; whole repeated rows all come out. Null doc_ids
    come after all others. Extra columns are carried along, and where one is named like a count
    the count's name gets an underscore; an empty table stays empty. Long texts are split whole;
    a line is hashed whole. Each row's text is shuffled once.
    """
    gone = repeated_lines(docs, min_chars, first, fan_out, text_col)
    per_row = gone.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    base = docs.withColumn("__own", F.xxhash64(text_col))
    joined = base.join(per_row, base["doc_id"].eqNullSafe(per_row["__id"]) & (base["__own"] == per_row["__row"]), "left")

    # bound once each, as arguments of a lambda: the split text and the positions that stay
    def rebuilt(both: Column) -> Column:
        return F.array_join(F.transform(both["stay"], lambda i: F.get(both["lines"], i)), "\n")

    parts = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__gone"))
    kept = F.get(F.transform(F.array(F.struct(parts.alias("lines"), stay.alias("stay"))), rebuilt), F.lit(0))
    new_text = F.when(F.col("__gone").isNull(), text).otherwise(kept)
    n_dropped = F.coalesce(F.size("__gone"), F.lit(0))
    n_dropped = F.when(F.col("__gone").isNull(), 0).otherwise(n_dropped)
    columns = [new_text.alias(c) if c == text_col else base[c] for c in docs.columns]
    if counts:
        columns += [n.cast("long").alias(common.free_name(name, docs.columns)) for name, n in (("n_lines", n_lines), ("n_dropped", n_dropped))]
    return joined.select(*columns)

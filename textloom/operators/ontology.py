"""Distances in an ontology from its closure and lowest common ancestors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions.alignment import greedy_similarity


def code_of(accession: Column) -> Column:
    """GO:0000123 -> 123."""
    return F.regexp_extract(accession, r"([0-9]+)$", 1).cast("int")


def accession_of(code: Column) -> Column:
    return F.concat(F.lit("GO:"), F.lpad(code.cast("string"), 7, "0"))


def import_closure(rows: DataFrame) -> DataFrame:
    """(parent, child, distance) accessions as codes: obsolete terms go, "all" is 0."""
    code = lambda c: F.when(F.col(c) == "all", 0).otherwise(code_of(F.col(c)))
    kept = rows.where(~F.startswith("parent", F.lit("obsolete")) & ~F.startswith("child", F.lit("obsolete")))
    return kept.select(code("parent").alias("parent"), code("child").alias("child"), F.col("distance").cast("int").alias("distance"))


def minimal_depth(closure: DataFrame, root: int = 0) -> DataFrame:
    """code -> depth: the least distance from the root."""
    return closure.where(F.col("parent") == root).groupBy(F.col("child").alias("code")).agg(F.min("distance").alias("depth"))


def parents_of(closure: DataFrame, distance: int | None = None) -> DataFrame:
    """code, parent (at a distance, or at any above 0)."""
    rows = closure.where(F.col("distance") == distance) if distance is not None else closure.where("distance > 0")
    return rows.select(F.col("child").alias("code"), "parent").distinct()


def direct_distance(closure: DataFrame) -> DataFrame:
    """goid1, goid2 (both directions), distance: the least one on a line of descent."""
    rows = closure.select(F.col("parent").alias("goid1"), F.col("child").alias("goid2"), "distance")
    both = rows.unionByName(rows.select(F.col("goid2").alias("goid1"), F.col("goid1").alias("goid2"), "distance"))
    return both.groupBy("goid1", "goid2").agg(F.min("distance").alias("distance"))


def lowest_common_ancestors(closure: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """goid1 < goid2 -> lcaid, dist1, dist2, depthlca for pairs that are not of one line, by least summed distance, then smallest ancestor.

    Codes meet at their common ancestors: an equi-join on the parent, with the root kept for
    depths only. ``codes`` (code) limits the pairs to the codes in use, which bounds the join.
    """
    up = closure.where("distance > 0")
    if codes is not None:
        up = up.join(codes.select(F.col("code").alias("c_code")).distinct(), F.col("child") == F.col("c_code"), "left_semi")
    depth = minimal_depth(closure).withColumnRenamed("code", "d_code")
    a = up.where("parent <> 0").select("parent", F.col("child").alias("goid1"), F.col("distance").alias("dist1"))
    b = up.where("parent <> 0").select(F.col("parent").alias("p2"), F.col("child").alias("goid2"), F.col("distance").alias("dist2"))
    pairs = a.join(b, (F.col("parent") == F.col("p2")) & (F.col("goid1") < F.col("goid2")))
    direct = direct_distance(closure).select(F.col("goid1").alias("x1"), F.col("goid2").alias("x2"))
    apart = pairs.join(direct, (F.col("goid1") == F.col("x1")) & (F.col("goid2") == F.col("x2")), "left_anti")
    first = F.row_number().over(Window.partitionBy("goid1", "goid2").orderBy(F.col("dist1") + F.col("dist2"), "parent"))
    best = apart.withColumn("k", first).where("k = 1")
    return best.join(depth, F.col("parent") == F.col("d_code"), "left").select("goid1", "goid2", F.col("parent").alias("lcaid"), "dist1", "dist2", F.coalesce("depth", F.lit(0)).alias("depthlca"))


def term_distance(pairs: DataFrame, closure: DataFrame, lca: DataFrame) -> DataFrame:
    """(goid1, goid2) -> distance: d / (depth of ancestor + depths below it), by descent, else by the common ancestor; null if none.

    Equal codes are at distance 0.
    """
    depth = minimal_depth(closure)
    direct = direct_distance(closure).select(F.col("goid1").alias("x1"), F.col("goid2").alias("x2"), F.col("distance").alias("direct"))
    either = lca.select(F.col("goid1").alias("l1"), F.col("goid2").alias("l2"), "dist1", "dist2", "depthlca")
    either = either.unionByName(either.select(F.col("l2").alias("l1"), F.col("l1").alias("l2"), F.col("dist2").alias("dist1"), F.col("dist1").alias("dist2"), "depthlca"))
    d1, d2 = (depth.select(F.col("code").alias(f"c{k}"), F.col("depth").alias(f"depth{k}")) for k in (1, 2))
    rows = pairs.join(direct, (F.col("goid1") == F.col("x1")) & (F.col("goid2") == F.col("x2")), "left")
    rows = rows.join(either, (F.col("goid1") == F.col("l1")) & (F.col("goid2") == F.col("l2")), "left")
    rows = rows.join(d1, F.col("goid1") == F.col("c1"), "left").join(d2, F.col("goid2") == F.col("c2"), "left")
    upper = F.least("depth1", "depth2")
    line = F.col("direct") / (upper + F.col("direct"))
    fork = (F.col("dist1") + F.col("dist2")) / (F.col("depthlca") + F.col("dist1") + F.col("dist2"))
    distance = F.when(F.col("goid1") == F.col("goid2"), 0.0).otherwise(F.coalesce(line, fork))
    return rows.select(*pairs.columns, distance.alias("distance"))


@F.pandas_udf(DoubleType())
def _greedy(pairs: pd.Series) -> pd.Series:
    return pd.Series([greedy_similarity([(p["a"], p["b"], float("inf") if p["d"] is None or p["d"] != p["d"] else p["d"]) for p in own]) for own in pairs], dtype="float64")


def set_similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (goid1, goid2, distance) rows -> similarity of the two code sets by greedy one-to-one matching."""
    rows = pairs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("goid1").alias("a"), F.col("goid2").alias("b"), F.col("distance").alias("d"))).alias("pairs"))
    return rows.withColumn("similarity", _greedy("pairs")).drop("pairs")


def closest_pair(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The similarity of the most similar pair of codes."""
    return pairs.groupBy(*keys).agg(F.max(1 - F.col("distance")).alias("similarity"))

"""SimHash near-dedup with bit-sliced comparison.

Fingerprints within radius 2 agree on two of four 16-bit quarters, so six tables keyed by
pairs of quarters hold every candidate pair. Inside a bucket the fingerprints lie as bit
planes (plane j holds bit j of all of them); one query updates the distance to the whole
block with carry-save counters and gives the block up once every distance is over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of a bucket that one task compares; larger buckets go block against block.
BLOCK = 4096
QUARTERS = tuple(combinations(range(4), 2))


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED, chunk: int = 1 << 16) -> int:
    """64 bits; bit j is set where over half of the shingles' XXH64 have it. No words: zero.

    Works on bytes, whose white space and lower case are the ASCII ones. Long texts go in
    chunks of shingles, so memory does not follow the text.
    """
    import xxhash

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return digest(b" ".join(parts), seed)
    total = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, chunk):
        own = parts[at : at + chunk + words - 1]
        joined = [b" ".join(x) for x in zip(*(own[k:] for k in range(words)), strict=False)]
        hashes = np.fromiter((digest(x, seed) for x in joined), "<u8", len(joined))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.flatnonzero(2 * ones > total)
    return sum(1 << int(j) for j in set_bits)


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """doc_id, row (tells texts of one doc_id apart), fp (the 64 bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            got = np.fromiter((fingerprint(t, words, seed) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["doc_id", "row", "fp"])

    return docs.select("doc_id", F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row long, fp long")


def planes_of(prints: np.ndarray, bits: list[int]) -> list[int]:
    """Bit planes of uint64 fingerprints: an integer for each bit, whose bit i belongs to fingerprint i."""
    columns = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, bits]
    packed = np.packbits(columns.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def within_radius(planes: list[int], query: list[bool], everyone: int, radius: int = RADIUS) -> int:
    """The fingerprints at most ``radius`` bits from the query, as a bit set.

    Carry-save counters hold all distances at once: counter k holds bit k of every distance,
    and the last one what has overflowed. Once every distance is over the radius the block is
    given up.
    """
    counters = [0] * radius.bit_length()
    over = 0
    for plane, bit in zip(planes, query, strict=True):
        carry = plane ^ everyone if bit else plane
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
            if not carry:
                break
        over |= carry
        if over == everyone or bit_greater(counters, radius, everyone) | over == everyone:
            return 0
    return everyone & ~(bit_greater(counters, radius, everyone) | over)


def bit_greater(counters: list[int], bound: int, everyone: int) -> int:
    """Where the numbers held bit by bit are greater than ``bound``."""
    greater, equal = 0, everyone
    for k in range(len(counters) - 1, -1, -1):
        if bound >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return greater


def stars(prints: np.ndarray, bits: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """(root, member) links that join what the radius joins within a block: one a member.

    Breadth first from each fingerprint not yet reached, so every one is a query once and
    nothing is emitted for pairs that are joined already.
    """
    planes = planes_of(prints, bits)
    everyone = waiting = (1 << len(prints)) - 1
    while waiting:
        root = (waiting & -waiting).bit_length() - 1
        waiting &= waiting - 1
        queue = [root]
        while queue and waiting:
            at = queue.pop()
            query = [bool(p >> at & 1) for p in planes]
            found = within_radius(planes, query, everyone, radius) & waiting
            waiting &= ~found
            while found:
                k = (found & -found).bit_length() - 1
                found &= found - 1
                queue.append(k)
                yield root, k


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (src, dst) that connect what lies within the radius, by tables of quarters."""
    if not 0 <= radius <= 2:
        raise ValueError("four quarters find distances up to 2")
    quarter = [F.shiftrightunsigned(F.col("fp"), 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), (F.shiftleft(quarter[a], 16) + quarter[b]).alias("key")) for t, (a, b) in enumerate(QUARTERS)])
    rows = prints.select(F.col("fp").alias("node"), "fp", F.explode(keys).alias("k")).select("node", "fp", "k.t", "k.key")
    return link_buckets(rows, [[j for j in range(64) if j // 16 not in pair] for pair in QUARTERS], radius, block)


def link_buckets(rows: DataFrame, bits: list[list[int]], radius: int, block: int = BLOCK) -> DataFrame:
    """Rows (t, key, node, fp) of buckets -> links (src, dst) of nodes that connect what lies within the radius in a bucket.

    ``bits`` are those in which fingerprints of a bucket of table t may differ. The links of a
    bucket are a forest, never all pairs. A bucket over ``block`` fingerprints is dealt into
    blocks that are compared two by two, each pair a task of its own.
    """
    # buckets of one fingerprint have nothing to compare
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    held = rows.join(sizes.withColumnsRenamed({"t": "t2", "key": "k2"}), (F.col("t") == F.col("t2")) & (F.col("key") == F.col("k2")))
    n_blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    held = held.select("t", "key", "node", "fp", n_blocks.alias("nb")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    paired = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("t", "key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "node", "fp")
    dealt = paired.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: list[np.ndarray], t: int) -> list[np.ndarray]:
            own = np.concatenate(group)
            found = np.asarray(list(stars(np.ascontiguousarray(own[:, 1]).view(np.uint64), bits[t], radius)), np.int64).reshape(-1, 2)
            return own[:, 0][found]

        last, group = None, []
        for batch in batches:
            head = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            values = np.stack([batch.column(k).to_numpy() for k in (4, 5)], axis=1)
            cuts = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(values)], strict=True):
                if lo == hi:
                    continue
                key = tuple(head[lo])
                if key != last:
                    if len(group) and sum(map(len, group)) > 1:
                        out.append(links(group, int(last[0])))
                    last, group = key, []
                group.append(values[lo:hi])
            if out and len(flat := np.concatenate(out)):
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["src", "dst"])
        if len(group) and sum(map(len, group)) > 1 and len(flat := links(group, int(last[0]))):
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["src", "dst"])

    ordered = dealt.select(F.col("t").cast("long"), F.col("key").cast("long"), F.col("lo").cast("long"), F.col("hi").cast("long"), "node", "fp")
    return ordered.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, row, fp, root, component_id: the smallest doc_id reachable over links of at most ``radius`` bits.

    With a ``similarity`` links are pairs whose shingle sets are that alike, see ``shingles``.

    Equal fingerprints are one class and are linked without being compared; a null, empty or
    blank text has the fingerprint zero, linked like any other. Null doc_ids belong to their
    class and never name it unless it has no other; ``root`` (a fingerprint) tells such classes apart. Repeated rows come out as often as they
    came in; extra columns are left out; an empty table gives no rows. Long texts are read whole.
    """
    if similarity is not None:
        from textloom.llm import shingles

        return shingles.near_duplicates(docs, words, similarity, text_col)
    rows = common.materialise(fingerprints(docs, words, seed, text_col), "prints")
    classes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = common.materialise(common.connected_components(link_fingerprints(classes.select("fp"), radius)), "roots")
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("root"), "least")
    names = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.materialise(labelled.join(names.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("class_fp", "root", "component_id"), "named")
    return rows.join(named, rows["fp"] == named["class_fp"], "left").select("doc_id", "row", "fp", "root", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    """16 lower-case hexadecimal digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group left: the one that names its component.

    Where different texts share that doc_id, or have none, one of the group's own stays; where
    rows repeat doc_id and text, one row of them.
    """
    return keep_named(docs, near_duplicates(docs, text_col=text_col, **options), text_col)


def keep_named(docs: DataFrame, groups: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each of ``groups`` (doc_id, row, root, component_id) left, as ``keep_first`` says."""
    found = groups.where("doc_id <=> component_id")
    first = found.groupBy("root", "component_id").agg(F.min("row").alias("__row"))
    # keys without nulls, so that the join's partitioning serves the removal of repeats and texts are shuffled once
    id_hash = lambda c: F.xxhash64(F.lit(7), F.col(c)).alias("__id")
    marked = docs.select("*", id_hash("doc_id"), F.xxhash64(text_col).alias("__row"))
    kept = marked.join(first.select(id_hash("component_id"), "__row"), ["__id", "__row"], "left_semi")
    return kept.dropDuplicates(["__id", "__row"]).select(*docs.columns)

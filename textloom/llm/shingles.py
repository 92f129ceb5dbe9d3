"""SimHash near-dedup at a similarity of shingle sets.

A similarity of 0.8 lies some ten of 64 bits apart, beyond what tables of quarters find, so the
buckets are named by bands of least hash values of the set: at 0.8 a pair shares none of 24
bands of 5 values with a chance of 7 in 100,000, at higher ones with less. In a bucket the
fingerprints of the sets are compared bit-sliced, as in ``simhash``, at a radius that a pair at
0.8 exceeds with a chance of 2 in 10,000. What that joins is then compared by the shingle sets
themselves, so nothing under the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common, simhash

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Bits of 64 within which fingerprints are candidates.
RADIUS = 20
#: Shingles of a group that one task compares; larger groups go block against block.
BLOCK = 1 << 19


def shingle_set(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles, over bytes as in ``simhash``; a text under ``words`` words is one shingle."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = (b" ".join(x) for x in zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else (b" ".join(parts),)
    return np.unique(np.fromiter((digest(x, seed) for x in joined), np.uint64))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED, chunk: int = 512) -> list[int]:
    """One signed 64-bit digest a band; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)
    times = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32) | np.uint32(1)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, (1 << 32) - 1, np.uint32)
    for at in range(0, len(low), chunk):
        least = np.minimum(least, ((low[at : at + chunk] ^ flip) * times).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(bands, rows))]


def majority(hashes: np.ndarray) -> int:
    """The set's fingerprint as a signed number: bit j is set where over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def signatures(docs: DataFrame, words: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """doc_id, row (tells texts of one doc_id apart), fp (digest of the set, zero if empty), bits (its fingerprint), n (shingles), keys (of the bands)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in common.slices(batches):
            fp, bits, n, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, words)
                fp.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else 0)
                bits.append(majority(own))
                n.append(len(own))
                keys.append(band_keys(own))
            columns = [batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(bits, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", "bits", "n", "keys"])

    return docs.select("doc_id", F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row long, fp long, bits long, n long, keys array<long>")


def stars(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """(root, member) links that join what the similarity joins: one a member, breadth first as in ``simhash.stars``."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(of, kind="stable")]
    stops = np.cumsum(np.bincount(of, minlength=len(values)))
    waiting = np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue and waiting.any():
            at = queue.pop()
            own = of[ends[at] - sizes[at] : ends[at]]
            shared = np.bincount(np.concatenate([holders[stops[v - 1] if v else 0 : stops[v]] for v in own]), minlength=len(sets))
            for k in np.flatnonzero(waiting & (shared >= similarity * (sizes + sizes[at] - shared) - 1e-9)):
                waiting[k] = False
                queue.append(k)
                yield root, int(k)


def candidates(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Classes (fp, bits, keys) -> (node, root): groups of what lies within the radius in a bucket, over any number of steps."""
    rows = classes.select(F.col("fp").alias("node"), F.col("bits").alias("fp"), F.posexplode("keys").alias("t", "key"))
    return common.connected_components(simhash.link_buckets(rows, [list(range(64))] * BANDS, radius))


def link_sets(members: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Members (g, fp, n, text) of candidate groups -> links (src, dst) that connect what is similar enough.

    A group over ``block`` shingles is dealt into blocks that are compared two by two, each pair a task of its own.
    """
    sizes = members.groupBy("g").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("nb")).withColumnRenamed("g", "g2")
    held = members.join(sizes, F.col("g") == F.col("g2")).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    paired = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("g", F.least("b", "o").cast("long").alias("lo"), F.greatest("b", "o").cast("long").alias("hi"), "fp", "text")
    dealt = paired.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(prints: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = list(stars(sets, similarity)) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([prints[a] for a, _ in found], pa.int64()), pa.array([prints[b] for _, b in found], pa.int64())], names=["src", "dst"])

        last, prints, sets = None, [], []
        for batch in batches:
            for *key, fp, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != last:
                    yield links(prints, sets)
                    last, prints, sets = key, [], []
                prints.append(fp)
                sets.append(shingle_set(text, words))
        yield links(prints, sets)

    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """doc_id, row, fp, root, component_id: the smallest doc_id reachable over pairs at least ``similarity`` alike.

    Equal sets are one class and are linked without being compared; null, empty and blank texts
    are one class and like nothing else. Null doc_ids, repeated rows, extra columns and empty
    tables are treated as by ``simhash.near_duplicates``.
    """
    rows = common.materialise(signatures(docs, words, text_col), "sets")
    one = F.min(F.struct(F.xxhash64(F.lit(7), "doc_id").alias("id"), "row")).alias("one")
    classes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), one, F.first("bits").alias("bits"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    near = candidates(classes).select(F.col("node").alias("fp"), F.col("root").alias("g"))
    wanted = classes.join(near, "fp").select("fp", "g", "n", F.col("one.id").alias("id"), F.col("one.row").alias("row"))
    texts = docs.select(F.xxhash64(F.lit(7), "doc_id").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    members = common.materialise(texts.join(wanted, ["id", "row"]).select("fp", "g", "n", "text").dropDuplicates(["fp"]), "members")
    roots = common.materialise(common.connected_components(link_sets(members, words, similarity)), "roots")
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("root"), "least")
    names = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.materialise(labelled.join(names.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("class_fp", "root", "component_id"), "named")
    return rows.join(named, rows["fp"] == named["class_fp"], "left").select("doc_id", "row", "fp", "root", "component_id")

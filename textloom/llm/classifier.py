"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are words, word shapes (letters and digits collapsed to their kinds) and the pairs of
neighbours of both, hashed into one space. A feature's value is its share of the text's
features, so a score is a mean of weights: a sparse dot product without a sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common

BITS = 18
#: Bound of the training sample: labelled rows of the smallest hashes.
SAMPLE = 20_000
#: Bound of its bytes: different features of all rows together, at 8 bytes each.
FEATURES = 20_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.5
#: A feature's share is small; this brings sums to the scale of a logit.
SCALE = 40.0
CACHE = 300_000
SEED = 42


class Features:
    """Hashed features of texts; words met before come from a bounded cache."""

    def __init__(self, bits: int = BITS, cache: int = CACHE):
        import xxhash

        self.bits, self.limit, self.digest = bits, cache, xxhash.xxh64_intdigest
        self.cache: dict[str, int] = {}
        self.shape = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"[0-9]+", "0"))]

    def _learn(self, word: str) -> int:
        # the upper half is the word's own hash, the lower half its shape's
        form = word
        for pattern, kind in self.shape:
            form = pattern.sub(kind, form)
        return (self.digest(word.lower().encode("utf-8", "surrogatepass"), 1) >> 32) << 32 | self.digest(form.encode("utf-8", "surrogatepass"), 2) >> 32

    def of(self, text: str | None) -> np.ndarray:
        """Indices of all features of a text, repeats included; none for a null or blank text."""
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int64)
        if len(self.cache) > self.limit:
            self.cache = dict(islice(self.cache.items(), self.limit // 2))
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self._learn(w)
        both = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        own, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        keys = np.concatenate([own * a, form * b, (own[:-1] * b + own[1:]) * c, (form[:-1] * a + form[1:]) * b])
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader, proximal, with a rate for each coordinate; the last one is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS, most: int = FEATURES, text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights (2**bits and a bias) from labelled rows that are not held out, at most ``sample`` of them.

    Features are made in parallel; one task then holds those rows of the sample, in the order of
    their hashes, that have ``most`` different features between them, and goes through them epoch
    by epoch in seeded orders. Only the non-zero weights come back, at most 2**bits of them. No
    rows: all weights zero. Of labels that differ for one doc_id the larger counts.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(), F.lit(False))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    chosen = usable.withColumn("turn", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("turn", "doc_id").limit(sample)
    chosen = common.materialise(chosen.withColumnRenamed("doc_id", "__id"), "labelled")
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # `sample` short rows at most

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in common.slices(batches):
            at, share = [], []
            for text in batch.column(2).to_pylist():
                keys = features.of(text)
                kinds, counts = np.unique(keys, return_counts=True)
                at.append(kinds.astype(np.int32))
                share.append((counts * (SCALE / max(1, len(keys)))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["turn", "label", "at", "share"])

    ready = rows.select("turn", "label", "text").mapInArrow(featurise, "turn long, label int, at array<int>, share array<float>")
    ready = common.materialise(ready, "training-rows")
    so_far = Window.orderBy("turn", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit_in = ready.select("turn", "label", F.sum(F.size("at")).over(so_far).alias("held")).where(F.col("held") <= most)  # `sample` rows of numbers
    last = fit_in.agg(F.max(F.struct("turn", "label"))).first()[0]
    held = ready.where("false") if last is None else ready.where(F.struct("turn", "label") <= F.struct(F.lit(last["turn"]), F.lit(last["label"])))
    order = held.repartition(1).sortWithinPartitions("turn", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << bits)
        held = [(label, at.values.to_numpy(), share.values.to_numpy()) for batch in batches for label, at, share in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)]
        for epoch in range(epochs):
            for k in np.random.default_rng((SEED, epoch)).permutation(len(held)):
                label, at, share = held[k]
                model.learn(at.astype(np.int64), share.astype(float), label)
        w = model.weights().astype(np.float32)
        used = np.flatnonzero(w).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()]), pa.array([w[used].tobytes()])], names=["at", "weight"])

    out = np.zeros((1 << bits) + 1, np.float32)
    for row in order.select("label", "at", "share").mapInArrow(fit, "at binary, weight binary").collect():
        out[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["weight"], np.float32)
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null or blank text gets the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), shared.value
        bias = float(w[-1])
        for batch in common.slices(batches):
            logits = np.full(batch.num_rows, bias)
            for k, text in enumerate(batch.column(1).to_pylist()):
                keys = features.of(text)
                if len(keys):
                    logits[k] += SCALE * float(w[keys].mean(dtype=np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows that are not held out, then score every row of ``docs``.

    Labels, language, source and ids are no inputs of a score. Repeated rows are scored each; a
    null doc_id is never held out nor labelled; extra columns are left out. Long texts are read
    whole, and their score is a mean over all features. Without labelled rows every score is 0.5.
    An empty table gives no rows.
    """
    return score(docs, train(docs, labels, **options))

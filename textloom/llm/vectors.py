"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class. The classes of a label are dealt into shards of bounded size,
each with a graph of its own; every shard is queried with every class of its label. A query
walks down the layers, beams through the lowest one, and spreads on from there through all
vectors near the threshold. An audit holds a sample of each task's linked queries against brute
force and widens beam and spread until their links are found; a task that fails, or has too few
links to audit, is compared as a whole. Every link is verified by its cosine in double precision.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common

THRESHOLD = 0.98
#: Classes of a shard: bounds a task's memory (a link matrix of its square in bytes).
SHARD = 4096
LINKS = 12
BUILD_BEAM = 48
BEAM = 24
SLACK = 0.02
#: Linked queries that an audit holds against brute force, and the queries it looks among at first.
AUDIT, LOOK = 16, 64
#: The audit passes at this mean recall of its linked queries.
RECALL = 0.995
SEED = 42


class Graph:
    """A small-world graph over unit vectors; similarity is the inner product."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = SEED):
        self.unit, self.m, self.beam = unit, links, beam
        n = len(unit)
        self.seen = [0] * n
        self.tick = 0
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        self.layers: list[dict[int, list[int]]] = []
        self.top = -1
        for i in range(n):
            self._insert(i, int(levels[i]))
        self.near = np.repeat(np.arange(n)[:, None], 2 * links, axis=1)
        for i, own in self.layers[0].items() if n else ():
            self.near[i, : len(own)] = own

    def _spread(self, q: np.ndarray, starts: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The best ``beam`` of what a greedy walk from ``starts`` meets, best first."""
        self.tick += 1
        seen, tick, links, unit = self.seen, self.tick, self.layers[layer], self.unit
        for s in starts:
            seen[s] = tick
        first = [(float(x), s) for x, s in zip(unit[starts] @ q, starts, strict=True)]
        ahead = [(-x, s) for x, s in first]
        heapq.heapify(ahead)
        best = list(first)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while ahead:
            x, at = heapq.heappop(ahead)
            if -x < best[0][0] and len(best) >= beam:
                break
            fresh = [k for k in links[at] if seen[k] != tick]
            if not fresh:
                continue
            for k in fresh:
                seen[k] = tick
            for s, k in zip((unit[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (s, k))
                    heapq.heappush(ahead, (-s, k))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, k))
                    heapq.heappush(ahead, (-s, k))
        return sorted(best, reverse=True)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first, then the nearest of the others."""
        if len(found) <= most:
            return [k for _, k in found]
        ids = [k for _, k in found]
        between = (self.unit[ids] @ self.unit[ids].T).tolist()
        chosen: list[int] = []
        for a, (s, _) in enumerate(found):
            row = between[a]
            if all(row[b] < s for b in chosen):
                chosen.append(a)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [a for a in range(len(ids)) if a not in taken][: most - len(chosen)]
        return [ids[a] for a in chosen]

    def _insert(self, i: int, level: int) -> None:
        q = self.unit[i]
        while len(self.layers) <= level:
            self.layers.append({})
        if self.top < 0:
            self.entry = i
        starts = [self.entry]
        for layer in range(self.top, level, -1):
            starts = [self._spread(q, starts, 1, layer)[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            found = self._spread(q, starts, self.beam, layer)
            most = 2 * self.m if layer == 0 else self.m
            links = self.layers[layer]
            links[i] = self._select(found, self.m)
            for k in links[i]:
                links[k].append(i)
                if len(links[k]) > most:
                    own = links[k]
                    by = sorted(zip((self.unit[own] @ self.unit[k]).tolist(), own, strict=True), reverse=True)
                    links[k] = self._select(by, most)
            starts = [k for _, k in found]
        for layer in range(self.top + 1, level + 1):
            self.layers[layer][i] = []
        if level > self.top:
            self.top, self.entry = level, i

    def upper(self) -> np.ndarray:
        """The layers above the lowest as rows of (layer, node, neighbours, filled up with the node)."""
        rows = [[layer, i, *own, *[i] * (self.m - len(own))] for layer, links in enumerate(self.layers) if layer for i, own in links.items()]
        return np.asarray(rows, np.int32).reshape(-1, self.m + 2)

    @classmethod
    def stored(cls, unit: np.ndarray, near: np.ndarray, upper: np.ndarray, entry: int, links: int = LINKS) -> Graph:
        """A graph again from its arrays: the lowest layer's neighbours and ``upper``."""
        graph = cls.__new__(cls)
        graph.unit, graph.entry, graph.m, graph.seen, graph.tick = unit, entry, links, [0] * len(unit), 0
        graph.near = near.reshape(len(unit), -1)
        upper = upper.reshape(-1, links + 2)
        graph.top = int(upper[:, 0].max(initial=0))
        graph.layers = [{} for _ in range(graph.top + 1)]
        for i, own in enumerate(graph.near.tolist()):
            graph.layers[0][i] = [k for k in own if k != i]
        for layer, i, *own in upper.tolist():
            graph.layers[layer][i] = [k for k in own if k != i]
        return graph

    def within(self, q: np.ndarray, threshold: float, beam: int, slack: float, start: int | None = None) -> np.ndarray:
        """Indices of the vectors found at ``threshold`` or above."""
        if start is None:
            starts = [self.entry]
            for layer in range(self.top, 0, -1):
                starts = [self._spread(q, starts, 1, layer)[0][1]]
        else:
            starts = [start]
        front = np.asarray([k for s, k in self._spread(q, starts, beam, 0) if s >= threshold - slack], np.int64)
        met = np.zeros(len(self.unit), bool)
        met[front] = True
        hits = [front[self.unit[front] @ q >= threshold]]
        while len(front):
            fresh = np.zeros(len(met), bool)
            fresh[self.near[front].ravel()] = True
            fresh &= ~met
            ids = np.flatnonzero(fresh)
            met[ids] = True
            s = self.unit[ids] @ q
            hits.append(ids[s >= threshold])
            front = ids[s >= threshold - slack]
        return np.concatenate(hits)


def links_of(graph: Graph, queries: np.ndarray, threshold: float, own: bool, audit: int = AUDIT, recall: float = RECALL) -> tuple[np.ndarray, int, int]:
    """Boolean matrix queries x vectors of the links found, and the audit: true links of its sample, and those found.

    The sample grows until ``audit`` of its queries have links besides themselves; beam and spread
    widen until the mean recall of these queries passes. A task without that many linked queries
    has been compared as a whole by then, and one that fails at the widest is: both take the exact
    links.
    """
    n = len(queries)

    def exact(rows: np.ndarray) -> np.ndarray:
        found = queries[rows] @ graph.unit.T >= threshold
        if own:
            found[np.arange(len(rows)), rows] = False
        return found

    order = np.random.default_rng(SEED).permutation(n)
    sample, truth = order[:0], np.zeros((0, len(graph.unit)), bool)
    while len(sample) < n and np.count_nonzero(truth.any(axis=1)) < audit:
        more = order[len(sample) : max(2 * len(sample), LOOK)]
        sample, truth = np.concatenate([sample, more]), np.concatenate([truth, exact(more)])
    linked = np.flatnonzero(truth.any(axis=1))
    if len(sample) == n:
        out = np.zeros_like(truth)
        out[sample] = truth
        return out, int(truth.sum()), int(truth.sum())
    beam, slack = BEAM, SLACK
    run = lambda k: graph.within(queries[k], threshold, beam, slack, int(k) if own else None)
    while slack < 2.5:
        found = [int(truth[a][run(sample[a])].sum()) for a in linked[: 4 * LOOK]]
        wanted = truth[linked[: 4 * LOOK]].sum(axis=1)
        if (found / wanted).mean() >= recall:
            break
        beam, slack = 2 * beam, 2 * slack
    else:
        return np.concatenate([exact(np.arange(k, min(k + 512, n))) for k in range(0, n, 512)]), int(wanted.sum()), int(wanted.sum())
    out = np.zeros((n, len(graph.unit)), bool)
    for k in range(n):
        out[k, run(k)] = True
    if own:
        out |= out.T
        np.fill_diagonal(out, False)
    out[sample] |= truth
    if own:
        out |= out.T
    return out, int(wanted.sum()), int(sum(found))


def forest(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """(root, member) over the rows' joint components of a symmetric link matrix."""
    waiting = links.any(axis=1)
    for root in np.flatnonzero(waiting):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = np.asarray([root])
        while len(front):
            fresh = links[front].any(axis=0) & waiting
            front = np.flatnonzero(fresh)
            waiting[front] = False
            yield from ((int(root), int(k)) for k in front)


def summed(links: np.ndarray, rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray] | None) -> pd.DataFrame:
    """What a task reports: (a, b, links): links of class a to other classes' vectors (b null), or a joint a-b.

    ``rows`` and ``columns`` are (class ids, vectors of each class); no columns: one shard with itself.
    """
    ids, weights = rows
    parts = []
    if columns is None:
        parts.append((ids, links @ weights))
        joints = np.asarray(list(forest(links)), np.int64).reshape(-1, 2)
        ends = ids[joints]
    else:
        other, other_weights = columns
        parts += [(ids, links @ other_weights), (other, links.T @ weights)]
        r, c = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        small = links[np.ix_(r, c)]
        both = np.zeros((len(r) + len(c),) * 2, bool)
        both[: len(r), len(r) :] = small
        both[len(r) :, : len(r)] = small.T
        names = np.concatenate([ids[r], other[c]])
        ends = names[np.asarray(list(forest(both)), np.int64).reshape(-1, 2)]
    counts = pd.DataFrame({"a": np.concatenate([p[0] for p in parts]), "links": np.concatenate([p[1] for p in parts])})
    counts = counts[counts["links"] > 0].assign(b=-1)
    return pd.concat([counts, pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1], "links": 0})])[["a", "b", "links"]].astype("int64")


def audited(wanted: int, got: int) -> pd.DataFrame:
    """An audit as a row of the reports: b is -2."""
    return pd.DataFrame({"a": [wanted], "b": [-2], "links": [got]}, dtype="int64")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding, label).

    Rows are compared only within a label that is not null. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing and is its own component; so are
    vectors of another length than the others. Rows that repeat a vector, or a whole row, are
    other vectors with links. Ties have no say: every pair at the threshold is linked. A null vec_id names a component only if it has no other.
    Extra columns are left out; an empty table gives no rows.
    """
    spark = rows.sparkSession
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", F.col("label"), vector.alias("v"), fine.alias("fine"))
    keyed = keyed.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(7), F.col("label"), F.col("v")))
    classes = keyed.where("fine").groupBy("label", F.size("v").alias("dim"), "v", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = common.materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).alias("shards")).select(F.col("label").alias("l2"), F.col("dim").alias("d2"), "shards")
    dealt = classes.join(sizes, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2"))).select("label", "dim", F.pmod(F.xxhash64("cid"), "shards").alias("shard"), "shards", "cid", "n", "v")
    label = rows.schema["label"].dataType.simpleString()

    def unit_of(stored: np.ndarray) -> np.ndarray:
        scaled = stored / np.abs(stored).max(axis=1, keepdims=True)  # keeps extreme values from overflowing
        return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # at most about `shard` classes: one graph, queried with its own vectors
        pdf = pdf.sort_values("cid", ignore_index=True)
        unit = unit_of(np.stack(pdf["v"].to_numpy()).astype(float))
        graph = Graph(unit)
        ids, n = pdf["cid"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        links, wanted, got = links_of(graph, unit, threshold, own=True)
        out = pd.concat([summed(links, (ids, n), None), audited(wanted, got)]).assign(label=pdf["label"].iloc[0], dim=pdf["dim"].iloc[0], shard=pdf["shard"].iloc[0], ids=None, n=None, unit=None, near=None, upper=None, entry=-1)
        if pdf["shards"].iloc[0] > 1:  # other shards are queried later: store the graph
            row = {"a": -1, "b": -1, "links": -1, "label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "ids": ids.tobytes(), "n": n.tobytes(), "unit": unit.tobytes(), "near": graph.near.astype(np.int32).tobytes(), "upper": graph.upper().tobytes(), "entry": graph.entry}
            out = pd.concat([out, pd.DataFrame([row])])
        return out

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            for r in batch.to_pylist():
                mine, theirs = (np.frombuffer(r[f"unit{k}"]).reshape(-1, r["dim"]) for k in "12")
                graph = Graph.stored(theirs, np.frombuffer(r["near2"], np.int32), np.frombuffer(r["upper2"], np.int32), r["entry2"])
                own, other = ((np.frombuffer(r[f"ids{k}"], np.int64), np.frombuffer(r[f"n{k}"], np.int64)) for k in "12")
                links, wanted, got = links_of(graph, mine, threshold, own=False)
                out = pd.concat([summed(links, own, other), audited(wanted, got)])
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    built = common.materialise(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"a long, b long, links long, label {label}, dim int, shard long, ids binary, n binary, unit binary, near binary, upper binary, entry long"), "graphs")
    stored = built.where("links < 0")
    left = stored.select("label", "dim", F.col("shard").alias("s1"), F.col("ids").alias("ids1"), F.col("n").alias("n1"), F.col("unit").alias("unit1"))
    right = stored.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("shard").alias("s2"), F.col("ids").alias("ids2"), F.col("n").alias("n2"), F.col("unit").alias("unit2"), F.col("near").alias("near2"), F.col("upper").alias("upper2"), F.col("entry").alias("entry2"))
    # shard against shard, in blocks; a row is a pair of shards and is dealt to a task of its own
    pairs = left.join(right, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2")) & (F.col("s1") < F.col("s2"))).select("dim", "s1", "s2", "ids1", "n1", "unit1", "ids2", "n2", "unit2", "near2", "upper2", "entry2")
    crossed = common.materialise(pairs.repartition("dim", "s1", "s2", F.xxhash64("ids1")).mapInArrow(across, "a long, b long, links long"), "crossed")
    reports = built.where("links >= 0").select("a", "b", "links").unionByName(crossed)
    seen = reports.where("b = -2").agg(F.sum("a").alias("wanted"), F.sum("links").alias("got")).first()
    if seen["wanted"]:
        logging.getLogger(__name__).info("audits found %d of %d links", seen["got"], seen["wanted"])
    counts = reports.where("b = -1").groupBy(F.col("a").alias("cid2")).agg(F.sum("links").alias("links"))
    roots = common.connected_components(reports.where("b >= 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "cid3")
    joined = classes.select("cid", "h1", "h2", "least", "n").join(counts, F.col("cid") == F.col("cid2"), "left").join(roots, F.col("cid") == F.col("cid3"), "left").withColumn("root", F.coalesce("root", "cid"))
    joined = common.materialise(joined.select("h1", "h2", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "linked")
    names = joined.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = joined.join(names, F.col("root") == F.col("r")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "n_links", "component_id")
    named = common.materialise(named, "named-vectors")
    out = keyed.select("vec_id", F.when(F.col("fine"), F.col("h1")).alias("h1"), F.when(F.col("fine"), F.col("h2")).alias("h2"), "fine")
    out = out.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

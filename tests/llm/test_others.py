"""Archives, vectors and the pipeline against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import sys
from pathlib import Path

import numpy as np
import pytest
from llm_data import make
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from textloom.llm import common, vectors, warc  # noqa: E402
from textloom.llm.queries import ORACLES, QUERIES  # noqa: E402

PAGES = "page_id long, url string, html string, digest string, first long"


def test_warc_round_trip(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"
    rows = [(5, "http://a/x?q=1#f", "<p>é\r\n\r\n</p>"), (2, "http://a/y", "<p>é\r\n\r\n</p>"), (9, None, None), (3, "bad url\r\nX: y", ""), (7, "http://b", tricky), (7, "http://b", tricky), (None, "http://n", "<p>é\r\n\r\n</p>"), (8, "http://long", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(3)
    path = common.new_path(spark, "warc-test")
    out = warc.captures(pages, path, payload=True).collect()
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    expected = sorted(((i, u, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, u, h in rows), key=str)
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == expected
    for r in out:
        assert r["request"]["record_id"] == r["response"]["concurrent_to"] == r["metadata"]["concurrent_to"]
        assert r["response"]["payload_digest"] == r["payload_digest"]
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(r["response"]["block"].encode()).digest()).decode() == r["payload_digest"]
    files = list(Path(path).rglob("*.warc.gz"))
    assert files
    records = [h for f in files for h, _ in warc.parse(io.BufferedReader(gzip.open(f)))]
    assert len(records) == 3 * len(rows)


def test_warc_large_payloads_go_to_files_of_few(spark):
    rows = [(k, "http://a", f"{k}" * (3000 if k % 4 == 0 else 3)) for k in range(60)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).coalesce(1)
    path = common.new_path(spark, "warc-large")
    warc.write(pages, path, file_records=20, small=1000)
    sizes = [[len(b) for _, b in warc.parse(io.BufferedReader(gzip.open(f)))] for f in Path(path).rglob("*.warc.gz")]
    assert sum(map(len, sizes)) == 180 and max(len(x) for x in sizes) == 60 and all(sum(n > 2000 for n in x) <= 8 for x in sizes)
    assert len(warc.captures(pages, payload=True).where("length(response.block) > 2000").collect()) == 15


def test_warc_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "http://a", "abc", "d", 1), (2, "http://a", "abc", "d", 1)], PAGES)
    assert {r["record_type"] for r in warc.captures(pages, least=4).collect()} == {"response"}
    assert warc.captures(spark.createDataFrame([], PAGES)).collect() == []


def test_base32(spark):
    r = spark.sql("SELECT sha1('x') AS h").select(warc.base32(F.col("h")).alias("b")).first()
    assert r["b"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode()


def brute_vectors(rows, threshold=0.98):
    fine = [(k, np.asarray(v, float)) for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    links = {k: set() for k in range(len(rows))}
    for a, (i, x) in enumerate(fine):
        for j, y in fine[:a]:
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.mark.parametrize("shard", [4096, 12])
def test_vectors_match_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for centre in rng.normal(size=(12, 8)):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((k, [float(np.float32(x)) for x in centre + rng.normal(size=8) * 0.03], int(rng.integers(0, 2))))
            k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, None, 0), (k + 2, [0.0] * 8, 0), (k + 3, [float("nan")] * 8, 0), (k + 4, [1.0, None] * 4, 0), (k + 5, rows[0][1], None), (k + 6, [], 0), (k + 7, [1.0, 2.0], 0), (k + 8, [x * 3 for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, label int, cid long, n long").repartition(3)
    links = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    root = {}
    for i in sorted(links):
        if i not in root:
            queue = [i]
            root[i] = i
            while queue:
                for j in links[queue.pop()]:
                    if j not in root:
                        root[j] = i
                        queue.append(j)
    out = {r["vec_id"]: r for r in vectors.near_vectors(df, shard=shard).collect()}
    assert len(out) == len(rows)
    for i in range(len(rows)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (len(links[i]), root[i], root[i] == i)


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    out = vectors.near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3 + [(None, [1.0, 2.0], 0)], schema)).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(3, 1)}


def test_vector_recall_on_a_dense_cluster():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1, 32)) + rng.normal(size=(300, 32)) * 0.02, rng.normal(size=(300, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = unit @ unit.T >= 0.98
    np.fill_diagonal(truth, False)
    graph = vectors.Graph(unit)
    found, wanted, got = vectors.links_of(graph, unit, 0.98, own=True)
    assert not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum() and 0.99 * wanted <= got <= wanted
    # the same graph from its arrays, queried by other vectors
    again = vectors.Graph.stored(unit, graph.near.astype(np.int32), graph.upper(), graph.entry)
    for k in (0, 299, 450):
        assert sorted(again.within(unit[k], 0.98, 24, 0.02)) == sorted(graph.within(unit[k], 0.98, 24, 0.02))


def test_vector_links_across_shards_of_production_size():
    rng = np.random.default_rng(7)
    near = rng.normal(size=(600, 64))
    sides = [np.concatenate([near + rng.normal(size=near.shape) * 0.05, rng.normal(size=(1448, 64))]) for _ in range(2)]
    mine, theirs = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in sides)
    truth = mine @ theirs.T >= 0.98
    found, wanted, got = vectors.links_of(vectors.Graph(theirs), mine, 0.98, own=False)
    assert truth.sum() >= 600 and not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum() and got >= 0.99 * wanted > 0


def test_vectors_that_no_graph_finds_are_compared_as_a_whole():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + rng.normal(size=(200, 16)) * 0.01
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = unit @ unit.T >= 0.98
    np.fill_diagonal(truth, False)
    lost = vectors.Graph(unit)
    lost.within = lambda *_, **__: np.zeros(0, np.int64)
    assert (vectors.links_of(lost, unit, 0.98, own=True)[0] == truth).all()
    # few links: the audit has looked at every query by then
    few = np.concatenate([unit[:100], unit[200:205]])
    near = few @ few.T >= 0.98
    np.fill_diagonal(near, False)
    lost.unit = few
    assert (vectors.links_of(lost, few, 0.98, own=True)[0] == near).all() and near.any()


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (5, 5)], "src long, dst long")
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 100: 100, 101: 100}
    assert common.connected_components(edges.where("src < 0")).collect() == []


def test_salted_ranks_are_exact(spark):
    rows = spark.createDataFrame([(k % 2 if k < 90 else None, k) for k in range(100)], "g int, v long")
    out = common.ranks_within(rows, ["g"], ["v"], F.pmod("v", F.lit(4)), salts=4).collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append(r["rank"])
    assert {g: sorted(x) for g, x in by.items()} == {0: list(range(45)), 1: list(range(45)), None: list(range(10))}


def test_stages_keep_the_columns(spark, edge, sf):
    docs = make(spark, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in common.table(spark, sf, "documents").collect()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf), "t")
        assert docs.columns == edge.columns and docs.count() > 0


def test_pipeline_against_its_stages(spark, sf):
    from textloom.llm import lines, mixing, packing, quality_rules, simhash

    near = {"words": 5, "similarity": 0.8}
    docs = common.table(spark, sf, "documents")
    good = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    docs = docs.where(F.col("doc_id").isin(list(good)))
    docs = spark.createDataFrame(lines.dedup_lines(docs).select(*docs.columns).collect(), docs.schema)
    first = {r["doc_id"] for r in simhash.near_duplicates(docs, **near).collect() if r["doc_id"] == r["component_id"]}
    docs = docs.where(F.col("doc_id").isin(list(first)))
    taken = {r["doc_id"]: 1 if not r["size"] else r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.run(spark, sf).toPandas()
    counts = out[out.piece == 0].groupby("doc_id").size().to_dict()
    assert counts == {i: n for i, n in taken.items() if n}
    assert (out.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()
    assert out["length"].sum() / packing.CAPACITY > 0.98 * (out.sequence_id.nunique() - 1)


def test_names_cover_the_operators():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in rel.description)
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    names = [c[0] for c in rel.description]
    expected = sorted(str([r[names.index(c)] for c in columns]) for r in rel.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == expected

"""What keeps a task's memory and time in bounds when batches, texts and groups are large."""

import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.functions import ranges
from textloom.functions.text import sentence_span
from textloom.operators import filters, match, species
from textloom.plans import pipeline, queries
from textloom.sources import sinks


def texts_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["text_id", "plain"])


def test_grams_leave_in_bounded_batches():
    batch = texts_batch(["the cat sat on the mat " * 500, None, "", "x"] * 4)
    sizes = [b.num_rows for b in match.gram_batches([batch], [1, 2, 3], at_once=1000)]
    assert max(sizes) <= 1003 and sum(sizes) == 4 * (3000 + 2999 + 2998 + 1)


def test_sieve_keeps_every_name(spark):
    names = spark.createDataFrame([("of the", "G1", 1), ("the", "G2", 1), ("Éa b", "G3", 1), ("a-b", "G4", 2)], "name string, id string, taxon int")
    d = match.merge_dictionary(names)
    sieve = match.key_sieve(d, 4)
    grams = lambda s: {(r["key"], r["begin"]) for b in match.gram_batches([texts_batch(["Of the (a-b) Éa b the of"])], [1, 2, 3], s) for r in b.to_pylist()}
    keys = {r["key"] for r in d.collect()}
    assert {g for g in grams(None) if g[0] in keys} == {g for g in grams(sieve) if g[0] in keys} != set()
    assert len(grams(sieve)) < len(grams(None))


def test_sieve_leaves_only_names(spark):
    names = spark.createDataFrame([("of the", "G1", 1), ("the and that", "G2", 1), ("k", "G3", 1)], "name string, id string, taxon int")
    sieve = match.key_sieve(match.merge_dictionary(names), 3)
    text = "of the and of that, the and; Of The (\u212a) the and that"
    got = [(r["key"], r["name"], r["begin"], r["end"]) for b in match.gram_batches([texts_batch([text])], [1, 2, 3], sieve) for r in b.to_pylist()]
    assert got == [("of the", "of the", 0, 5), ("of the", "Of The", 29, 34), ("k", "\u212a", 37, 37), ("the and that", "the and that", 40, 51)]


def test_grams_of_odd_characters():
    rng, token = random.Random(7), re.compile(match.TOKENIZERS["simple"], re.ASCII)
    pieces = ["a", "K", "\u212a", "É", "İ", "Σ", "𝒳", "日本", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\x00", ".", ",", "(", ")", "/", "-", ":", "_", "the", "9", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    wanted = set()
    for k, t in enumerate(texts):
        places = [m.span() for m in token.finditer(t)]
        for i, (a, _) in enumerate(places):
            for span in (places[i : i + n] for n in (1, 3) if i + n <= len(places)):
                b = span[-1][1]
                if (a == 0 or t[a - 1] in " :(/-") and (b == len(t) or t[b] in " ,.:;)/-+("):
                    wanted.add((k, " ".join(t[x:y] for x, y in span).lower(), t[a:b], a, b - 1))
    for chars in (1, 50, 1 << 18):
        got = [tuple(r.values()) for b in match.gram_batches([texts_batch(texts)], [1, 3], chars_at_once=chars) for r in b.to_pylist()]
        assert len(got) == len(wanted) and set(got) == wanted


def test_context_reads_a_text_once(spark):
    rng = random.Random(5)
    pieces = ["a", "é", ". ", ".", " ", " e.g. ", ". al. ", "x vs. ", "\n vs. ", "word"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(150)] + ["no stop at all", ". ", "x e.g. y", "et. al. z"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, plain string")
    m = t.select("text_id", F.explode(F.sequence(F.lit(-1), F.length("plain") + 1)).alias("begin"), F.lit(0).alias("end"), F.lit("n").alias("name"))
    got = {(r["text_id"], r["begin"]): (r["sentence"], r["sentence_begin"]) for r in filters.with_context(m, t).collect()}
    span = m.join(t, "text_id").select("text_id", "begin", sentence_span(F.col("plain"), F.col("begin")).alias("s"))
    assert got == {(r["text_id"], r["begin"]): (r["s"] and r["s"]["sentence"], r["s"] and r["s"]["start"]) for r in span.collect()}


def test_context_of_a_long_text(spark):
    text = "the cat is here " * 20000
    t = spark.createDataFrame([(1, text)], "text_id int, plain string")
    m = t.select("text_id", F.explode(F.sequence(F.lit(0), F.lit(len(text) - 16), F.lit(16))).alias("begin"), F.lit(0).alias("end"))
    span = filters.with_context(m, t).agg(F.count("sentence_begin"), F.max("sentence_begin"), F.sum((F.length("sentence") == len(text) + 1).cast("int"))).first()
    assert tuple(span) == (20000, 0, 20000)


def test_inline_tags_of_a_long_text(spark):
    text = "é𝒳the cat " * 2000
    t = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "text_id int, plain string")
    m = t.where("text_id = 1").select("text_id", F.explode(F.sequence(F.lit(2), F.lit(len(text) - 8), F.lit(10))).alias("begin")).withColumn("end", F.col("begin") + 2)
    m = m.select("*", *[F.lit(None).cast("string").alias(c) for c in ("gene_id", "symbol", "taxon", "score")], F.lit("x").alias("other_ids"))
    got = dict(sinks.inline_xml(t, m).collect())
    assert got == {1: text.replace("the", '<recognized otherIds="x">the</recognized>'), 2: "none", 3: None}


@pytest.mark.parametrize("name", ["genes_by_text", "stream_matches"])
def test_a_large_row_group_is_read_within_the_heap(spark, tmp_path, name):
    texts = [f"the and {os.urandom(20000).hex()}" for _ in range(1200)]
    rows = pa.table({"doc_id": range(1200), "text": texts, "lang": ["en"] * 1200, "source": ["x"] * 1200})
    pq.write_table(rows, tmp_path / "documents.parquet", compression="none")  # one row group of 48 MB
    jvm = spark._jvm
    kind = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
    direct = lambda: sum(b.getMemoryUsed() for b in jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind) if b.getName() == "direct")
    before = direct()
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 1200
    assert direct() - before < 24_000_000


@pytest.mark.parametrize("name", ["stream_matches", "identify_all", "result_rows", "term_codes"])
def test_long_texts_go_to_python_in_bounded_batches(spark, tmp_path, monkeypatch, name):
    texts = [f"the and mit der {k} {'x' * 20000} the and" for k in range(1200)]
    rows = pa.table({"doc_id": range(1200), "text": texts, "lang": ["en"] * 1200, "source": ["x"] * 1200})
    pq.write_table(rows, tmp_path / "documents.parquet")  # 24 MB, fewer rows than Spark puts into a batch
    made = match.gram_batches

    def bounded(batches, *args):
        for batch in batches:
            assert batch.nbytes < 8_000_000, "a batch of texts is too large"
            yield from made([batch], *args)

    monkeypatch.setattr(match, "gram_batches", bounded)
    expected = {"stream_matches": 3 * 1200, "identify_all": 3 * 1200, "result_rows": 3 * 1200, "term_codes": 1200}
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == expected[name]


BOUNDS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@pytest.mark.parametrize("name", ["identify_all", "result_rows", "term_codes"])
def test_texts_are_unpacked_a_few_at_a_time(spark, tmp_path, name):
    rows = pa.table({"doc_id": range(3000), "text": ["the and mit der"] * 3000, "lang": ["en"] * 3000, "source": ["x"] * 3000})
    pq.write_table(rows, tmp_path / "documents.parquet")
    run = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution()
    run.toRdd().count()
    batches, todo = [], [run.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        if kind == "ColumnarToRowExec":
            batches.append(node.metrics().apply("numInputBatches").value())
    assert len(batches) == 1 and batches[0] >= 3000 / match.TEXTS_AT_ONCE


def test_a_stream_starts_with_bounded_batches(spark, tmp_path, monkeypatch):
    for key in BOUNDS:
        spark.conf.unset(key)
    rows = pa.table({"doc_id": range(30), "text": ["the and mit der"] * 30, "lang": ["en"] * 30, "source": ["x"] * 30})
    pq.write_table(rows, tmp_path / "documents.parquet")
    seen, matches = [], match.match_names
    monkeypatch.setattr(match, "match_names", lambda batch, *args: seen.append([batch.sparkSession.conf.get(key, None) for key in BOUNDS]) or matches(batch, *args))
    assert queries.QUERIES["stream_matches"](spark, str(tmp_path)).count() == 60
    assert seen == [[str(match.BYTES_AT_ONCE), str(match.TEXTS_AT_ONCE)]]


def test_a_session_keeps_its_own_bounds(spark):
    for key in BOUNDS:
        spark.conf.set(key, "1000")
    try:
        match.bounded_batches(spark.range(1))
        assert [spark.conf.get(key) for key in BOUNDS] == ["1000", "1000"]
    finally:
        for key in BOUNDS:
            spark.conf.unset(key)


def test_ranges_are_read_at_anchors_alone(monkeypatch):
    read, at = ranges.read_phrase, []
    monkeypatch.setattr(ranges, "read_phrase", lambda text, begin: at.append(begin) or read(text, begin))
    assert ranges.expand_ranges("the cat, a dog and a bird sat on 12 mats. " * 50 + "MURF-1, -2 and -3 bind BMP2/4 ") == "the cat, a dog and a bird sat on 12 mats. " * 50 + "MURF-1, MURF-2, and MURF-3 bind BMP2 and BMP4 "
    assert len(at) < 20


def test_ranges_read_what_reading_everywhere_gives():
    rng = random.Random(2)
    pieces = ["MURF", "-1", "1", "2", "10", "-", " ", "  ", ",", ", ", " and ", ", and ", " to ", " - ", "/4", "A", "II", "ii", "x", "SMADs", "FA ", "GalNAc-T1", "-T2", "é", "²", ".", "(", "\n", "KK"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        starts = set(ranges.phrase_starts(text))
        for begin in range(len(text)):
            word = (begin == 0 or text[begin - 1] in " :(/-") and re.match("[A-Za-z0-9-]", text[begin])
            assert begin in starts or not word or begin and text[begin - 1] not in ranges._BEFORE or text[begin] in ranges._BEFORE or ranges.read_phrase(text, begin) is None, (text, begin)


def test_marks_are_in_every_hit():
    hits = {
        "human": "Human humans man patient patients cohorts|H. sap.|Homo sapiens|h. sapiens|HTB-134 HT-29|293 cell|HEK293 HEK-293 293T T47D T-47D Ramsey|breast cancer|mammalian cells|mammals|vertebrate homologs",
        "mouse": "Mouse mouse Mice mice Murine murine|M. mus.|Mus musculus|m. Musculus|C57BL C3H 3T3 NIH-3T3 STO Yac-1 CTLL-2 EGG",
        "rat": "Rat rats|R. nor.|Rattus norvegicus|r.\tNorv.", "rodent": "Rodents rodent", "fly": "fruitfly Fruit-fly|flies Fly D. d.|D. melanogaster|Drosophila Drosophilae",
        "yeast": "Yeast yeast|baker's yeast|Saccharomyces cerevisiae S288c|S. cer.|s.Cer.|S.cerevisiae|ferment ferments",
    }
    for kind, words in hits.items():
        for line in [x for part in words.split("|") for x in (part, *part.split())]:
            hit = re.search(rf"(?<!\w)(?:{species.PATTERNS[kind][1]})(?!\w)", line, re.ASCII)
            assert not hit or any(m in hit[0] if isinstance(m, str) else m[0] in hit[0] and m[1] in hit[0] for m in species.MARKS[kind]), (kind, line)


def test_taxa_are_cleaned_in_the_row(spark):
    rows = [(1, {39107: ["mice"], 10090: ["mouse", "a"]}), (2, {9989: ["rodent"], 10116: ["rat"]}), (3, {3846: ["glycine"]}), (4, {3846: ["glycine", "soy"], 9605: ["x"]}), (5, {}), (6, None)]
    t = spark.createDataFrame(rows, "text_id int, taxon_names map<int, array<string>>")
    shuffled = species.drop_ambiguous(species.normalize_taxa(t.select("text_id", F.explode("taxon_names").alias("taxon", "names"))))
    wanted = {}
    for r in shuffled.collect():
        wanted.setdefault(r["text_id"], {})[r["taxon"]] = r["names"]
    got = {r["text_id"]: r["c"] for r in t.select("text_id", species.clean(F.col("taxon_names")).alias("c")).collect()}
    assert {k: v for k, v in got.items() if v} == wanted and got[3] is got[5] is got[6] is None


def test_full_pipeline_stores_no_text_with_mentions(spark):
    names = spark.createDataFrame([("Trp53", "m1", 10090), ("tumor protein", "m1", 10090), ("tp", "m2", 10090)], "name string, id string, taxon int")
    genes = spark.createDataFrame([("m1", 10090, ["Trp53", "tumor protein"]), ("m2", 10090, ["tp1", "tp"])], "gene_id string, taxon int, names array<string>")
    t = spark.createDataFrame([(1, "In mice Trp53 is bound. Trp53s too (Trp53)."), (2, "no names in mice"), (3, None)], "text_id int, plain string")
    done = pipeline.run(pipeline.State(t, match.merge_dictionary(names), genes), pipeline.FULL)
    assert "plain" not in done.mentions.columns and [r[0] for r in done.read.select("text_id").collect()] == [1] and done.texts.count() == 3
    # with a text beside them the filters do as with the text in them
    m = filters.with_context(filters.unify(match.match_names(t, match.merge_dictionary(names)), t), t)
    for rule, more in ((filters.abbreviations, ()), (filters.unspecific_names, (genes,)), (filters.validate_names, (genes,))):
        bare = rule(m.drop("plain"), *more, texts=t)
        assert sorted(bare.collect()) == sorted(rule(m, *more).select(*bare.columns).collect())

"""Readers, writers, pipelines and streams over small files."""

import gzip

from pyspark.sql import functions as F

from textloom.operators import match
from textloom.plans import pipeline
from textloom.sources import genes, sinks, texts
from textloom.streaming import annotate

RECORD = """<PubmedArticle><MedlineCitation><PMID Version="1">{pmid}</PMID><Article><ArticleTitle>Title {pmid}.</ArticleTitle>
<Abstract><AbstractText>Body of {pmid}.</AbstractText><AbstractText>More.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"""


def test_directory(spark, tmp_path):
    (tmp_path / "123.txt").write_text("A title\n\nThe abstract\nof it.")
    (tmp_path / "7.medline.xml").write_text('<?xml version="1.0"?>\n' + RECORD.format(pmid=7))
    body = "<PubmedArticleSet>\n" + "\n".join(RECORD.format(pmid=k) for k in (8, 9)) + "\n</PubmedArticleSet>"
    (tmp_path / "set.medlines.xml").write_text(body)
    (tmp_path / "medline11n0001.xml.gz").write_bytes(gzip.compress(body.replace(">8<", ">18<").replace(">9<", ">19<").encode()))
    (tmp_path / "other.xml").write_text("<r>\n<p>Two <b>three</b></p>\n</r>")
    got = {r["text_id"]: r for r in texts.directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"123", "7", "8", "9", "18", "19", "other"} and got["other"]["plain"] == "Two three"
    assert got["123"]["plain"] == "A title The abstract of it." and got["123"]["pmid"] == 123 and got["123"]["title"] == "A title"
    assert got["9"]["plain"] == "Title 9. Body of 9. More." and got["9"]["pmid"] == 9


def test_old_sets_and_stripped_xml(spark, tmp_path):
    old = "<MedlineCitationSet>" + RECORD.format(pmid=5).replace("<PubmedArticle>", "").replace("</PubmedArticle>", "") + "</MedlineCitationSet>"
    (tmp_path / "a.medlines.xml").write_text(old)
    assert [r["text_id"] for r in texts.medline_sets(spark, str(tmp_path)).collect()] == ["5"]
    (tmp_path / "b.xml").write_text("<r>\n<t>One</t>\n<p>Two <b>three</b></p>\n</r>")
    assert texts.xml_files_stripped(spark, str(tmp_path / "b.xml")).first()["plain"] == "One Two three"


def test_xml_columns(spark):
    x = "<article><front><article-title>T</article-title><abstract><p>A</p></abstract></front><body><sec><p>B</p><p>C</p></sec></body></article>"
    df = spark.createDataFrame([(1, x)], "id int, xml string")
    r = df.select(texts.article_text(F.col("xml")).alias("a"), texts.xpath_all(F.col("xml"), "//sec/p/text()", "|").alias("p"), texts.abstract_text(F.col("xml")).alias("b")).first()
    assert (r["a"], r["p"], r["b"]) == ("T A B C", "B|C", "A")
    got = genes.xml_values(df, {"title": "//article-title/text()", "none": "//zzz/text()"}).collect()
    assert [tuple(x) for x in got] == [("1", "title", "T")]


def test_gene_tables(spark, tmp_path):
    cells = ["1", "9606", "SYM", "a; b", "1p3", "Sum", "-", "11; 12", "100", "-", "-", "-", "-", "-", "-", "-", "-", "5;6", "k"]
    (tmp_path / "g.tsv").write_text("\t".join(cells) + "\n")
    g = genes.genes_from_tsv(genes.tsv(spark, str(tmp_path / "g.tsv"), list(genes.GENE_TSV)))
    r = g.first()
    assert (r["gene_id"], r["taxon"], r["names"], r["go_codes"], r["rifs"]) == ("1", 9606, ["a", "b"], ["5", "6"], [])
    assert sinks.gene_line(g).first()["line"].split("\t") == cells
    (tmp_path / "pm.tsv").write_text("1,2|3\tGO:1\n2\tGO:2\n")
    codes = {r["pmid"]: r["codes"] for r in genes.pmid_to_codes(genes.tsv(spark, str(tmp_path / "pm.tsv"), ["pmids", "code"])).collect()}
    assert codes == {"1": ["GO:1"], "2": ["GO:1", "GO:2"], "3": ["GO:1"]}
    (tmp_path / "c.csv").write_text("all,GO:0000002,1\nobsolete_x,GO:3,1\nGO:0000001,GO:0000002,1\n")
    assert sorted(tuple(r) for r in genes.closure_from_csv(spark, str(tmp_path / "c.csv")).collect()) == [(0, 2, 1), (1, 2, 1)]
    (tmp_path / "w.txt").write_text("# note\nalpha\n\nBeta\n")
    assert {r[0] for r in genes.word_set(spark, str(tmp_path / "w.txt"), lower=True, capitalised=True).collect()} == {"alpha", "Alpha", "beta", "Beta"}
    (tmp_path / "k.txt").write_text("ID\t1\nGT\tsym\nKW\ta\nKW\tb\nID\t2\nGT\tother\n")
    got = {r["gene_id"]: (r["symbol"], r["keywords"]) for r in genes.keyed_lines(spark, str(tmp_path / "k.txt"), {"GT": "symbol", "KW": "keywords"}).collect()}
    assert got == {"1": (["sym"], ["a", "b"]), "2": (["other"], [])}


def test_attributes_and_lexicon(spark):
    names = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "x"), ("3", "z")], "ID string, name string")
    origin = spark.createDataFrame([("1", 9606), ("2", 10090)], "ID string, taxon int")
    ids = spark.createDataFrame([("1",), ("2",)], "gene_id string")
    g = genes.genes_from_attributes(genes.gather_attributes(genes.attributes({"GR_Names": names, "GR_Origin": origin}, ids)))
    assert {r["gene_id"]: (r["taxon"], r["names"]) for r in g.collect()} == {"1": (9606, ["x", "y"]), "2": (10090, ["x"])}
    lex = genes.lexicon(names.selectExpr("name", "ID as gene_id"), spark.createDataFrame([("z",)], "name string"))
    assert {r["name"]: r["ids"] for r in lex.collect()} == {"x": ["1", "2"], "y": ["1"]}
    assert {r["gene_id"]: r["names"] for r in genes.invert_lexicon(lex).collect()} == {"1": ["x", "y"], "2": ["x"]}
    first = genes.first_wins(spark.createDataFrame([("1", "b", 2), ("1", "a", 1)], "gene_id string, symbol string, n int"), "n").first()
    assert first["symbol"] == "a"
    old = spark.createDataFrame([("1", "9")], "old string, new string")
    assert {r["gene_id"] for r in genes.identifier_mapping(ids, old).collect()} == {"9", "2"}


def test_pattern_files(spark, tmp_path):
    d = genes.name_patterns(spark.createDataFrame([("TNF alpha", ["1"]), ("CD95", ["2"])], "name string, ids array<string>"))
    sinks.write_lines(sinks.pattern_lines(d), str(tmp_path / "p"))
    back = {r["regex"]: r["ids"] for r in genes.pattern_dictionary(spark, str(tmp_path / "p")).collect()}
    assert back == {r["regex"]: r["ids"] for r in d.collect()}
    t = spark.createDataFrame([("1", "Tnf-a and CD 95, xCD95")], "text_id string, plain string")
    assert [(r["begin"], r["end"], r["candidates"]) for r in match.match_patterns(t, d).collect()] == [(0, 4, ["1"]), (10, 14, ["2"])]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "g1", "TNF", 0, 2, 1.0, 9606), ("1", "g2", "TNF", 0, 2, 0.5, 10090), ("1", "g1", "TNF", 9, 11, 0.7, 9606)], "text_id string, gene_id string, name string, begin int, end int, score float, taxon int")
    unique = sinks.unique_rows(sinks.numbered(rows)).collect()
    assert [(r["gene_id"], round(r["score"], 1)) for r in unique] == [("g1", 1.0), ("g2", 0.5)]
    assert [(r["begin"], r["gene_ids"], r["taxa"]) for r in sinks.position_rows(rows).collect()] == [(9, "g1", "9606"), (0, "g1;g2", "9606;10090")]
    assert sinks.position_lists(rows).first()["positions"][0]["gene_ids"] == "g1"
    t = spark.createDataFrame([("1", "TNF binds TNF & x"), ("2", "none")], "text_id string, plain string")
    m = rows.where("gene_id = 'g1'").selectExpr("text_id", "begin", "end", "gene_id", "'g2' AS other_ids", "'TNF' AS symbol", "taxon", "CAST(NULL AS STRING) AS score")
    m = m.withColumn("begin", F.when(F.col("begin") == 9, 10).otherwise(0)).withColumn("end", F.when(F.col("begin") == 10, 12).otherwise(2))
    got = {r["text_id"]: r["annotated"] for r in sinks.inline_xml(t, m).collect()}
    tag = '<gene id="g1" otherIds="g2" symbol="TNF" taxon="9606">TNF</gene>'
    assert got == {"1": f"{tag} binds {tag} & x", "2": "none"}
    r = spark.range(1).select(sinks.title_and_abstract(F.lit("One two. Three. Four")).alias("s")).first()["s"]
    assert (r["title"], r["abstract"]) == ("One two.", "Three. Four")
    x = spark.range(1).select(sinks.write_back(F.lit("<a><ArticleTitle>t</ArticleTitle><AbstractText>b</AbstractText></a>"), F.lit("n$1"), F.lit("c")).alias("x")).first()["x"]
    assert x == "<a><ArticleTitle>n$1</ArticleTitle><AbstractText>c</AbstractText></a>"
    w = sinks.rewrap(spark.createDataFrame([("f", "<r/>")], "file string, record string"), "<set>", "</set>")
    sinks.write_rewrapped(w, str(tmp_path / "w"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "w/file=f")).collect()] == ["<set>", "<r/>", "</set>"]
    sinks.write_tsv(sinks.result_rows(rows), str(tmp_path / "t"))
    assert genes.tsv(spark, str(tmp_path / "t")).count() == 3
    assert {r["kind"] for r in sinks.status_rows(rows.selectExpr("text_id", "begin", "end", "name", "array('g1') AS candidates").distinct(), rows.where("begin = 0")).collect()} == {"R", "I", "U"}


def small_state(spark, *rows, **config):
    names = spark.createDataFrame([("TNF alpha", "h1", 9606), ("TNF alpha", "m1", 10090), ("p53", "h2", 9606)], "name string, id string, taxon int")
    g = spark.createDataFrame([("h1", 9606, ["TNF alpha"]), ("m1", 10090, ["TNF alpha"]), ("h2", 9606, ["p53"])], "gene_id string, taxon int, names array<string>")
    t = spark.createDataFrame([(str(k), x) for k, x in enumerate(rows)], "text_id string, plain string")
    return pipeline.State(t, match.merge_dictionary(names), g, config=pipeline.Config(**config))


def test_pipelines(spark):
    s = small_state(spark, "In human cells TNF alpha binds p53. ", "In mice TNF alpha rose. ", "No names. ")
    simple = pipeline.run(s, pipeline.SIMPLE).identified.collect()
    assert sorted((r["text_id"], r["gene_id"], r["begin"]) for r in simple) == [("0", "h1", 15), ("0", "h2", 31), ("1", "m1", 8)]
    full = pipeline.run(s, pipeline.FULL).identified.collect()
    assert sorted((r["text_id"], r["gene_id"]) for r in full) == [("0", "h1"), ("0", "h2"), ("1", "m1")]
    service = pipeline.annotate(s, ("sner", "gnorm")).identified.collect()
    assert {(r["text_id"], r["gene_id"]) for r in service} == {("0", "h1"), ("0", "h2"), ("1", "m1")}
    assert pipeline.annotate(s, ("sner",)).mentions is None
    limited = pipeline.run(small_state(spark, "In human cells TNF alpha. ", limited_species=(10090,)), pipeline.SIMPLE)
    assert limited.identified.collect() == []


def test_disambiguation(spark):
    s = small_state(spark, "human TNF alpha here. ").with_(mentions=spark.createDataFrame([("0", 6, 14, "TNF alpha", ["h1", "h2"])], "text_id string, begin int, end int, name string, candidates array<string>"))
    scores = lambda pairs: pairs.withColumn("x", F.when(F.col("gene_id") == "h2", 1.0).otherwise(0.2))
    assert [r["gene_id"] for r in pipeline.run(s, [pipeline.disambiguate(scores, ("x",))]).identified.collect()] == ["h2"]


def test_stream(spark, tmp_path):
    s = small_state(spark)
    (tmp_path / "in").mkdir()
    for k in range(2):
        spark.createDataFrame([(k, f"human p53 number {k}. ")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = annotate.text_stream(spark, str(tmp_path / "in"), "doc_id long, text string", "doc_id", "text", 1)
    out = []
    q = annotate.annotate_stream(stream, s.dictionary, s.genes, lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted((r["text_id"], r["gene_id"]) for r in out) == [("0", "h2"), ("1", "h2")]


def test_requests(spark):
    r = spark.range(1).select(annotate.request_fields(F.lit("Text=a%20b&task=x&TASK=gner&a")).alias("f"), annotate.request_blocks(F.lit("<text>a</text><text>b</text>")).alias("b"), annotate.socket_fields(F.lit("a></-/><b\r")).alias("s")).first()
    assert r["f"] == {"text": "a b", "task": "gner", "a": ""} and r["b"] == ["a", "b"] and r["s"] == ["a", "b"]

"""Operators on small tables, and the ordered folds against slow versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import TOKENIZERS
from textloom.operators import evaluate, filters, match, ontology, score, species, tagger


def texts(spark, *rows):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(rows)], "text_id string, plain string")


def mentions(spark, rows):
    return spark.createDataFrame(rows, "text_id string, begin int, end int, name string, candidates array<string>")


def test_matching_against_a_scan(spark):
    rng = random.Random(3)
    pieces = ["of the", "the", "of", "x", "TNF-a", "(p53)", "the.", "é", "\n", ":", "of  the"]
    rows = [" ".join(rng.choice(pieces) for _ in range(30)) for _ in range(20)] + ["", None]
    names = [("of the", "A", 1), ("the", "B", 1), ("Of The", "C", 1), ("tnf - a", "D", 2), ("p53", "E", 2)]
    d = match.merge_dictionary(spark.createDataFrame(names, "name string, id string, taxon int"))
    forms = {}
    for n, i, x in names:
        forms.setdefault((" ".join(re.findall(TOKENIZERS["simple"], n.lower())), x), set()).add(i)
    expected = []
    for k, t in enumerate(rows):
        spans = [m.span() for m in re.finditer(TOKENIZERS["simple"], t or "", re.ASCII)]
        for taxon in (1, 2):
            reach = -1
            for s in range(len(spans)):
                best = None
                for n in (1, 2, 3):
                    if s + n > len(spans):
                        continue
                    a, b = spans[s][0], spans[s + n - 1][1]
                    key = " ".join(t[x:y].lower() for x, y in spans[s : s + n])
                    if (key, taxon) in forms and (a == 0 or t[a - 1] in " :(/-") and (b == len(t) or t[b] in " ,.:;)/-+("):
                        best = (a, b - 1, t[a:b], sorted(forms[(key, taxon)]))
                if best and best[0] > reach:
                    reach = best[1]
                    expected.append((str(k), *best, taxon))
    got = [(r["text_id"], r["begin"], r["end"], r["name"], r["candidates"], r["taxon"]) for r in match.match_names(texts(spark, *rows), d).collect()]
    assert sorted(got) == sorted(expected) and got


def unify_slow(ms, text):
    ms = sorted((b, e - b, e, sorted(set(ids))) for b, e, ids in ms)
    out, cur = [], None
    for b, _, e, ids in ms:
        if cur is None:
            cur = [b, e, ids]
        elif (b, e) == (cur[0], cur[1]):
            cur[2] = sorted({*cur[2], *ids})
        elif cur[0] <= b and e <= cur[1]:
            pass
        elif b == cur[0]:
            cur = [b, e, ids]
        elif b <= cur[1]:
            cur = [cur[0], e, sorted({*cur[2], *ids})]
        elif b == cur[1] + 2 and text[cur[1] + 1] == " " and set(cur[2]) & set(ids):
            cur = [cur[0], e, cur[2]]
        else:
            out.append(cur)
            cur = [b, e, ids]
    return [(b, e, text[b : e + 1], ids) for b, e, ids in [*out, cur]]


def test_unify_against_a_loop(spark):
    rng = random.Random(5)
    rows, expected = [], []
    base = "abc def ghi-jkl mno pqr stu vwx yz"
    for k in range(40):
        ms = []
        for _ in range(rng.randint(1, 8)):
            b = rng.randint(0, len(base) - 6)
            ms.append((b, b + rng.randint(0, 5), rng.sample("xyz", rng.randint(1, 2))))
        rows += [(str(k), b, e, base[b : e + 1], ids) for b, e, ids in ms]
        expected += [(str(k), *u) for u in unify_slow(ms, base)]
    got = filters.unify(mentions(spark, rows), texts(spark, *[base] * 40)).collect()
    assert sorted((r["text_id"], r["begin"], r["end"], r["name"], r["candidates"]) for r in got) == sorted(expected)


@pytest.mark.parametrize(
    ("name", "reason"),
    [
        ("DNA binding protein", "unspecific"), ("nerve growth factor", None), ("growth factor receptor", "unspecific"), ("12.5", "unspecific"), ("x", "unspecific"),
        ("nets", "unspecific single word"), ("aim", "unspecific single word"), ("GOLGI", "unspecific single word case-insensitive"), ("Xa", "unspecific abbreviation"),
        ("E. coli", "species"), ("Leucine", "amino acid"), ("Ala", "amino acid"), ("Lewis blood group", "disease name"), ("hepatocytes", "unspecific single word"), ("BRCA1", None), ("kidney", "tissue, cell compartment"),
    ],
)
def test_unspecific_names(spark, name, reason):
    s = f"We show that {name} was high"
    row = spark.createDataFrame([(name, s, s)], "name string, sentence string, plain string")
    assert row.select(filters.unspecific_reason(F.col("name"), F.col("sentence"), F.col("plain"), F.lit(False)).alias("r")).first()["r"] == reason


def test_context_rules(spark):
    rows = [
        ("LPS", "LPS stimulated cells", "pair"), ("Xq", "protein Xq was", "none"), ("BRCA", "in BRCA patients", "pair"), ("CD4", "CD4 T cells", "line"), ("MDA", "MDA-MB-231 line", "line"),
        ("9q", "chromosome 9q", "chromosome"), ("SOX", "the SOX gene family.", "family"), ("SOX", "the SOX gene", "none"),
    ]
    df = spark.createDataFrame(rows, "name string, sentence string, kind string")
    n, s = F.col("name"), F.col("sentence")
    got = df.select("kind", filters.is_negative_pair(n, s).alias("pair"), filters.is_cell_line(n, s).alias("line"), filters.is_chromosome(n, s).alias("chromosome"), filters.is_family(n, s).alias("family")).collect()
    for r in got:
        assert {k for k in ("pair", "line", "chromosome", "family") if r[k]} == ({r["kind"]} - {"none"})


def test_abbreviations_follow_long_forms(spark):
    s = "The tumor necrosis factor (TNF) rose. A human leukocyte thing (HLT) fell. TNF and HLT. The heat shock protein (HSP) too."
    at = lambda w, k=0: [m.start() for m in re.finditer(re.escape(w), s)][k]
    m = lambda w, ids, k=0: ("0", at(w, k), at(w, k) + len(w) - 1, w, ids)
    rows = mentions(spark, [m("tumor necrosis factor", ["T"]), m("TNF", ["a", "b"]), m("TNF", ["a", "b"], 1), m("HLT", ["c"]), m("HLT", ["c"], 1), m("HSP", ["d"])])
    got = filters.abbreviations(filters.with_context(rows, texts(spark, s))).collect()
    assert sorted((r["name"], r["begin"], tuple(r["candidates"])) for r in got) == sorted([("tumor necrosis factor", 4, ("T",)), ("TNF", at("TNF"), ("T",)), ("TNF", at("TNF", 1), ("T",)), ("HSP", at("HSP"), ("d",))])


def test_species(spark):
    t = species.recognize(texts(spark, "Human and murine cells", "yeast two-hybrid", "Rodents; rats rats.", "none"), assumed=(4896,))
    got = {r["text_id"]: (r["taxa"], {k: len(v) for k, v in r["taxon_names"].items()}) for r in t.collect()}
    assert got["0"] == ([4896, 9606, 10090], {9606: 1, 10090: 1})
    assert got["1"] == ([4896, 9606], {}) and got["3"] == ([4896, 9606], {})
    assert got["2"][1] == {10090: 1, 10116: 3}
    assert {(r["taxon"], r["most_frequent"]) for r in species.frequencies(t).where("text_id = '2'").collect()} == {(10116, True), (10090, False)}
    merged = spark.range(1).select(species.merge_names(F.create_map(F.lit(1), F.array(F.lit("a"))), F.create_map(F.lit(1), F.array(F.lit("b")), F.lit(2), F.array(F.lit("c")))).alias("m")).first()["m"]
    assert merged == {1: ["a", "b"], 2: ["c"]}


def test_validate_species_and_names(spark):
    g = spark.createDataFrame([("h", 9606, ["abc1", "other name"]), ("m", 10090, ["abc-1"])], "gene_id string, taxon int, names array<string>")
    t = texts(spark, "A mouse has Abc. ", "In human and mouse Abc is. ", "Abc and other name. ")
    rows = filters.with_context(mentions(spark, [("0", 12, 14, "Abc", ["h", "m"]), ("1", 19, 21, "Abc", ["h", "m"]), ("2", 0, 2, "Abc", ["h", "m"])]), t)
    got = {r["text_id"]: sorted(r["candidates"]) for r in filters.validate_species(rows, g).collect()}
    assert got == {"0": ["m"], "1": ["m"], "2": ["h", "m"]}
    assert {r["text_id"] for r in filters.validate_names(rows, g).collect()} == {"2"}


def test_align_and_rank(spark):
    g = spark.createDataFrame([("1", ["TNF alpha"]), ("2", ["something else entirely"]), ("3", ["TNF-A"])], "gene_id string, names array<string>")
    m = mentions(spark, [("0", 0, 8, "TNF-alpha", ["1", "2", "3"])])
    assert filters.align_candidates(m, g, 0.7).first()["candidates"] == ["1"]
    f = spark.createDataFrame([(1, 9606, "a", 0.5, 1.0), (1, 9606, "b", 1.0, 0.5), (1, 9606, "c", 0.1, 0.1), (1, 10090, "d", 0.2, -1.0)], "mention_id int, taxon int, gene_id string, x double, y double")
    assert {(r["gene_id"], r["score"]) for r in score.rank_candidates(f, ("x", "y"), 0.5).collect()} == {("a", 1.5), ("b", 1.5), ("d", 1.0)}
    top = lambda xs: spark.createDataFrame([(xs,)], "x array<double>").select(score.top3_average(F.col("x")).alias("t")).first()["t"]
    assert top([0.9, 0.6, 0.3, 0.1]) == pytest.approx(0.6) and top([0.9, -1.0, -1.0, -1.0]) == 0.9 and top([0.9, 0.0, 0.0, 0.0]) == -0.9 and top([-1.0]) is None


def test_location_and_mass_scores(spark):
    def loc(locations, t):
        return spark.createDataFrame([(locations, t)], "l array<string>, t string").select(score.location_score(F.col("l"), F.col("t")).alias("s")).first()["s"]

    assert loc(["11q13.2"], "at 11q13.2 it") == 1.0 and loc(["11q13.2"], "chromosome 11 at q13.2") == 0.95 and loc(["11q13.2"], "chromosome 11 at q13 x") == 0.9
    assert loc(["11q13.2"], "at q13.2") == 0.85 and loc(["11q13.2"], "at q13 x") == 0.8 and loc(["11q13.2"], "chromosome 11") == 0.5 and loc(["7"], "chromosome 7") == 0.5
    assert loc(["11q13.2"], "nothing") == 0.0 and loc([], "x") == -1.0
    mass = lambda t: spark.createDataFrame([(["38200"], t)], "m array<string>, t string").select(score.mass_score(F.col("m"), F.col("t")).alias("s")).first()["s"]
    assert mass("38200 Da") == mass("38 kDa") == mass("a 38.2-kDa") == 1.0 and mass("39 kDa") == -1.0


def test_ontology(spark):
    c = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 2), (1, 2, 1), (1, 3, 1), (2, 2, 0)], "parent int, child int, distance int")
    lca = ontology.lowest_common_ancestors(c)
    assert [tuple(r) for r in lca.collect()] == [(2, 3, 1, 1, 1, 1)]
    pairs = spark.createDataFrame([(2, 3), (3, 2), (1, 2), (2, 2), (2, 9)], "goid1 int, goid2 int")
    got = {(r["goid1"], r["goid2"]): r["distance"] for r in ontology.term_distance(pairs, c, lca).collect()}
    assert got == {(2, 3): pytest.approx(2 / 3), (3, 2): pytest.approx(2 / 3), (1, 2): pytest.approx(0.5), (2, 2): 0.0, (2, 9): None}
    row = spark.range(1).select(ontology.code_of(F.lit("GO:0000123")).alias("a"), ontology.accession_of(F.lit(123)).alias("b")).first()
    assert (row["a"], row["b"]) == (123, "GO:0000123")
    d = spark.createDataFrame([(1, 10, 20, 0.4), (1, 10, 21, 0.2), (1, 11, 20, 0.6), (2, 1, 2, None)], "k int, goid1 int, goid2 int, distance double")
    assert {r["k"]: r["similarity"] for r in ontology.set_similarity(d, ["k"]).collect()} == {1: pytest.approx(0.6), 2: None}


def test_evaluation(spark):
    p = spark.createDataFrame([("1", "a", "p53"), ("1", "b", "xx"), ("2", "c", "q")], "text_id string, gene_id string, excerpt string")
    g = spark.createDataFrame([("1", "a", ["p-53"]), ("1", "b", ["qqqq"]), ("3", "d", ["z"])], "text_id string, gene_id string, excerpts array<string>")
    r = evaluate.precision_recall(p, g).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["f"] == pytest.approx(2 / 3)
    r = evaluate.scored_pairs(p, g).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 2)
    folds = evaluate.folds(spark.range(1000), "id", rate=0.5)
    assert 400 < folds.count() < 600 and folds.where("fold = 0").count() > 150
    assert evaluate.precision_recall(p.where("false"), g.where("false")).first()["precision"] == 0


def test_tagger(spark):
    rows = spark.createDataFrame([(1, k, t, "x") for k, t in enumerate("OBIIOWIOIE")], "sent_id int, pos int, tag string, type string")
    assert sorted((r["start"], r["end"]) for r in tagger.tags_to_mentions(rows).collect()) == [(1, 4), (5, 7), (8, 10)]
    tokens = rows.select("sent_id", "pos", F.lit("t").alias("token"))
    m = spark.createDataFrame([(1, 1, 4), (1, 6, 7)], "sent_id int, start int, end int")
    tag = lambda s: "".join(r["tag"] for r in tagger.mentions_to_tags(tokens, m, s).orderBy("pos").collect())
    assert (tag("IO"), tag("IOB"), tag("IOBEW")) == ("OIIIOOIOOO", "OBIIOOBOOO", "OBIEOOWOOO")
    over = spark.createDataFrame([(1, "a", 0, 3), (1, "a", 2, 5), (1, "a", 5, 6), (1, "b", 1, 2)], "sent_id int, type string, start int, end int")
    assert sorted((r["type"], r["start"], r["end"]) for r in tagger.merge_overlapping(over).collect()) == [("a", 0, 5), ("a", 5, 6), ("b", 1, 2)]
    piped = spark.range(1).select(tagger.read_piped(F.lit("a|B b|O")).alias("x")).select(tagger.write_piped(F.col("x")).alias("y"), F.col("x")).first()
    assert piped["y"] == "a|B b|O" and piped["x"][0]["tag"] == "B"
    assert spark.range(1).select(tagger.read_spans(F.lit("S1|3 7|some text")).alias("s")).first()["s"].asDict() == {"sent_id": "S1", "start": 3, "end": 7, "text": "some text"}


def test_chain_learns(spark):
    rows = [(k, [[f"W={w}"] for w in s.split()], t.split()) for k, (s, t) in enumerate([("the p53 gene", "O B O"), ("a tnf gene", "O B O"), ("the gene p53", "O O B")] * 4)]
    df = spark.createDataFrame(rows, "sent_id int, features array<array<string>>, tags array<string>")
    model = tagger.train(df)
    for reverse in (False, True):
        got = tagger.decode(df, model if not reverse else tagger.train(df.select("sent_id", F.reverse("features").alias("features"), F.reverse("tags").alias("tags"))), reverse).join(df.withColumnRenamed("tags", "gold"), "sent_id")
        assert got.where("tags <> gold").count() == 0
    both = spark.range(1).select(tagger.union_tags(F.array(F.lit("O"), F.lit("B")), F.array(F.lit("B"), F.lit("O"))).alias("x")).first()["x"]
    assert both == ["B", "B"]


def test_dictionary_tagger(spark):
    s = spark.createDataFrame([(1, "a b c d b c".split())], "sent_id int, tokens array<string>")
    e = spark.createDataFrame([(["b", "c"], "x"), (["c"], "y"), (["d"], "z")], "phrase array<string>, type string")
    assert sorted((r["start"], r["end"], r["type"]) for r in match.token_dictionary_tags(s, e).collect()) == [(1, 3, "x"), (3, 4, "z"), (4, 6, "x")]
    assert match.token_dictionary_tags(s, e, drop_contained=False).count() == 5


def test_tf_idf_and_lists(spark):
    m = mentions(spark, [("0", 0, 1, "x", []), ("0", 3, 4, "x", []), ("1", 0, 1, "x", []), ("1", 2, 3, "y", [])])
    assert sorted((r["text_id"], r["name"]) for r in filters.tf_idf(m, 0.5).collect()) == [("0", "x"), ("0", "x"), ("1", "y")]
    assert filters.tf_idf(m, 0.5, spark.createDataFrame([("x", 10)], "name string, n long")).count() == 1
    black, white = spark.createDataFrame([("0",)], "text_id string"), spark.createDataFrame([("0",), ("1",)], "text_id string")
    assert {r["text_id"] for r in filters.black_and_white(m, black, white).collect()} == {"1"}
    assert filters.run_named(m, ["dummy"]).count() == 4


def test_dictionaries_of_many_lengths(spark):
    names = [" ".join(f"n{k}x{j}" for j in range(k)) for k in range(1, 71)]
    d = match.merge_dictionary(spark.createDataFrame([(n, "A", 1) for n in names], "name string, id string, taxon int"))
    assert {r["name"] for r in match.match_names(texts(spark, *names), d).collect()} == set(names)
    s = spark.createDataFrame([(k, n.split()) for k, n in enumerate(names)], "sent_id long, tokens array<string>")
    e = spark.createDataFrame([(n.split(), "x") for n in names], "phrase array<string>, type string")
    assert {r["sent_id"] for r in match.token_dictionary_tags(s, e).collect()} == set(range(70))


def test_context_is_that_of_the_mention_itself(spark):
    line = "old TNFx and abc TNF binds. The end"
    m = filters.with_context(mentions(spark, [("0", 35, 37, "TNF", ["1"])]), texts(spark, "Zero. " * 3 + line))
    assert m.first()["sentence_begin"] == 18
    got = {(r["position"], r["token"]) for r in filters.position_contexts(m, 2).collect()}
    assert got == {(0, "and"), (0, "abc"), (1, "tnf"), (2, "binds")}
    # the second "Abc" stands behind "human", the first behind "mouse"
    g = spark.createDataFrame([("h", 9606, ["abc"]), ("m", 10090, ["abc"])], "gene_id string, taxon int, names array<string>")
    rows = filters.with_context(mentions(spark, [("0", 6, 8, "Abc", ["h", "m"]), ("0", 20, 22, "Abc", ["h", "m"])]), texts(spark, "mouse Abc and human Abc are. "))
    assert {r["begin"]: r["candidates"] for r in filters.validate_species(rows, g).collect()} == {6: ["m"], 20: ["h"]}


def test_named_filters_get_what_they_declare(spark):
    m = filters.with_context(mentions(spark, [("0", 0, 8, "TNF-alpha", ["1", "2"]), ("0", 10, 12, "the", ["2"])]), texts(spark, "TNF-alpha the end. "))
    g = spark.createDataFrame([("1", 9606, ["TNF alpha"]), ("2", 9606, ["other entirely"])], "gene_id string, taxon int, names array<string>")
    words = spark.createDataFrame([("the",)], "word string")
    got = filters.run_named(m, ["stop_words", "align_candidates", "dummy"], genes=g, words=words, threshold=0.7).collect()
    assert [(r["name"], r["candidates"]) for r in got] == [("TNF-alpha", ["1"])]
    with pytest.raises(ValueError, match="stop_words needs words"):
        filters.run_named(m, ["stop_words"], genes=g)


def test_patterns_in_parts(spark):
    d = spark.createDataFrame([("[Aa]b", ["1"]), ("[Aa]b cd", ["2"]), ("ab(?: cd)?", ["3"]), ("cd", ["4"])], "regex string, ids array<string>")
    t = texts(spark, "ab cd, Ab; cd xab", None, "")
    got = [sorted((r["begin"], r["end"], tuple(r["candidates"])) for r in match.match_patterns(t, d, at_once=k).collect()) for k in (1, 2, 100)]
    assert got[0] == got[1] == got[2] == [(0, 4, ("2", "3")), (7, 8, ("1",)), (11, 12, ("4",))]
    assert match.match_patterns(t, d.where("false")).collect() == []

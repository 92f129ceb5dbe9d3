"""Text functions and Python functions on small cases."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import alignment, measures, text
from textloom.functions.name_patterns import category, finite_strings, is_dropped, name_pattern, name_variations, numeral_pattern
from textloom.functions.porter import porter_stem
from textloom.functions.ranges import enumerate_names, expand_ranges, is_base
from textloom.functions.sentences import rule_sentences, split_sentences


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("phrase", "expected"),
    [
        (" GalNAc-T1 and -T2 ", " GalNAc-T1 and GalNAc-T2 "),
        (" freac-1 to freac-4 ", " freac-1, freac-2, freac-3, and freac-4 "),
        ("that the hHR23A and -B also in", "that the hHR23A and hHR23B also in"),
        (" hMAD-3 and -4 ", " hMAD-3 and hMAD-4 "),
        (" synapsins I and II ", " synapsin I and synapsin II "),
        (" MURF1, 2 and 3 ", " MURF1, MURF2, and MURF3 "),
        (" MURF-1, -2, and -3 ", " MURF-1, MURF-2, and MURF-3 "),
        (" SGK1, SGK2 and SGK3 ", " SGK1, SGK2 and SGK3 "),
        (" 463, 264, and 124 ", " 463, 264, and 124 "),
        (" Vps26, 29, and 35 ", " Vps26, Vps29, and Vps35 "),
        (" SMADs 1, 5, and 8 ", " SMADs 1, SMADs 5, and SMADs 8, or SMAD 1, SMAD 5, and SMAD 8 "),
        (" SMADs 2 and 3 ", " SMAD 2 and SMAD 3 "),
        ("at 3q27-29 ", "at 3q27-29 "),
        (" Biochemistry 37:6033-6040, 1998) ", " Biochemistry 37:6033-6040, 1998) "),
        (" haplotypes rs737865-rs4680-rs165599 in", " haplotypes rs737865-rs4680-rs165599 in"),
        ("BMP2/4 is", "BMP2 and BMP4 is"),
        ("days 1 and 2", "days 1 and 2"),
        (" FA proteins A, C, G and F ", " FA proteins A, FA proteins C, FA proteins G, and FA proteins F, or FA protein A, FA protein C, FA protein G, and FA protein F "),
        ("kind of thing a, b, and c", "kind of thing a, thing b, and thing c"),
        (" GlcNAc6ST-1, -2, and -3 ", " GlcNAc6ST-1, GlcNAc6ST-2, and GlcNAc6ST-3 "),
        (" MURF-I, II and IV ", " MURF-I, II and IV "),
        ("from 27 and then at 3q27-29 and here", "from 27 and then at 3q27-29 and here"),
        ("freac 1-3 and freac-1 to 3", "freac 1, freac 2, and freac 3 and freac-1 to 3"),
        ("X1 and 2. X1 and 2", "X1 and X2. X1 and X2"),
        ("", ""),
        (None, None),
    ],
)
def test_range_expansion(phrase, expected):
    assert expand_ranges(phrase) == expected


def test_enumerations():
    assert enumerate_names("MURF-", ["1", "2", "3"]) == "MURF-1, MURF-2, and MURF-3"
    assert is_base("SMAD", ["1", "2"]) and not is_base("chromosome", ["1", "2"]) and not is_base("SMAD", ["1", "B"])


def test_porter():
    words = "caresses ponies cats agreed plastered motoring hopping falling filing happy relational digitizer decisiveness electrical adjustable homologous roll controll y"
    stems = "caress poni cat agre plaster motor hop fall file happi relat digit decis electr adjust homolog roll control y"
    assert [porter_stem(w) for w in words.split()] == stems.split()


def test_naive_and_rule_sentences(spark):
    assert one(spark, text.naive_sentences(F.col("t")), t="One two. Three!\nFour; five") == ["One two", "Three", "Four", "five"]
    s = "BACKGROUND: We saw (Fig. 1. Left) a cat. Dr. Smith ran, i.e. He ran fast. It works [see ref. 2. Here]. The end."
    got = one(spark, rule_sentences(F.col("t")), t=s)
    assert got[-1] == "The end." and any("Dr. Smith ran, i.e. He ran fast." in x for x in got) and any("(Fig. 1. Left)" in x for x in got)
    assert one(spark, rule_sentences(F.col("t")), t="[Ein Titel.]") == ["[ Ein Titel. ]"]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Good vaccination.8 However, it was.The end.", ["Good vaccination 8.", "However, it was.", "The end."]),
        ("Of type 3 A. Then D. mel flew, cf. vs. Others.", ["Of type 3 A.", "Then D. mel flew, cf. vs. Others."]),
        ('He said "no." But why? "Who knows!" 5 did: Yes; No', ['He said "no."', "But why?", '"Who knows!"', "5 did:", "Yes;", "No"]),
        ("Methods and Results: We did. RESULTS It worked.", ["Methods and Results:", "We did.", "RESULTS", "It worked."]),
        ("One (a. B. (c. D) e. F) two. Three (open. Here", ["One (a. B. (c. D) e. F) two.", "Three (open.", "Here"]),
        ("A [x. Y) z. W] b. C", ["A [x. Y) z. W] b.", "C"]),
        ("[Titel. Zwei.]", ["[ Titel.", "Zwei. ]"]),
        ("", []),
        (None, None),
    ],
)
def test_rule_sentences(line, expected):
    assert split_sentences(line) == expected


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("synuclein, alpha", ["synuclein, alpha", "alpha synuclein"]),
        ("hypothetical protein FLJ1 (human homolog)", ["FLJ1"]),
        ("abc protein, short-chain specific, neutral membrane, 10", ["abc protein, 10"]),
        ("abc, mitochondrial precursor", ["abc"]),
        ("foo kinase, mitochondrial; other", ["foo kinase"]),
        ("nuclear factor NF kappa B", ["nuclear factor NF kappa B", "nuclear factor kappa B", "NF kappa B"]),
        ("foo bar, isozyme B", ["foo bar, isozyme B", "foo bar", "isozyme B of foo bar"]),
        ("CD4 antigen", ["CD4 antigen", "Anti-CD4"]),
        ("12 KDa thing [Mus musculus]", ["12kDa thing"]),
    ],
)
def test_name_variations(name, expected):
    assert name_variations(name) == expected


@pytest.mark.parametrize(("position", "expected"), [(0, "First one."), (12, "Second two."), (25, "Last"), (-1, None), (99, None)])
def test_sentence_around(spark, position, expected):
    assert one(spark, text.sentence_around(F.col("t"), F.lit(position)), t="First one. Second two. Last") == (expected if expected != "Last" else "Last ")


def test_small_text_functions(spark):
    assert one(spark, text.strip_tag_pairs(F.col("t")), t="<s><b>a</b> <i x='1'>b</i></s>") == "a b"
    assert one(spark, text.strip_tag_pairs(F.col("t")), t="<br/>") == ""
    assert one(spark, text.escape_markup(F.col("t")), t="a < b & c &amp; <i>d</i>") == "a &lt; b &amp; c &amp; <i>d</i>"
    assert one(spark, text.escape_name(F.col("t")), t="a+b(c).d") == r"a\+b\(c\).d"
    assert one(spark, text.first_words_to_lower(F.col("t")), t="The cat. A dog. DNA is. I am") == "the cat. a dog. DNA is. i am"
    assert [one(spark, text.singular(F.col("t")), t=w) for w in ("stories", "stresses", "nervous", "axis", "cats", "cat")] == ["story", "stress", "nervous", "axis", "cat", "cat"]
    assert [one(spark, text.singular_form(F.col("t")), t=w) for w in ("boxes", "gas", "bodies", "genes", "virus")] == ["box", "gas", "body", "gene", "virus"]
    assert one(spark, text.pretokenize(F.col("t")), t="A/B Na+/K+ TNF-induced") == "A / B Na+/K+ TNF -induced"
    assert one(spark, text.sorted_words(F.col("t")), t="b a b") == "a b"
    assert one(spark, text.tokens(F.col("t"), "naive"), t="p53-like A1") == ["p", "53", "-", "like", "A", "1"]
    assert one(spark, text.english_tokens(F.col("t"), ("the", "of")), t="The modification of tumor-suppressor genes (E3s).") == ["modification", "tumor", "suppressor", "gene", "E3"]
    assert one(spark, text.filtered_tokens(F.col("t"), ("and",)), t="(TNF) and , p53.") == ["TNF", "p53"]
    assert one(spark, text.surrounding_sentences(F.array(*[F.lit(str(k)) for k in range(20)]), F.lit(2), 5)) == [str(k) for k in range(11)]


def test_offsets(spark):
    t = "ab c  d"
    dense = [one(spark, text.full_to_dense_index(F.col("t"), F.lit(k)), t=t) for k in range(7)]
    assert dense == [0, 1, -1, 2, -1, -1, 3]
    assert [one(spark, text.dense_to_full_index(F.col("t"), F.lit(k)), t=t) for k in range(5)] == [0, 1, 3, 6, -1]


def test_shapes(spark):
    f = text.shape_features(F.lit("Abc12"))
    row = spark.range(1).select(*[c.alias(n) for n, c in f.items()]).first().asDict()
    assert (row["wc"], row["bwc"], row["prefix3"], row["suffix2"]) == ("Aaa00", "Aa0", "Abc", "12")
    assert row["init_caps"] and row["alphanumeric"] and row["numbers_letters"] and not row["alpha"] and row["grams3"] == ["Abc", "bc1", "c12"]


def test_alignment():
    assert alignment.global_score("p53", "p53") == 3
    assert alignment.pair_score("I", "1") == 0.9 and alignment.gap_score("-") == 1 and alignment.gap_score("x") == -1
    assert alignment.match_score("TNF alpha", "alpha TNF") == pytest.approx(1.0)
    assert alignment.match_score("p53", "a very long name") is None
    assert alignment.match_score("p53", "P53") == pytest.approx(2.8 / 3)
    assert alignment.local_score("xxp53", "p53yy") == 3
    assert alignment.gap_limited_score("abc", "abxc", 1) == 2 and alignment.gap_limited_score("abc", "abxc", 0) is None
    assert alignment.greedy_similarity([(1, 2, 0.5), (1, 3, 0.1), (4, 2, 0.3)]) == pytest.approx(0.8)
    assert alignment.greedy_similarity([(1, 2, float("inf"))]) is None


@pytest.mark.parametrize(
    ("short", "before", "expected"),
    [("TNF", "the tumor necrosis factor ", "tumor necrosis factor"), ("HLA", "a human thing ", None), ("E2s", "ubiquitin and enzyme 2 species ", "enzyme 2 species")],
)
def test_long_forms(short, before, expected):
    t = f"{before}({short})"
    assert alignment.best_long_form(short, t, t.index("(")) == expected


@pytest.mark.parametrize(
    ("name", "hits", "misses"),
    [
        ("TNF alpha", ["TNF alpha", "TNF-alpha", "Tnf a", "TNFalpha"], ["TN alpha", "TNF beta"]),
        ("CD95", ["CD95", "CD-95", "cd 95"], ["CD96"]),
        ("CD95R", ["CD95R", "CD95 receptor"], ["CD95X"]),
        ("tumor necrosis factor alpha", ["Tumor necrosis factor alpha", "tumor-necrosis factor A"], ["tumor factor alpha"]),
        ("interleukin 2", ["Interleukin-2", "interleukin II"], ["interleukin 3"]),
        ("KIAA0101", ["Kiaa0101"], ["KIAA0102"]),
        ("lectin binding thing, alpha", ["alpha lectin binding thing", "Lectin-binding thing, a"], ["beta lectin binding thing"]),
    ],
)
def test_name_patterns(name, hits, misses):
    import re

    p = name_pattern(name)
    assert all(re.fullmatch(p, h) for h in hits) and not any(re.fullmatch(p, m) for m in misses)


def test_name_rules():
    assert [category(n) for n in ("EC 1.2.3.4", "TNF", "gene product of x")] == [0, 1, 2]
    assert all(map(is_dropped, ("12", "IV", "1-2", "of 3", "a 1"))) and not is_dropped("p53")
    assert name_variations("Sarcoglycan, alpha (50kD glycoprotein; adhalin)")[0] == "Sarcoglycan, alpha"
    assert numeral_pattern("iii") == "(?:III|iii|3)" and numeral_pattern("x1") is None
    assert finite_strings([["a", "b"], ["1"]]) == ["a1", "b1"]


def test_vector_measures(spark):
    a, b = F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(2.0)), F.create_map(F.lit("y"), F.lit(4.0), F.lit("z"), F.lit(3.0))
    r = spark.range(1).select(measures.sparse_cosine(a, b).alias("c"), measures.sparse_cosine(a, b, clipped=True).alias("k"), measures.comparable(F.lit("TERM"), F.lit("TEXT")).alias("t"), measures.comparable(F.lit("CODE"), F.lit("TEXT")).alias("n"), measures.sigmoid(F.lit(0.0)).alias("s"), measures.log_base(F.lit(8.0), 2).alias("l")).first()
    assert r["c"] == pytest.approx(8 / (5**0.5 * 5)) and r["k"] == pytest.approx(4 / (5**0.5 * 13**0.5))
    assert r["t"] and not r["n"] and r["s"] == 0.5 and r["l"] == pytest.approx(3)
    words = F.create_map(F.lit("a b"), F.lit(1.0)), F.create_map(F.lit("b c"), F.lit(1.0))
    assert spark.range(1).select(measures.best_similarity(*words).alias("x")).first()["x"] == pytest.approx(0.5)

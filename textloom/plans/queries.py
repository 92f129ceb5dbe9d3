"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import measures, text
from textloom.functions.sentences import rule_sentences
from textloom.operators import evaluate, filters, match, ontology, score, species, tagger
from textloom.sources import genes as gene_sources
from textloom.sources import sinks
from textloom.sources import texts as text_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Parquet's vectored reads keep a direct buffer as large as a row group's column for each thread, outside the heap and its limit; without them it is read in pieces of 8 MB.
READING = {"parquet.hadoop.vectored.io.enabled": "false"}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READING).parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({columns})")


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("plain"), "lang", "source")


#: Names of the matching queries: phrases that the corpus holds, as name, id, taxon.
NAMES = """('of the','G1',1),('Of The','G2',1),('the and','G3',1),('is the','G4',1),('de la','G5',2),('de la','G1',2),('that','G6',1),('mit der','G7',3),
('be of the','G8',1),('the','G9',1),('que','G10',2),('la','G11',2),('la','G12',4),('to the','G13',1)"""
TOKEN = "[A-Za-z0-9]+|[^A-Za-z0-9\\s]"
#: Tokens with places, n-grams up to three tokens, bounded matches of the names: shared by several oracles.
MATCHES = f"""
names(name, id, taxon) AS (VALUES {NAMES}),
dict AS (SELECT lower(name) AS k, taxon, list_sort(list(DISTINCT id)) AS ids FROM names GROUP BY 1, 2),
pieces AS (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS toks, string_split_regex(text, '{TOKEN}') AS gaps FROM documents),
toks AS (SELECT doc_id, text, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos, gaps FROM pieces),
placed AS (SELECT doc_id, text, pos, token, sum(length(gaps[pos]) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM toks),
grams AS (
  SELECT doc_id, text, lower(token) AS k, stop - length(token) AS b, stop - 1 AS e FROM placed
  UNION ALL SELECT doc_id, text, lower(token || ' ' || lead(token, 1) OVER w), stop - length(token), lead(stop, 1) OVER w - 1 FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, text, lower(token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w), stop - length(token), lead(stop, 2) OVER w - 1 FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
matches AS (
  SELECT g.doc_id AS text_id, g.b::INT AS b, g.e::INT AS e, substr(g.text, (g.b + 1)::BIGINT, (g.e - g.b + 1)::BIGINT) AS name, d.ids, d.taxon FROM grams g JOIN dict d ON g.k = d.k
  WHERE (g.b = 0 OR contains(' :(/-', substr(g.text, g.b::BIGINT, 1))) AND (g.e + 1 >= length(g.text) OR contains(' ,.:;)/-+(', substr(g.text, (g.e + 2)::BIGINT, 1))))
"""
_IDS = "array_to_string(ids, ';')"


def leftmost(source: str, by: str) -> str:
    """SQL: the leftmost, longest matches of ``source`` that do not overlap, a fold over each group's sorted list."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY b, e DESC) AS k FROM {source}),
folded AS (SELECT {by}, list_reduce(list({{'b': b, 'reach': e, 'kept': [k]}} ORDER BY k), lambda s, x: CASE WHEN x.b > s.reach THEN {{'b': x.b, 'reach': x.reach, 'kept': list_concat(s.kept, x.kept)}} ELSE s END).kept AS ks FROM ordered GROUP BY ALL),
kept AS (SELECT o.* FROM ordered o JOIN (SELECT {by}, unnest(ks) AS k FROM folded) f USING ({by}, k))"""


def found(spark: SparkSession, sf_dir: str, longest: bool = False) -> DataFrame:
    dictionary = match.merge_dictionary(values(spark, NAMES, "name, id, taxon"))
    return match.match_names(doc_texts(spark, sf_dir), dictionary, longest=longest)


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` for a query that reads them several times: else each reading would match the texts anew."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def joined_ids(c: str = "candidates") -> Column:
    return F.array_join(c, ";")


# ---- texts


@query(r"""SELECT doc_id, len(s) AS n_sentences, s[1] AS first_sentence, list_max(list_transform(s, lambda x: length(x))) AS longest FROM
(SELECT doc_id, string_split_regex(regexp_replace(text, '[\r\n]+', ' ', 'g'), '[.!?:;]\s+') AS s FROM documents)""")
def sentence_split_naive(spark, sf_dir):
    s = t(spark, sf_dir, "documents").select("doc_id", text.naive_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query()
def sentence_split_rules(spark, sf_dir):
    s = t(spark, sf_dir, "documents").select("doc_id", rule_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@query()
def sentence_around(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("position"))
    return d.select("doc_id", "position", text.sentence_around(F.col("text"), F.col("position")).alias("sentence"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS n_whitespace, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS n_simple,
len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]')) AS n_naive FROM documents""")
def token_counts(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", *[F.size(text.tokens(F.col("text"), k)).cast("long").alias(f"n_{k}") for k in ("whitespace", "simple", "naive")])


@query(r"""SELECT DISTINCT token, lower(token) AS w, regexp_replace(token, '[0-9]', '0', 'g') AS nc, regexp_replace(token, '[0-9]+', '0', 'g') AS bnc,
replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '[^A-Za-z0-9]', '~', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g'), '~', 'x') AS wc,
replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '[^A-Za-z0-9]+', '~', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '0', 'g'), '~', 'x') AS bwc,
substr(token, 1, 2) AS prefix2, right(token, 3) AS suffix3, regexp_full_match(token, '[A-Za-z]+') AS alpha, regexp_full_match(token, '[A-Z][a-z]+[A-Z][A-Za-z]*') AS mixed_caps,
regexp_full_match(token, '.*[0-9].*') AS has_digit, regexp_full_match(token, '(?i)[IVXDLCM]+') AS roman
FROM (SELECT unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS token FROM part)""")
def word_class_features(spark, sf_dir):
    tokens = t(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("token")).distinct()
    f = text.shape_features(F.col("token"))
    return tokens.select("token", *[f[n].alias(n) for n in ("w", "nc", "bnc", "wc", "bwc", "prefix2", "suffix3", "alpha", "mixed_caps", "has_digit", "roman")])


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain_md5, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_chars FROM pages")
def strip_tags(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))
    return p.select("page_id", F.md5(F.col("plain").cast("binary")).alias("plain_md5"), F.length("plain").cast("long").alias("n_chars"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS words FROM part")
def sort_dedupe_words(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.sorted_words(F.col("p_name")).alias("words"))


@query(r"""SELECT DISTINCT w AS word, CASE WHEN NOT ends_with(w, 's') OR ends_with(w, 'is') THEN w WHEN ends_with(w, 'ies') THEN regexp_replace(w, 'ies$', 'y')
WHEN ends_with(w, 'sses') THEN regexp_replace(w, 'sses$', 'ss') WHEN ends_with(w, 'ous') THEN w ELSE regexp_replace(w, 's$', '') END AS singular
FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)""")
def singular_words(spark, sf_dir):
    w = t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.select("word", text.singular(F.col("word")).alias("singular"))


@query()
def english_tokens(spark, sf_dir):
    words = ("the", "of", "and", "to", "in", "is", "that")
    return t(spark, sf_dir, "documents").select("doc_id", text.english_tokens(F.col("text"), words).alias("tokens"))


@query(r"""SELECT doc_id, array_to_string(l[greatest(len(l) - 2, 1):len(l)], ' ') AS left_context, array_to_string(l[1:3], ' ') AS right_context FROM
(SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x NOT IN ('the', 'of', 'and', 'de', 'la')) AS l FROM documents)""")
def context_tokens(spark, sf_dir):
    words = ("the", "of", "and", "de", "la")
    low = text.lower_tokens(F.col("text"))
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.context_tokens(low, 3, words), " ").alias("left_context"), F.array_join(text.context_tokens(low, 3, words, left=False), " ").alias("right_context"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(substr(text, 8, 1), '\s') THEN -1 ELSE length(regexp_replace(substr(text, 1, 8), '\s', '', 'g')) - 1 END::INT AS dense
FROM documents WHERE length(text) >= 8""")
def dense_index(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where(F.length("text") >= 8)
    return d.select("doc_id", text.full_to_dense_index(F.col("text"), F.lit(7)).cast("int").alias("dense"))


@query()
def range_expansion(spark, sf_dir):
    from textloom.functions.ranges import expand_ranges

    @F.pandas_udf(StringType())
    def expand(texts: pd.Series) -> pd.Series:
        return texts.map(expand_ranges)

    return t(spark, sf_dir, "documents").select("doc_id", F.md5(expand("text").cast("binary")).alias("expanded_md5"), expand(F.lit("freac-1 to freac-3 and SMADs 2 and 3")).alias("sample"))


@query()
def porter_stems(spark, sf_dir):
    from textloom.functions.porter import porter_stem

    @F.pandas_udf(StringType())
    def stem(words: pd.Series) -> pd.Series:
        return words.map(porter_stem)

    words = t(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", stem("word").alias("stem"))


# ---- dictionaries and matching


@query(f"WITH {MATCHES} SELECT text_id, b AS begin_at, e AS end_at, name, {_IDS} AS ids, taxon FROM matches")
def dictionary_matches(spark, sf_dir):
    return found(spark, sf_dir).select("text_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), "name", joined_ids().alias("ids"), "taxon")


@query(f"""WITH {MATCHES},
{leftmost("matches", "text_id, taxon")}
SELECT text_id, b AS begin_at, e AS end_at, name, {_IDS} AS ids, taxon FROM kept""")
def dictionary_ner(spark, sf_dir):
    return found(spark, sf_dir, longest=True).select("text_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), "name", joined_ids().alias("ids"), "taxon")


@query("""SELECT lower(p_brand || ' ' || split_part(p_type, ' ', 1)) AS name, string_agg(DISTINCT p_partkey::VARCHAR, ';' ORDER BY p_partkey::VARCHAR) AS ids, count(DISTINCT p_partkey) AS n
FROM part GROUP BY 1""")
def dictionary_ids_merge(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", F.col("p_brand"), F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("name"), F.col("p_partkey").cast("string").alias("gene_id"))
    lex = gene_sources.lexicon(p)
    return lex.select("name", joined_ids("ids").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(f"WITH {MATCHES} SELECT text_id, b AS begin_at, e AS end_at, name, taxon FROM matches WHERE name NOT IN ('The', 'that', 'La')")
def excluded_forms(spark, sf_dir):
    m = match.exclude_forms(found(spark, sf_dir), values(spark, "('The'),('that'),('La')", "name"))
    return m.select("text_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), "name", "taxon")


@query(f"WITH {MATCHES} SELECT text_id, b AS begin_at, e AS end_at, array_to_string(list_transform(ids, lambda x: x[2:]), ';') AS codes FROM matches WHERE taxon IN (2, 3)")
def term_codes(spark, sf_dir):
    m = match.term_codes(found(spark, sf_dir).where("taxon in (2, 3)"))
    return m.select("text_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), joined_ids("codes").alias("codes"))


@query()
def pattern_matches(spark, sf_dir):
    names = values(spark, "('the and', array('N1')),('de la', array('N2')),('thtion95', array('N3'))", "name, ids")
    m = match.match_patterns(doc_texts(spark, sf_dir), gene_sources.name_patterns(names))
    return m.select("text_id", "begin", "end", "name", joined_ids().alias("ids"))


@query("""WITH tt(text_id, taxon) AS (VALUES ('a','1'),('a','2'),('b','3'),('c','2')), d(taxon) AS (VALUES ('1'),('2'),('ALL'),('OTHER')),
own AS (SELECT DISTINCT tt.text_id, tt.taxon FROM tt JOIN d USING (taxon))
SELECT * FROM own UNION ALL SELECT DISTINCT text_id, 'ALL' FROM tt UNION ALL SELECT DISTINCT text_id, 'OTHER' FROM tt WHERE text_id NOT IN (SELECT text_id FROM own)""")
def dictionary_routing(spark, sf_dir):
    return match.route_dictionaries(values(spark, "('a','1'),('a','2'),('b','3'),('c','2')", "text_id, taxon"), values(spark, "('1'),('2'),('ALL'),('OTHER')", "taxon"))


@query()
def token_dictionary_tags(spark, sf_dir):
    s = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), text.tokens(F.lower("text")).alias("tokens"))
    return match.token_dictionary_tags(s, values(spark, "(array('of','the'),'A'),(array('be','of','the'),'B'),(array('the'),'C')", "phrase, type"))


@query(f"""WITH {MATCHES}, m AS (SELECT DISTINCT text_id, b, e FROM matches)
SELECT text_id, b AS begin_at, e AS end_at FROM m a WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.text_id = a.text_id AND x.b <= a.b AND a.e <= x.e AND (x.b, x.e) <> (a.b, a.e))""")
def contained_spans(spark, sf_dir):
    m = found(spark, sf_dir).select(F.col("text_id").alias("sent_id"), F.col("begin").alias("start"), "end").distinct()
    return match.drop_contained_spans(m, "sent_id").select(F.col("sent_id").alias("text_id"), F.col("start").alias("begin_at"), F.col("end").alias("end_at"))


@query(f"""WITH {MATCHES}, m AS (SELECT * FROM matches WHERE taxon = 1), g AS (SELECT * FROM matches WHERE taxon <> 1 OR name = 'of the')
SELECT text_id, b AS begin_at, e AS end_at, name FROM m WHERE EXISTS (SELECT 1 FROM g WHERE g.text_id = m.text_id AND m.b <= g.e AND g.b <= m.e)""")
def overlap_semijoin(spark, sf_dir):
    m = kept(found(spark, sf_dir))
    overlapping = filters.overlapping(m.where("taxon = 1"), m.where("taxon <> 1 or name = 'of the'"))
    return overlapping.select("text_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), "name")


@query()
def unified_mentions(spark, sf_dir):
    u = filters.unify(found(spark, sf_dir), doc_texts(spark, sf_dir))
    return u.select("text_id", "begin", "end", "name", joined_ids().alias("ids"))


@query(f"""WITH {MATCHES}, o AS (SELECT DISTINCT text_id, b, e FROM matches), r AS (SELECT *, max(e) OVER (PARTITION BY text_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < b THEN 1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT text_id, min(b)::INT AS begin_at, max(e)::INT AS end_at FROM i GROUP BY text_id, k""")
def merged_spans(spark, sf_dir):
    m = found(spark, sf_dir).select(F.col("text_id").alias("sent_id"), F.lit("x").alias("type"), F.col("begin").alias("start"), (F.col("end") + 1).alias("end")).distinct()
    r = tagger.merge_overlapping(m)
    return r.select(F.col("sent_id").alias("text_id"), F.col("start").cast("int").alias("begin_at"), (F.col("end") - 1).cast("int").alias("end_at"))


# ---- species


_SPECIES_TEXTS = """(1,'Human and murine cells. A patient with mice.'),(2,'No species here'),(3,'Rodents and rats, rats!'),(4,'yeast two-hybrid screen'),(5,'baker s yeast grows
in flies'),(6,'human human mouse')"""


@query(f"""WITH x(text_id, plain) AS (VALUES {_SPECIES_TEXTS}), p(taxon, pat) AS (VALUES (9606, '\\b([Hh]umans?|patients?)\\b'), (10090, '\\b([Mm]ouse|[Mm]ice|[Mm]urine|[Rr]odents?)\\b'), (10116, '\\b([Rr]ats?|[Rr]odents?)\\b'), (7227, '\\b([Ff]lies|[Ff]ly)\\b'), (559292, '\\b([Yy]east)\\b'))
, l AS (SELECT text_id, unnest(string_split(plain, chr(10))) AS line FROM x),
c AS (SELECT text_id, taxon, sum(CASE WHEN taxon = 559292 AND contains(line, 'two-hybrid') THEN 0 ELSE len(regexp_extract_all(line, pat)) END)::INT AS n FROM l, p GROUP BY 1, 2)
SELECT text_id, taxon, n, n = max(n) OVER (PARTITION BY text_id) AS most_frequent FROM c WHERE n > 0""")
def species_counts(spark, sf_dir):
    rows = spark.createDataFrame([(1, "Human and murine cells. A patient with mice."), (2, "No species here"), (3, "Rodents and rats, rats!"), (4, "yeast two-hybrid screen"), (5, "baker s yeast grows\nin flies"), (6, "human human mouse")], "text_id int, plain string")
    return species.frequencies(species.recognize(rows))


@query()
def species_of_documents(spark, sf_dir):
    d = species.recognize(doc_texts(spark, sf_dir))
    return d.select("text_id", F.array_join(F.col("taxa").cast("array<string>"), ";").alias("taxa"))


@query("""WITH x(text_id, taxon, names) AS (VALUES (1, 39107, ['mice']), (1, 10090, ['mouse']), (2, 9989, ['rodents']), (3, 10239, ['virus']), (4, 6754, ['cancer']), (5, 6754, ['cancer', 'crab']), (6, 9606, ['man'])),
m(taxon, normal) AS (VALUES (39107, 10090), (9989, 10090), (9989, 10116), (10239, NULL))
, n AS (SELECT x.text_id, coalesce(m.normal, x.taxon) AS taxon, x.names FROM x LEFT JOIN m USING (taxon) WHERE m.taxon IS NULL OR m.normal IS NOT NULL),
g AS (SELECT text_id, taxon, flatten(list(names ORDER BY names)) AS names FROM n GROUP BY 1, 2)
SELECT text_id, taxon, array_to_string(names, ';') AS names FROM g WHERE NOT (taxon = 6754 AND len(list_filter(names, lambda x: NOT regexp_full_match(x, '[Cc]ancers?'))) = 0)""")
def species_clean_up(spark, sf_dir):
    rows = spark.createDataFrame([(1, 39107, ["mice"]), (1, 10090, ["mouse"]), (2, 9989, ["rodents"]), (3, 10239, ["virus"]), (4, 6754, ["cancer"]), (5, 6754, ["cancer", "crab"]), (6, 9606, ["man"])], "text_id int, taxon int, names array<string>")
    return species.drop_ambiguous(species.normalize_taxa(rows)).select("text_id", "taxon", joined_ids("names").alias("names"))


@query(r"""SELECT min(lang) AS species, token, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(text), '\s+')) AS token FROM documents) GROUP BY token HAVING count(DISTINCT lang) = 1""")
def species_specific_tokens(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select(F.col("lang").alias("species"), F.explode(text.lower_tokens(F.col("text"))).alias("token"))
    return species.specific_tokens(rows)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM c)
SELECT user_id AS text_id, event_type AS taxon FROM m WHERE top / 2.0 <= n""")
def species_frequency_filter(spark, sf_dir):
    c = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("text_id"), F.col("event_type").alias("taxon")).agg(F.count(F.lit(1)).alias("n"))
    return filters.species_frequency(c.select("text_id", "taxon"), c)


# ---- filters


def doc_words(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.posexplode(F.split(F.lower("text"), r"\s+")).alias("begin", "name"))


@query(r"""SELECT text_id, count(*) AS n FROM (SELECT doc_id AS text_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) WHERE w NOT IN ('the', 'of', 'de', 'la', 'der', 'die') GROUP BY 1""")
def stop_word_filter(spark, sf_dir):
    left = filters.stop_words(doc_words(spark, sf_dir), values(spark, "('the'),('of'),('de'),('la'),('der'),('die')", "word"))
    return left.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def black_white_lists(spark, sf_dir):
    lab = t(spark, sf_dir, "labels")
    return filters.black_and_white(t(spark, sf_dir, "documents"), lab.where("toxic = 1").select("doc_id"), lab.select("doc_id"), "doc_id").select("doc_id")


@query("""WITH n AS (SELECT d.doc_id, lower(split_part(d.text, ' ', 1)) AS name, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT name, sum((quality = 0)::INT) AS fp, sum((quality = 1)::INT) AS other FROM n WHERE quality IS NOT NULL GROUP BY 1)
SELECT doc_id, name FROM n WHERE name NOT IN (SELECT name FROM c WHERE fp > other)""")
def strict_false_positives(spark, sf_dir):
    n = t(spark, sf_dir, "documents").select("doc_id", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name"))
    lab = n.join(t(spark, sf_dir, "labels"), "doc_id")
    counts = lab.groupBy("name").agg(F.sum((F.col("quality") == 0).cast("int")).alias("fp"), F.sum((F.col("quality") == 1).cast("int")).alias("other"))
    return filters.strict_false_positives(n, counts).select("doc_id", "name")


@query("""WITH w AS (SELECT d.doc_id, string_split(lower(d.text), ' ') AS s, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT doc_id, quality, 0 AS position, s[1] AS token FROM w UNION ALL SELECT doc_id, quality, 1, s[2] FROM w UNION ALL SELECT doc_id, quality, 2, s[3] FROM w),
x AS (SELECT * FROM c WHERE token IS NOT NULL),
m AS (SELECT CASE WHEN quality = 0 THEN 'fp' ELSE 'tp' END AS label, position, token, count(*) + 1 AS freq FROM x WHERE quality IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT label, position, sum(freq) AS total FROM m GROUP BY 1, 2)
SELECT x.doc_id, round(sum(CASE WHEN t.label = 'fp' THEN ln(coalesce(m.freq, 1) / t.total) ELSE 0 END), 6) AS fp, round(sum(CASE WHEN t.label = 'tp' THEN ln(coalesce(m.freq, 1) / t.total) ELSE 0 END), 6) AS tp
FROM x JOIN t USING (position) LEFT JOIN m ON m.label = t.label AND m.position = x.position AND m.token = x.token GROUP BY 1""")
def left_right_context(spark, sf_dir):
    s = F.split(F.lower("text"), " ")
    each = F.array(*[F.struct(F.lit(k).alias("position"), F.get(s, F.lit(k)).alias("token")) for k in range(3)])
    c = t(spark, sf_dir, "documents").select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*").where("token is not null")
    lab = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "fp").otherwise("tp").alias("label"))
    model = filters.train_positions(c.join(lab, "doc_id"))
    contexts = c.select(F.col("doc_id").alias("text_id"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit("").alias("name"), "position", "token")
    p = filters.position_log_probabilities(contexts, model)
    return p.select(F.col("text_id").alias("doc_id"), F.round("fp", 6).alias("fp"), F.round("tp", 6).alias("tp"))


@query(r"""WITH w AS (SELECT doc_id AS text_id, unnest(string_split_regex(lower(text), '\s+')) AS name FROM documents),
c AS (SELECT text_id, name, count(*) AS tf, sum(count(*)) OVER (PARTITION BY name) AS df FROM w GROUP BY 1, 2) SELECT text_id, name, tf AS n FROM c WHERE tf / df >= 0.5""")
def tf_idf_filter(spark, sf_dir):
    frequent = filters.tf_idf(doc_words(spark, sf_dir), 0.5)
    return frequent.groupBy("text_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query()
def unspecific_names(spark, sf_dir):
    m = filters.with_context(found(spark, sf_dir), doc_texts(spark, sf_dir))
    return filters.unspecific_names(m).select("text_id", "begin", "end", "name")


@query()
def unspecific_reasons(spark, sf_dir):
    names = "DNA binding protein|p53|TNF|kinase|Ala|lung cancer|CD4|human|arthritis|12.5|growth factor receptor|BRCA1|LPS|Xa".split("|")
    rows = spark.createDataFrame([(n, f"We show that {n} was induced. ", f"We show that {n} was induced. ") for n in names], "name string, sentence string, plain string")
    return rows.select("name", filters.unspecific_reason(F.col("name"), F.col("sentence"), F.col("plain"), F.lit(False)).alias("reason"))


@query()
def abbreviations(spark, sf_dir):
    s = "The tumor necrosis factor (TNF) was high. A human leukocyte thing (HLT) was low. TNF and HLT rose."
    at = lambda n, k: [i for i in range(len(s)) if s.startswith(n, i)][k]
    rows = [("1", at(n, k), at(n, k) + len(n) - 1, n, [i], s) for n, k, i in (("TNF", 0, "a"), ("TNF", 1, "a"), ("HLT", 0, "b"), ("HLT", 1, "b"))]
    m = spark.createDataFrame(rows, "text_id string, begin int, end int, name string, candidates array<string>, plain string")
    return filters.abbreviations(m).select("text_id", "begin", "name", joined_ids().alias("ids"))


@query(f"""WITH {MATCHES}, g(id, taxon) AS (VALUES ('G3', 1), ('G6', 1), ('G1', 2), ('G7', 3))
SELECT m.text_id, g.id AS gene_id, m.name, m.b AS begin_at, 1.0::FLOAT AS score, g.taxon FROM matches m JOIN g ON len(m.ids) = 1 AND m.ids[1] = g.id""")
def unambiguous_matches(spark, sf_dir):
    g = values(spark, "('G3', 1), ('G6', 1), ('G1', 2), ('G7', 3)", "gene_id, taxon")
    return filters.unambiguous(found(spark, sf_dir).drop("taxon"), g).select("text_id", "gene_id", "name", F.col("begin").alias("begin_at"), "score", "taxon")


@query(f"""WITH {MATCHES}, g(id, taxon) AS (VALUES ('G3', 1), ('G6', 1), ('G1', 2), ('G7', 3)), u AS (SELECT text_id, name, b, unnest(ids) AS id FROM matches)
SELECT u.text_id, u.id AS gene_id, u.name, u.b AS begin_at, g.taxon FROM u JOIN g USING (id)""")
def identify_all(spark, sf_dir):
    g = values(spark, "('G3', 1), ('G6', 1), ('G1', 2), ('G7', 3)", "gene_id, taxon")
    return filters.identify_all(found(spark, sf_dir).drop("taxon"), g).select("text_id", "gene_id", "name", F.col("begin").alias("begin_at"), "taxon")


@query()
def aligned_candidates(spark, sf_dir):
    m = kept(found(spark, sf_dir))
    g = values(spark, "('G1', array('of the', 'off the')), ('G3', array('the xand')), ('G9', array('thee', 'th'))", "gene_id, names")
    return filters.align_candidates(m, g).select("text_id", "begin", "name", joined_ids().alias("ids"))


# ---- scores


@query("""WITH f AS (SELECT p_partkey AS gene_id, p_brand AS mention_id, p_size AS taxon, p_retailprice AS a, length(p_name)::DOUBLE AS b FROM part),
s AS (SELECT *, round(CASE WHEN a > 0 THEN a / max(a) OVER w ELSE 0 END + CASE WHEN b > 0 THEN b / max(b) OVER w ELSE 0 END, 9) AS score FROM f WINDOW w AS (PARTITION BY mention_id, taxon))
SELECT mention_id, taxon, gene_id, round(score, 6) AS score FROM (SELECT *, rank() OVER (PARTITION BY mention_id, taxon ORDER BY score DESC) AS k FROM s) WHERE k = 1 AND score >= 1.0""")
def rank_with_ties(spark, sf_dir):
    f = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("mention_id"), F.col("p_size").alias("taxon"), F.col("p_retailprice").alias("a"), F.length("p_name").cast("double").alias("b"))
    return score.rank_candidates(f, ("a", "b"), 1.0).select("mention_id", "taxon", "gene_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT vec_id, list_transform(list_reverse_sort(embedding[1:14]), lambda x: x::DOUBLE) AS o FROM embeddings), p AS (SELECT vec_id, o, list_filter(o[1:3], lambda x: x > 0) AS top FROM s)
SELECT vec_id, round(CASE WHEN len(top) = 0 THEN NULL WHEN len(top) = 1 AND (o[4] >= 0 OR o[6] >= 0) THEN -top[1] ELSE list_sum(top) / len(top) END, 6) AS score FROM p""")
def top3_average(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(score.top3_average(F.slice("embedding", 1, 14)), 6).alias("score"))


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_of_neighbours(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("o_id"), F.col("embedding").alias("o"))
    return e.join(o, F.col("vec_id") == F.col("o_id")).select("vec_id", F.round(measures.cosine(F.col("embedding"), F.col("o")), 6).alias("cosine"))


@query("""SELECT a.vec_id % 50 AS owner, round(max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS best
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1""")
def best_over_vectors(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("o_id"), F.col("embedding").alias("o"))
    c = e.join(o, F.col("vec_id") == F.col("o_id")).select((F.col("vec_id") % 50).alias("owner"), measures.cosine(F.col("embedding"), F.col("o")).alias("c"))
    return c.groupBy("owner").agg(F.round(F.max("c"), 6).alias("best"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part),
s AS (SELECT *, len(list_intersect(a, b)) AS k FROM w)
SELECT p_partkey, k::INT AS overlap, round(k / ((len(a) + len(b)) / 2.0), 6) AS normalized, round(k / least(len(a), len(b)), 6) AS min_length, (len(a) + len(b) - 2 * k)::INT AS n_difference FROM s""")
def label_overlaps(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.lower("p_type"), " ").alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("p_partkey", measures.overlap(a, b).alias("overlap"), F.round(measures.normalized_overlap(a, b), 6).alias("normalized"), F.round(measures.min_length_overlap(a, b), 6).alias("min_length"), F.size(measures.symmetric_difference(a, b)).alias("n_difference"))


@query(r"""WITH k AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS n FROM k GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY token) AS c, sum(n) OVER (PARTITION BY doc_id) AS d, sum(n) OVER () AS total FROM tf)
SELECT doc_id, token, n, round((n / d) / (c / total), 6) AS weight FROM w""")
def relative_frequencies(spark, sf_dir):
    k = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    return score.relative_frequencies(k).select("doc_id", "token", "n", F.round("weight", 6).alias("weight"))


@query()
def candidate_features(spark, sf_dir):
    g = spark.createDataFrame([("1", ["775"], ["38200"], ["SH2"], ["R10Q"], ["Kinase", "ATP"], ["11q13.2", "7"], ["99"], ["TNF"], [], [["a", "b"]], [], [["b", "c"]], [], {"a": 1.0})], "gene_id string, lengths array<string>, masses array<string>, domains array<string>, mutations array<string>, keywords array<string>, locations array<string>, pmids array<string>, interactors array<string>, interactions array<string>, diseases array<array<string>>, functions array<array<string>>, rifs array<array<string>>, tissues array<array<string>>, summary map<string,double>")
    x = spark.createDataFrame([("t", "A 775 amino acids, 38.2 kDa SH2 domain on 11q13 binds TNF, a Kinase.", 99, ["a", "b", "d"], {"a": 1.0, "b": 1.0})], "text_id string, plain string, pmid int, labels array<string>, weights map<string,double>")
    return score.score_features(spark.createDataFrame([("t", "1")], "text_id string, gene_id string"), g, x)


# ---- genes, ontology


@query("""WITH a AS (SELECT c_custkey::VARCHAR AS gene_id, 'segment' AS attr, c_mktsegment AS value FROM customer UNION ALL SELECT o_custkey::VARCHAR, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_custkey::VARCHAR, 'status', o_orderstatus FROM orders)
SELECT gene_id, string_agg(DISTINCT value, ';' ORDER BY value) FILTER (attr = 'segment') AS segment, string_agg(DISTINCT value, ';' ORDER BY value) FILTER (attr = 'priority') AS priority, string_agg(DISTINCT value, ';' ORDER BY value) FILTER (attr = 'status') AS status
FROM a WHERE gene_id IN (SELECT c_custkey::VARCHAR FROM customer) GROUP BY 1""")
def gene_attributes(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    tables = {
        "segment": c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("v")),
        "priority": o.select(F.col("o_custkey").alias("ID"), F.col("o_orderpriority").alias("v")),
        "status": o.select(F.col("o_custkey").alias("ID"), F.col("o_orderstatus").alias("v")),
    }
    ids = c.select(F.col("c_custkey").cast("string").alias("gene_id"))
    got = gene_sources.gather_attributes(gene_sources.attributes(tables, ids))
    cell = lambda n: F.array_join(F.try_element_at(F.col("attributes"), F.lit(n)), ";").alias(n)
    return got.select("gene_id", cell("segment"), cell("priority"), cell("status"))


@query("""SELECT DISTINCT p_partkey::VARCHAR AS gene_id, p_size AS taxon, n AS name FROM (SELECT p_partkey, p_size, unnest([p_name] || string_split(p_type, ' ')) AS n FROM part WHERE p_size IN (1, 2, 3)) WHERE n NOT LIKE 'unknown%'""")
def catalogue_names(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    dash = F.lit("-")
    rows = p.select(F.col("p_size").cast("string").alias("_c0"), F.col("p_partkey").cast("string").alias("_c1"), F.col("p_name").alias("_c2"), dash.alias("_c3"), F.replace("p_type", F.lit(" "), F.lit("|")).alias("_c4"), *[dash.alias(f"_c{k}") for k in range(5, 14)])
    return gene_sources.gene_info_names(rows, [1, 2, 3])


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1")
def name_counts(spark, sf_dir):
    return gene_sources.name_counts(t(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("SELECT p_brand AS gene_id, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS names FROM part GROUP BY 1")
def pairs_to_wide(spark, sf_dir):
    w = gene_sources.pairs_to_wide(t(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_type").alias("name")))
    return w.select("gene_id", joined_ids("names").alias("names"))


@query("""WITH p AS (SELECT regexp_replace(regexp_replace(p_type, '["<>&]', '', 'g'), '[@#]+$', '') AS name, p_brand AS id FROM part)
SELECT name, string_agg(DISTINCT id, ';' ORDER BY id) AS ids FROM p WHERE NOT regexp_full_match(name, '[0-9]+') GROUP BY 1""")
def clean_dictionary(spark, sf_dir):
    d = gene_sources.clean_names(t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("id")))
    return d.select("name", joined_ids("ids").alias("ids"))


@query()
def name_patterns(spark, sf_dir):
    d = gene_sources.clean_names(t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("id")))
    return gene_sources.name_patterns(d).select("regex", joined_ids("ids").alias("ids"))


@query()
def xpath_values(spark, sf_dir):
    x = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.format_string("<n><name>%s</name><r>%s</r><r>x</r></n>", "n_name", F.col("n_regionkey").cast("string")).alias("xml"))
    return x.select("id", text_sources.xpath_all(F.col("xml"), "/n/r/text()").alias("regions"), text_sources.xpath_all(F.col("xml"), "/n/name/text()").alias("name"))


def closure_of(spark, sf_dir) -> DataFrame:
    """Root 0, regions 100+, nations 200+, customers' segments are left out: a tree three levels deep."""
    r = t(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("c"))
    n = t(spark, sf_dir, "nation").select((F.col("n_regionkey") + 100).alias("r"), (F.col("n_nationkey") + 200).alias("n"))
    rows = r.select(F.lit(0).alias("parent"), F.col("c").alias("child"), F.lit(1).alias("distance"))
    rows = rows.unionByName(n.select(F.col("r").alias("parent"), F.col("n").alias("child"), F.lit(1).alias("distance")))
    return rows.unionByName(n.select(F.lit(0).alias("parent"), F.col("n").alias("child"), F.lit(2).alias("distance")))


_CLOSURE = """cl AS (SELECT 0 AS parent, r_regionkey + 100 AS child, 1 AS distance FROM region UNION ALL SELECT n_regionkey + 100, n_nationkey + 200, 1 FROM nation UNION ALL SELECT 0, n_nationkey + 200, 2 FROM nation)"""


@query(f"""WITH {_CLOSURE}, p AS (SELECT a.child AS goid1, b.child AS goid2, a.parent AS lcaid, a.distance AS dist1, b.distance AS dist2,
row_number() OVER (PARTITION BY a.child, b.child ORDER BY a.distance + b.distance, a.parent) AS k FROM cl a JOIN cl b ON a.parent = b.parent AND a.child < b.child AND a.parent <> 0)
SELECT goid1, goid2, lcaid, dist1, dist2, (SELECT min(distance) FROM cl WHERE parent = 0 AND child = lcaid) AS depthlca FROM p WHERE k = 1""")
def closure_lca(spark, sf_dir):
    return ontology.lowest_common_ancestors(closure_of(spark, sf_dir))


@query(f"""WITH {_CLOSURE}, n AS (SELECT child FROM cl WHERE parent = 0), q AS (SELECT a.child AS goid1, b.child AS goid2 FROM n a, n b WHERE a.child < b.child),
l AS (SELECT a.child AS g1, b.child AS g2, min(a.distance + b.distance) AS d, 1 AS depth FROM cl a JOIN cl b ON a.parent = b.parent AND a.parent <> 0 AND a.child < b.child GROUP BY 1, 2)
SELECT goid1, goid2, round(coalesce((SELECT c.distance / (1.0 + c.distance) FROM cl c WHERE c.parent = goid1 AND c.child = goid2), (SELECT l.d / (1.0 + l.d) FROM l WHERE g1 = goid1 AND g2 = goid2)), 6) AS distance FROM q""")
def closure_distance(spark, sf_dir):
    c = closure_of(spark, sf_dir)
    codes = c.where("parent = 0").select(F.col("child").alias("goid1"))
    # a few dozen codes: all their pairs are what is asked for
    pairs = codes.join(codes.select(F.col("goid1").alias("goid2")), F.col("goid1") < F.col("goid2"))
    return ontology.term_distance(pairs, c, ontology.lowest_common_ancestors(c)).select("goid1", "goid2", F.round("distance", 6).alias("distance"))


@query()
def code_set_similarity(spark, sf_dir):
    c = closure_of(spark, sf_dir)
    n = t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 200).alias("code"), (F.col("n_nationkey") % 5).alias("owner"))
    pairs = n.where("owner = 0").select(F.col("code").alias("goid1")).join(n.where("owner <> 0").select(F.col("code").alias("goid2"), "owner"), F.col("goid1") != F.col("goid2"))
    d = ontology.term_distance(pairs, c, ontology.lowest_common_ancestors(c))
    return ontology.set_similarity(d, ["owner"]).join(ontology.closest_pair(d, ["owner"]).withColumnRenamed("similarity", "closest"), "owner").select("owner", F.round("similarity", 6).alias("similarity"), F.round("closest", 6).alias("closest"))


@query()
def alignment_scores(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_name").distinct()
    return p.select("p_name", F.round(filters.match_score("p_name", F.upper("p_name")), 6).alias("score"))


# ---- evaluation


@query(r"""WITH x AS (SELECT b.item_id, d.doc_id, regexp_replace(b.text, '[^\x00-\x7F]', '', 'g') AS a, regexp_replace(d.text, '[^\x00-\x7F]', '', 'g') AS c
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, doc_id, round(greatest(0, 1 - 2.0 * levenshtein(a, c) / (length(a) + length(c))), 6) AS similarity FROM x""")
def levenshtein_similarity(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")  # the oracle's distance counts bytes
    b = t(spark, sf_dir, "benchmark").select("item_id", ascii_only.alias("a"))
    d = t(spark, sf_dir, "documents").select("doc_id", ascii_only.alias("b"))
    return b.join(d, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", F.round(measures.span_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_SETS = """p AS (SELECT DISTINCT o_custkey AS text_id, o_orderpriority AS gene_id FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT DISTINCT o_custkey AS text_id, o_orderpriority AS gene_id FROM orders WHERE o_totalprice > 150000)"""


def _sets(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "text_id", "o_orderpriority": "gene_id"})
    return o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 150000")


@query(f"""WITH {_SETS}, c AS (SELECT (SELECT count(*) FROM p JOIN g USING (text_id, gene_id)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
SELECT tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * (tp / np) * (tp / ng) / (tp / np + tp / ng), 6) AS f FROM c""")
def precision_recall(spark, sf_dir):
    r = evaluate.precision_recall(*_sets(spark, sf_dir))
    return r.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(f"WITH {_SETS} SELECT text_id, gene_id FROM p JOIN g USING (text_id, gene_id)")
def true_positives(spark, sf_dir):
    return evaluate.true_positives(*_sets(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS text_id, p_brand AS gene_id, min(p_name) AS excerpt FROM part GROUP BY 1, 2), g AS (SELECT p_partkey AS text_id, p_brand AS gene_id, min(p_name || substr(p_type, 1, p_size)) AS e FROM part WHERE p_size < 30 GROUP BY 1, 2),
j AS (SELECT p.gene_id IS NOT NULL AS ip, g.gene_id IS NOT NULL AS ig, coalesce(greatest(0, 1 - 2.0 * levenshtein(excerpt, e) / (length(excerpt) + length(e))) > 0.55, false) AS ok FROM p FULL JOIN g USING (text_id, gene_id)),
c AS (SELECT sum((ip AND ig AND ok)::INT) AS tp, sum((ip AND NOT (ig AND ok))::INT) AS fp, sum((ig AND NOT (ip AND ok))::INT) AS fn FROM j)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def scored_pairs(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.col("p_brand").alias("gene_id"), F.col("p_name").alias("excerpt"), F.array(F.concat("p_name", F.expr("substr(p_type, 1, p_size)"))).alias("excerpts"), "p_size")
    r = evaluate.scored_pairs(p, p.where("p_size < 30"))
    return r.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH p(s, a, b) AS (VALUES (1, 0, 4), (1, 6, 9), (2, 1, 3)), g(s, a, b) AS (VALUES (1, 0, 4), (2, 0, 3), (3, 5, 6)), x(s, a, b) AS (VALUES (2, 1, 3))
SELECT 2::BIGINT AS tp, 1::BIGINT AS fp, 1::BIGINT AS fn, round(2 / 3.0, 6)::DOUBLE AS precision, round(2 / 3.0, 6)::DOUBLE AS recall""")
def span_precision_recall(spark, sf_dir):
    v = lambda rows: values(spark, rows, "sent_id, start, end")
    r = evaluate.span_precision_recall(v("(1, 0, 4), (1, 6, 9), (2, 1, 3)"), v("(1, 0, 4), (2, 0, 3), (3, 5, 6)"), v("(2, 1, 3)"))
    return r.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS gene_id, p_type AS name FROM part), g AS (SELECT gene_id, count(*) AS n FROM r GROUP BY 1), k AS (SELECT name, count(*) AS n, len(string_split(name, ' ')) AS tokens FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM g) AS n_genes, (SELECT round(avg(n), 6) FROM g) AS names_mean, (SELECT round(var_pop(n), 6) FROM g) AS names_variance, (SELECT max(n) FROM g) AS names_max, (SELECT count(*) FROM k) AS n_names,
(SELECT round(avg(tokens), 6) FROM k) AS tokens_mean, (SELECT round(avg(n), 6) FROM k) AS genes_mean, (SELECT count(DISTINCT gene_id) FROM r JOIN k USING (name) WHERE k.n > 1) AS ambiguous_genes""")
def dictionary_statistics(spark, sf_dir):
    s = evaluate.dictionary_statistics(t(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_type").alias("name")))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("n_genes", r("names_mean"), r("names_variance"), "names_max", "n_names", r("tokens_mean"), r("genes_mean"), "ambiguous_genes")


@query("""WITH x AS (SELECT l_returnflag AS gene_id, l_linestatus = 'F' AS own, l_discount AS distance FROM lineitem),
a AS (SELECT gene_id, avg(distance) FILTER (own) AS m1, avg(distance) FILTER (NOT own) AS m2, var_pop(distance) FILTER (own) AS v1, var_pop(distance) FILTER (NOT own) AS v2, count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n2 FROM x GROUP BY 1)
SELECT gene_id, round(m1, 6) AS own_mean, round(m2, 6) AS other_mean, n1 AS own_n, n2 AS other_n, round(CASE WHEN n1 > 0 AND n2 > 0 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END, 4) AS t FROM a""")
def separation_test(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gene_id"), (F.col("l_linestatus") == "F").alias("own"), F.col("l_discount").alias("distance"))
    s = evaluate.separation(x)
    both = (F.col("own_n") > 0) & (F.col("other_n") > 0)
    return s.select("gene_id", F.round("own_mean", 6).alias("own_mean"), F.round("other_mean", 6).alias("other_mean"), "own_n", "other_n", F.round(F.when(both, F.col("t")), 4).alias("t"))


@query("""WITH a AS (SELECT p_type AS name, round(avg(p_size), 6) AS score FROM part GROUP BY 1) SELECT score, string_agg(name, ';' ORDER BY name) AS names FROM a GROUP BY 1""")
def names_by_average(spark, sf_dir):
    n = evaluate.names_by_average(t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_size").alias("score")))
    return n.select("score", joined_ids("names").alias("names"))


@query("""WITH b AS (SELECT least(floor(l_discount * 10 * 20)::INT, 19) AS bin, l_returnflag = 'A' AS ok FROM lineitem WHERE l_discount <= 0.1), h AS (SELECT bin, sum(ok::INT)::BIGINT AS n_right, sum((NOT ok)::INT)::BIGINT AS n_wrong FROM b GROUP BY 1)
SELECT bin, n_right, n_wrong, (sum(n_right) OVER (ORDER BY bin DESC))::BIGINT AS right_above, (sum(n_wrong) OVER (ORDER BY bin DESC))::BIGINT AS wrong_above FROM h""")
def threshold_curve(spark, sf_dir):
    return evaluate.threshold_curve(t(spark, sf_dir, "lineitem").where("l_discount <= 0.1").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "A").alias("right")))


@query("SELECT round(avg(n), 6) AS average FROM (SELECT count(DISTINCT p_brand) AS n FROM part GROUP BY p_type)")
def ids_per_name(spark, sf_dir):
    return evaluate.ids_per_name(t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("gene_id"))).select(F.round("average", 6).alias("average"))


@query()
def two_folds(spark, sf_dir):
    return evaluate.folds(t(spark, sf_dir, "documents"), "doc_id").select("doc_id", "fold")


# ---- tagger


@query(r"""WITH k AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents), g AS (SELECT *, regexp_matches(w, '^[A-Z]') AS cap FROM k),
s AS (SELECT *, sum((NOT cap)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g) SELECT doc_id AS sent_id, min(pos)::INT AS start_at, (max(pos) + 1)::INT AS end_at FROM s WHERE cap GROUP BY doc_id, island""")
def tags_to_mentions(spark, sf_dir):
    k = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), F.posexplode(F.split("text", " ")).alias("pos", "w"))
    tagged = k.withColumn("tag", F.when(F.col("w").rlike("^[A-Z]"), "I").otherwise("O")).withColumn("type", F.lit("x"))
    m = tagger.tags_to_mentions(tagged)
    return m.select("sent_id", F.col("start").cast("int").alias("start_at"), F.col("end").cast("int").alias("end_at"))


@query(r"""WITH k AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark)
SELECT item_id AS sent_id, pos::INT AS pos, w AS token, lower(w) AS f_w, lag(lower(w), 2) OVER (PARTITION BY item_id ORDER BY pos) AS f_before, lead(lower(w), 2) OVER (PARTITION BY item_id ORDER BY pos) AS f_after FROM k""")
def token_features(spark, sf_dir):
    k = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sent_id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return tagger.token_features(k).select("sent_id", "pos", "token", "f_w", "f_before", "f_after")


@query("""WITH x(id, s) AS (VALUES (1, '( a )'), (2, '( a'), (3, ') ('), (4, 'a b'), (5, '( [ ] )')) SELECT id, id IN (1, 4, 5) AS balanced FROM x""")
def balanced_brackets(spark, sf_dir):
    return values(spark, "(1, '( a )'), (2, '( a'), (3, ') ('), (4, 'a b'), (5, '( [ ] )')", "id, s").select("id", tagger.has_balanced_brackets(F.split("s", " ")).alias("balanced"))


@query(r"""SELECT lower(w) AS token, sum((w <> lower(w))::INT)::BIGINT AS n_b, 0::BIGINT AS n_i, sum((w = lower(w))::INT)::BIGINT AS n_o, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1""")
def boundary_statistics(spark, sf_dir):
    k = t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return evaluate.boundary_statistics(k.select(F.lower("w").alias("token"), F.when(F.col("w") == F.lower("w"), "O").otherwise("B").alias("tag")))


@query()
def chain_decoding(spark, sf_dir):
    s = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sent_id"), F.transform(F.split("text", " "), lambda w: F.array(F.concat(F.lit("W="), F.lower(w)), F.when(w.rlike("^[A-Z]"), "CAP").otherwise("LOW"))).alias("features"))
    model = {"states": ["O", "B", "I"], "weights": {"CAP": [0, 2, 0], "LOW": [1, 0, 0.5]}, "transitions": [[0.5, 0, -9], [0, -1, 0.8], [0.2, 0, 0.1]], "start": [0, 0, -9]}
    return tagger.decode(s, model).select("sent_id", F.array_join("tags", " ").alias("tags"))


@query()
def tag_sentences(spark, sf_dir):
    """All sentences of the documents through the chain: tokens and mentions of each text."""
    s = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.naive_sentences(F.col("text"))).alias("k", "s"))
    words = F.array_remove(F.split("s", r"\s+"), "")
    s = s.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("k").cast("string")).alias("sent_id"), F.transform(words, lambda w: F.array(F.concat(F.lit("W="), F.lower(w)), F.when(w.rlike("^[A-Z]"), "CAP").otherwise("LOW"))).alias("features"))
    model = {"states": ["O", "B", "I"], "weights": {"CAP": [0, 2, 0], "LOW": [1, 0, 0.5]}, "transitions": [[0.5, 0, -9], [0, -1, 0.8], [0.2, 0, 0.1]], "start": [0, 0, -9]}
    tags = tagger.decode(s, model)
    per = tags.select(F.substring_index("sent_id", ":", 1).try_cast("long").alias("doc_id"), F.size("tags").alias("n"), F.size(F.filter("tags", lambda x: x == "B")).alias("b"))
    return per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_tokens"), F.sum("b").alias("n_mentions"))


# ---- results


def identified(spark, sf_dir, mentions: DataFrame | None = None) -> DataFrame:
    g = values(spark, "('G3', 1), ('G6', 1), ('G1', 2), ('G7', 3)", "gene_id, taxon")
    return filters.identify_all((found(spark, sf_dir) if mentions is None else mentions).drop("taxon"), g)


_IDENTIFIED = f"""{MATCHES}, g(id, taxon) AS (VALUES ('G3', 1), ('G6', 1), ('G1', 2), ('G7', 3)), u AS (SELECT text_id, name, b, e, unnest(ids) AS id FROM matches),
ident AS (SELECT u.text_id, u.id AS gene_id, u.name, u.b, u.e, g.taxon FROM u JOIN g USING (id))"""


@query(f"""WITH {_IDENTIFIED}, s AS (SELECT *, row_number() OVER (PARTITION BY text_id, gene_id ORDER BY b, e) AS k FROM ident) SELECT text_id, gene_id, name, taxon FROM s WHERE k = 1""")
def result_list_unique(spark, sf_dir):
    return sinks.unique_rows(sinks.numbered(identified(spark, sf_dir))).select("text_id", "gene_id", "name", "taxon")


@query(f"""WITH {_IDENTIFIED} SELECT text_id, b AS begin_at, string_agg(DISTINCT gene_id, ';' ORDER BY gene_id) AS gene_ids FROM ident GROUP BY 1, 2""")
def result_by_position(spark, sf_dir):
    return sinks.position_rows(identified(spark, sf_dir)).select("text_id", F.col("begin").alias("begin_at"), "gene_ids")


@query(f"""WITH {_IDENTIFIED} SELECT text_id, string_agg(DISTINCT gene_id, ';' ORDER BY gene_id) AS genes FROM ident GROUP BY 1""")
def genes_by_text(spark, sf_dir):
    return sinks.genes_by_text(identified(spark, sf_dir)).select("text_id", joined_ids("genes").alias("genes"))


@query(f"""WITH {MATCHES}, one AS (SELECT DISTINCT text_id, b, e, name FROM matches WHERE taxon = 2),
{leftmost("one", "text_id")},
gap AS (SELECT *, lag(e, 1, -1) OVER (PARTITION BY text_id ORDER BY b) AS before_e FROM kept),
parts AS (SELECT gap.text_id, gap.b, substr(d.text, (before_e + 2)::BIGINT, (b - before_e - 1)::BIGINT) || '<recognized otherIds="x">' || gap.name || '</recognized>' AS p, gap.e, d.text FROM gap JOIN documents d ON d.doc_id = gap.text_id)
SELECT d.doc_id AS text_id, md5(coalesce(any_value(x.p) || substr(d.text, (any_value(x.e) + 2)::BIGINT), d.text)) AS annotated_md5 FROM documents d
LEFT JOIN (SELECT text_id, string_agg(p, '' ORDER BY b) AS p, max(e) AS e FROM parts GROUP BY 1) x ON x.text_id = d.doc_id GROUP BY d.doc_id, d.text""")
def inline_annotation(spark, sf_dir):
    m = found(spark, sf_dir).where("taxon = 2").select("text_id", "begin", "end", *[F.lit(None).cast("string").alias(c) for c in ("gene_id", "symbol", "taxon", "score")], F.lit("x").alias("other_ids")).distinct()
    return sinks.inline_xml(doc_texts(spark, sf_dir), m).select("text_id", F.md5(F.col("annotated").cast("binary")).alias("annotated_md5"))


@query("SELECT c_custkey, concat_ws(chr(9), c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '-'), c_nationkey::VARCHAR) AS line FROM customer")
def service_lines(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return c.select("c_custkey", sinks.service_line(["c_name", "segment", "c_nationkey"]).alias("line"))


@query()
def annotate_documents(spark, sf_dir):
    from textloom.plans.pipeline import FULL, Config, State, run

    dictionary = match.merge_dictionary(values(spark, NAMES, "name, id, taxon"))
    genes = values(spark, "('G1', 1, array('of the')), ('G3', 1, array('the and')), ('G6', 1, array('that')), ('G7', 3, array('mit der'))", "gene_id, taxon, names")
    state = State(doc_texts(spark, sf_dir), dictionary, genes, config=Config(default_species=(1,), assumed_species=(3,)))
    return run(state, FULL).identified


@query()
def stream_matches(spark, sf_dir):
    """The matches of ``dictionary_matches`` from a file stream, written batch by batch."""
    import tempfile
    import uuid

    from textloom.streaming.annotate import match_stream

    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()).rstrip("/")
    out = f"{base}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.options(**READING).schema(t(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    stream = rows.select(F.col("doc_id").alias("text_id"), F.col("text").alias("plain"))
    dictionary = match.merge_dictionary(values(spark, NAMES, "name, id, taxon"))
    match_stream(stream, dictionary, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    return got.select("text_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), "name", joined_ids().alias("ids"), "taxon")


@query()
def event_windows(spark, sf_dir):
    """Counts of events by hour and type. Our own addition; the texts need no windows."""
    return t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


ORACLES["stream_matches"] = f"""WITH {MATCHES},
{leftmost("matches", "text_id, taxon")}
SELECT text_id, b AS begin_at, e AS end_at, name, {_IDS} AS ids, taxon FROM kept"""


# ---- more of the same: formats, look-ups and small rules


@query(f"""WITH {_IDENTIFIED}, i AS (SELECT text_id, b, e, name, min(gene_id) AS gene_id, min(taxon) AS taxon FROM ident GROUP BY 1, 2, 3, 4)
SELECT m.text_id, m.b AS begin_at, m.name, coalesce(i.gene_id, 'N/A') AS gene_id, 'N/A' AS symbol, coalesce(i.taxon::VARCHAR, 'N/A') AS taxon, array_to_string(m.ids, ';') AS candidates
FROM matches m LEFT JOIN i USING (text_id, b, e, name) WHERE m.text_id IN (SELECT text_id FROM ident)""")
def mention_rows(spark, sf_dir):
    all_found = kept(found(spark, sf_dir))
    i = identified(spark, sf_dir, all_found).groupBy("text_id", "begin", "end", "name").agg(F.min("gene_id").alias("gene_id"), F.min("taxon").alias("taxon"))
    m = all_found.drop("taxon").join(i, ["text_id", "begin", "end", "name"], "left").withColumns({"symbol": F.lit(None).cast("string"), "score": F.lit(None).cast("float")})
    return sinks.mention_rows(m, only_with_genes=True).select("text_id", F.col("begin").alias("begin_at"), "name", "gene_id", "symbol", "taxon", "candidates")


@query(f"""WITH {_IDENTIFIED}, r AS (SELECT 'R' AS kind, text_id, b, e, name, array_to_string(ids, ';') AS ids FROM matches UNION ALL SELECT 'I', text_id, b, e, name, gene_id FROM ident
UNION ALL SELECT 'U', text_id, b, e, name, array_to_string(ids, ';') FROM matches m WHERE NOT EXISTS (SELECT 1 FROM ident i WHERE (i.text_id, i.b, i.e, i.name) = (m.text_id, m.b, m.e, m.name)))
SELECT kind, text_id, b AS begin_at, name, ids FROM r""")
def status_dump(spark, sf_dir):
    m = kept(found(spark, sf_dir))
    return sinks.status_rows(m, identified(spark, sf_dir, m)).select("kind", "text_id", F.col("begin").alias("begin_at"), "name", "ids")


@query(f"WITH {_IDENTIFIED} SELECT text_id, gene_id, name, round(1.0, 1)::DOUBLE AS score, b AS begin_at, e AS end_at, taxon FROM ident")
def result_rows(spark, sf_dir):
    return sinks.result_rows(identified(spark, sf_dir)).withColumn("score", F.col("score").cast("double")).withColumnsRenamed({"begin": "begin_at", "end": "end_at"})


@query(f"WITH {_CLOSURE} SELECT child AS code, min(distance) AS depth FROM cl WHERE parent = 0 GROUP BY 1")
def minimal_depth(spark, sf_dir):
    return ontology.minimal_depth(closure_of(spark, sf_dir))


@query(f"WITH {_CLOSURE} SELECT DISTINCT child AS code, parent FROM cl WHERE distance = 1")
def parents_at_distance(spark, sf_dir):
    return ontology.parents_of(closure_of(spark, sf_dir), 1)


@query("SELECT n_nationkey, 'GO:' || lpad(n_nationkey::VARCHAR, 7, '0') AS accession, n_nationkey::INT AS code FROM nation")
def code_forms(spark, sf_dir):
    n = t(spark, sf_dir, "nation").withColumn("accession", ontology.accession_of(F.col("n_nationkey")))
    return n.select("n_nationkey", "accession", ontology.code_of(F.col("accession")).alias("code"))


@query("""WITH p AS (SELECT 'all' AS parent, 'GO:' || lpad(r_regionkey::VARCHAR, 7, '0') AS child, 1 AS distance FROM region UNION ALL SELECT 'obsolete_x', 'GO:0000001', 1)
SELECT 0 AS parent, right(child, 7)::INT AS child, distance FROM p WHERE parent NOT LIKE 'obsolete%'""")
def closure_import(spark, sf_dir):
    r = t(spark, sf_dir, "region").select(F.lit("all").alias("parent"), ontology.accession_of(F.col("r_regionkey")).alias("child"), F.lit(1).alias("distance"))
    return ontology.import_closure(r.unionByName(values(spark, "('obsolete_x', 'GO:0000001', 1)", "parent, child, distance")))


@query(r"""WITH c AS (SELECT unnest(string_split_regex(p_brand || '; ' || p_partkey::VARCHAR || '|' || p_size::VARCHAR, '[;,|\s]+')) AS pmid, p_type AS code FROM part)
SELECT pmid, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM c GROUP BY 1""")
def article_codes(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("; "), F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_size").cast("string")).alias("pmids"), F.col("p_type").alias("code"))
    return gene_sources.pmid_to_codes(rows).select("pmid", joined_ids("codes").alias("codes"))


@query("""WITH l AS (SELECT p_partkey AS k, p_brand AS code FROM part) SELECT s_suppkey AS text_id, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS codes FROM supplier LEFT JOIN l ON k = s_suppkey % 7 GROUP BY 1""")
def codes_of_texts(spark, sf_dir):
    texts = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("text_id"), (F.col("s_suppkey") % 7).alias("pmid"))
    listed = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pmid"), F.col("p_brand").alias("code"))
    return match.codes_by_article(texts, listed).select("text_id", joined_ids("codes").alias("codes"))


@query("""WITH r AS (SELECT DISTINCT lower(p_type) AS name, p_brand AS gene_id FROM part WHERE lower(p_type) <> 'promo')
SELECT gene_id, string_agg(DISTINCT name, ';' ORDER BY name) AS names FROM r GROUP BY 1""")
def lexicon_by_gene(spark, sf_dir):
    pairs = t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("gene_id"))
    lex = gene_sources.lexicon(pairs, values(spark, "('promo'), ('x')", "name"), lower=True)
    return gene_sources.invert_lexicon(lex).select("gene_id", joined_ids("names").alias("names"))


@query("SELECT DISTINCT p_brand AS gene_id FROM part WHERE p_size IN (1, 2)")
def genes_of_species(spark, sf_dir):
    return gene_sources.genes_of(t(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_size").alias("taxon")), [1, 2])


@query("SELECT DISTINCT p_brand AS gene_id, 9606 AS taxon, p_brand AS symbol FROM part")
def dummy_genes(spark, sf_dir):
    return gene_sources.dummy_genes(t(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id")).distinct()).select("gene_id", "taxon", "symbol")


@query("""WITH m AS (SELECT p_brand AS old, min(p_type) AS new FROM part WHERE p_size < 5 GROUP BY 1) SELECT p_partkey, coalesce(m.new, p_brand) AS gene_id FROM part LEFT JOIN m ON m.old = p_brand""")
def identifier_mapping(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    m = p.where("p_size < 5").select(F.col("p_brand").alias("old"), F.col("p_type").alias("new"))
    return gene_sources.identifier_mapping(p.select("p_partkey", F.col("p_brand").alias("gene_id")), m)


@query("SELECT p_brand AS gene_id, arg_min(p_name, p_partkey) AS symbol FROM part GROUP BY 1")
def first_gene_wins(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_name").alias("symbol"), "p_partkey")
    return gene_sources.first_wins(p, "p_partkey").select("gene_id", "symbol")


@query("SELECT source AS text_id, arg_max(md5(text), doc_id) AS plain_md5 FROM documents GROUP BY 1")
def last_text_wins(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("source").alias("text_id"), F.md5(F.col("text").cast("binary")).alias("plain_md5"), "doc_id")
    return text_sources.last_wins(d, "doc_id").select("text_id", "plain_md5")


@query("SELECT doc_id::VARCHAR AS text_id, length(text) AS n_chars FROM documents")
def texts_of_rows(spark, sf_dir):
    return text_sources.from_rows(t(spark, sf_dir, "documents"), "doc_id", "text").select("text_id", F.length("plain").cast("long").alias("n_chars"))


@query("SELECT o_custkey AS text_id, o_orderpriority AS gene_id, arg_min(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2")
def first_confidence(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("text_id"), F.col("o_orderpriority").alias("gene_id"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("seq"))
    return score.first_confidence(o)


@query("SELECT p_type AS name, round(avg(p_retailprice), 4) AS score FROM part GROUP BY 1")
def average_by_name(spark, sf_dir):
    return score.average_by_name(t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_retailprice").alias("score"))).select("name", F.round("score", 4).alias("score"))


@query("""WITH c AS (SELECT p_partkey, p_size AS position, string_split(p_name, ' ')[1] AS token FROM part), m AS (SELECT position, token, count(*) + 1 AS freq FROM c GROUP BY 1, 2), tt AS (SELECT position, sum(freq) AS total FROM m GROUP BY 1)
SELECT p_partkey AS text_id, round(exp(sum(ln(coalesce(freq, 1) / total))), 6) AS joint, round(max(coalesce(freq, 1) / total), 6) AS best FROM c JOIN tt USING (position) LEFT JOIN m USING (position, token) GROUP BY 1""")
def sequence_probabilities(spark, sf_dir):
    c = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit("").alias("name"), F.col("p_size").alias("position"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("token"))
    model = filters.train_positions(c.withColumn("label", F.lit("tp")))
    return filters.sequence_probabilities(c, model, "tp").select("text_id", F.round("joint", 6).alias("joint"), F.round("best", 6).alias("best"))


@query("""WITH v AS (SELECT p_partkey AS pair_id, p_size::DOUBLE AS x, length(p_name)::DOUBLE AS y, length(p_type)::DOUBLE AS z FROM part)
SELECT pair_id, round((2 * (x * z + y * x) / (sqrt(x * x + y * y) * sqrt(z * z + x * x)) + 3 * 1.0) / 5, 6) AS similarity FROM v""")
def model_similarity(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_size").cast("double").alias("x"), F.length("p_name").cast("double").alias("y"), F.length("p_type").cast("double").alias("z"))
    vec = lambda a, b: F.create_map(F.lit("a"), F.col(a), F.lit("b"), F.col(b))
    rows = lambda term, code, w: p.select("pair_id", F.explode(F.array(F.struct(F.lit("TERM").alias("ctx_type"), term.alias("vector"), F.lit(w).alias("weight")), F.struct(F.lit("CODE").alias("ctx_type"), code.alias("vector"), F.lit(1.0).alias("weight")))).alias("v")).select("pair_id", "v.*")
    a = rows(vec("x", "y"), vec("z", "z"), 2.0).withColumn("weight", F.when(F.col("ctx_type") == "CODE", 3.0).otherwise(F.col("weight")))
    return score.model_similarity(a, rows(vec("z", "x"), vec("y", "y"), 1.0)).select("pair_id", F.round("similarity", 6).alias("similarity"))


@query(r"""WITH k AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark)
SELECT item_id AS sent_id, pos::INT AS pos, CASE WHEN pos NOT BETWEEN 2 AND 4 THEN 'O' WHEN pos = 2 THEN 'B' WHEN pos = 4 THEN 'E' ELSE 'I' END AS tag FROM k""")
def mentions_to_tags(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    k = b.select(F.col("item_id").alias("sent_id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return tagger.mentions_to_tags(k, b.select(F.col("item_id").alias("sent_id"), F.lit(2).alias("start"), F.lit(5).alias("end")), "IOBEW").select("sent_id", "pos", "tag")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS token, p_brand AS tag FROM part")
def piped_format(spark, sf_dir):
    line = F.concat_ws("|", F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_brand"))
    p = t(spark, sf_dir, "part").select("p_partkey", F.explode(tagger.read_piped(line)).alias("x"))
    return p.select("p_partkey", "x.token", "x.tag")


@query("""SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS sigmoid, round(tanh(embedding[1]::DOUBLE), 6) AS tanh, round(log2(abs(embedding[1]::DOUBLE) + 1), 6) AS log2, round(log10(abs(embedding[1]::DOUBLE) + 1), 6) AS log10 FROM embeddings""")
def number_functions(spark, sf_dir):
    x = F.get("embedding", F.lit(0)).cast("double")
    fns = {"sigmoid": measures.sigmoid(x), "tanh": F.tanh(x), "log2": measures.log_base(F.abs(x) + 1, 2), "log10": measures.log_base(F.abs(x) + 1, 10)}
    return t(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in fns.items()])


@query(r"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '[\r\n]+', ' ', 'g'), '[.!?:;]\s+') AS s FROM documents)
SELECT doc_id, len(s[greatest(8 - 5, 0) + 1:greatest(8 - 5, 0) + 11])::INT AS n, array_to_string(s[4:14], '|') AS around FROM s WHERE len(s) > 8""")
def surrounding_sentences(spark, sf_dir):
    s = t(spark, sf_dir, "documents").select("doc_id", text.naive_sentences(F.col("text")).alias("s")).where(F.size("s") > 8)
    near = text.surrounding_sentences(F.col("s"), F.lit(8), 5)
    return s.select("doc_id", F.size(near).alias("n"), F.array_join(near, "|").alias("around"))


@query("""SELECT c_custkey, '<customer name="' || replace(c_name, '&', '&amp;') || '" segment="' || c_mktsegment || '"/>' AS line FROM customer""")
def service_xml(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.select("c_custkey", sinks.service_xml(["name", "segment"], "customer").alias("line"))


@query("""SELECT p_partkey::VARCHAR AS gene_id, concat_ws(chr(9), p_partkey::VARCHAR, p_size::VARCHAR, p_brand, array_to_string(string_split(p_name, ' '), '; '), '-', p_type, '-', '-', '-', '-', '-', '-', '-', '-', '-', '-', '-', array_to_string(string_split(p_name, ' '), ';'), '-') AS line FROM part""")
def gene_table_lines(spark, sf_dir):
    none, words = F.array().cast("array<string>"), F.split("p_name", " ")
    g = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_size").alias("taxon"), F.col("p_brand").alias("symbol"), words.alias("names"), F.col("p_type").alias("summary"), words.alias("go_codes"), *[none.alias(c) for c in ("chr_loc", "rifs", "pmids", "mass", "length", "mutation", "domain", "subcell", "tissue", "interact", "function", "disease", "keywords")])
    lines = sinks.gene_line(g)
    return lines.select(F.split_part("line", F.lit("\t"), F.lit(1)).alias("gene_id"), "line")


@query(r"""WITH x AS (SELECT unnest(string_split_regex(p_name || ' | ' || p_type, '\s*[|]\s*')) AS name, p_brand AS id FROM part) SELECT DISTINCT name, id FROM x""")
def generic_names(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" | "), "p_type").alias("name"), F.col("p_brand").alias("id"))
    return gene_sources.generic_names(rows)


@query()
def pattern_lines(spark, sf_dir):
    d = gene_sources.clean_names(t(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("id")))
    return sinks.pattern_lines(gene_sources.name_patterns(d))


@query()
def tag_pairs(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(text.strip_tag_pairs(F.col("html")).cast("binary")).alias("plain_md5"), F.md5(text.escape_markup(F.col("html")).cast("binary")).alias("escaped_md5"))


@query()
def url_fields(spark, sf_dir):
    from textloom.streaming.annotate import request_fields

    p = t(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("QUERY")).alias("q")).where("q is not null")
    return p.select("page_id", F.array_join(F.array_sort(F.map_keys(request_fields(F.col("q")))), ";").alias("keys"))

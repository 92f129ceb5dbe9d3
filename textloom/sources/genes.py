"""Readers of catalogues: genes, their attributes, dictionaries, ontologies."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.operators.ontology import import_closure
from textloom.schema import ATTRIBUTE_TABLES, GENE_TSV


def tsv(spark: SparkSession, path: str, columns: list[str] | None = None, comment: str | None = "#") -> DataFrame:
    """Tab-separated text without header and quotes; all columns are strings."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", False)
    reader = reader.option("comment", comment) if comment else reader
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else reader.csv(path)


def split_list(value: Column, by: str = "; ") -> Column:
    """A list cell as an array; "-" and empty cells are empty lists."""
    return F.when(value.isNull() | value.isin("-", ""), F.array().cast("array<string>")).otherwise(F.array_remove(F.transform(F.split(value, by), lambda x: F.trim(x)), ""))


def genes_from_tsv(rows: DataFrame) -> DataFrame:
    """The 19-column gene table -> gene_id, taxon, symbol, names and the attribute lists."""
    lists = [c for c in GENE_TSV if c not in ("id", "taxon", "symbol", "summary", "go_codes", "keywords")]
    one = lambda c: F.when(F.col(c) != "-", F.col(c))
    return rows.select(
        F.col("id").alias("gene_id"), one("taxon").try_cast("int").alias("taxon"), one("symbol").alias("symbol"), one("summary").alias("summary"),
        *[split_list(F.col(c)).alias(c) for c in lists], *[split_list(F.col(c), ";").alias(c) for c in ("go_codes", "keywords")],
    )


def first_wins(genes: DataFrame, order: str) -> DataFrame:
    """One gene an id: the one loaded first."""
    return genes.groupBy("gene_id").agg(F.min_by(F.struct(*[c for c in genes.columns if c != "gene_id"]), order).alias("g")).select("gene_id", "g.*")


def attributes(tables: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """Attribute tables (ID and a value column each) -> gene_id, attr, value; cut to ``ids`` (gene_id) before anything else."""
    parts = []
    for name, df in tables.items():
        column = ATTRIBUTE_TABLES.get(name) or next(c for c in df.columns if c != "ID")
        rows = df.select(F.col("ID").cast("string").alias("gene_id"), F.lit(name).alias("attr"), F.col(column).cast("string").alias("value"))
        parts.append(rows.join(ids.select(F.col("gene_id").alias("i_id")), F.col("gene_id") == F.col("i_id"), "left_semi") if ids is not None else rows)
    return reduce(DataFrame.unionByName, parts)


def gather_attributes(rows: DataFrame) -> DataFrame:
    """gene_id, attr, value -> gene_id and a map attr -> sorted distinct values: one shuffle for all tables."""
    per = rows.where("value is not null").groupBy("gene_id", "attr").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return per.groupBy("gene_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "values")))).alias("attributes"))


def genes_from_attributes(gathered: DataFrame) -> DataFrame:
    """The genes of an attribute store: names of all name tables, the smallest taxon, symbol and summary."""
    get = lambda n: F.coalesce(F.try_element_at(F.col("attributes"), F.lit(n)), F.array().cast("array<string>"))
    names = F.array_sort(F.array_distinct(F.concat(get("GR_Names"), get("GR_ProteinNames"), get("GR_Symbols"))))
    return gathered.select("gene_id", F.get(get("GR_Origin"), F.lit(0)).try_cast("int").alias("taxon"), F.get(get("GR_Symbols"), F.lit(0)).alias("symbol"), names.alias("names"), F.get(get("GR_Summary"), F.lit(0)).alias("summary"), "attributes")


def jdbc_attributes(spark: SparkSession, url: str, options: dict[str, str], ids: DataFrame | None = None) -> DataFrame:
    """The attribute tables of a database; the driver's jar must be on the class path."""
    return attributes({t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in ATTRIBUTE_TABLES}, ids)


def genes_of(rows: DataFrame, taxa: list[int] | None = None) -> DataFrame:
    """Distinct gene ids, of some species or all."""
    rows = rows.where(F.col("taxon").isin(taxa)) if taxa else rows
    return rows.select("gene_id").distinct()


def dummy_genes(ids: DataFrame) -> DataFrame:
    """For runs without a catalogue: the id as the only name, taxon 9606."""
    return ids.select("gene_id", F.lit(9606).alias("taxon"), F.col("gene_id").alias("symbol"), F.array("gene_id").alias("names"))


def keyed_lines(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """Flat files of "KEY<tab>value" lines, a gene from each ID line on: gene_id and an array for each key.

    ``lineSep`` cuts at ID lines, so genes are read one by one.
    """
    rows = spark.read.option("lineSep", "\nID\t").text(path).select(F.regexp_replace("value", r"^ID\t", "").alias("v"))
    lines = F.split("v", r"\R")
    of = lambda k: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(k + "\t"))), lambda x: F.substr(x, F.lit(len(k) + 2)))
    return rows.where(F.trim("v") != "").select(F.get(lines, F.lit(0)).alias("gene_id"), *[of(k).alias(n) for k, n in keys.items()])


def lexicon(pairs: DataFrame, exclude: DataFrame | None = None, lower: bool = False) -> DataFrame:
    """(name, gene_id) -> name, ids: without excluded names, in lower case where asked."""
    rows = pairs.withColumn("name", F.lower("name")) if lower else pairs
    if exclude is not None:
        x = exclude.select(F.col("name").alias("x_name")).distinct()
        rows = rows.join(x, F.col("name") == F.col("x_name"), "left_anti")
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("gene_id")).alias("ids"))


def invert_lexicon(lex: DataFrame) -> DataFrame:
    return lex.select(F.explode("ids").alias("gene_id"), "name").groupBy("gene_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


#: Names that say nothing: "hypothetical protein" and its like.
VAGUE = r"^(?:-|NEWENTRY|(?:hypothetical|predicted|putative|uncharacterized|unknown|similar to)\b.*|.*\b(?:pseudogene|open reading frame)\b.*|[0-9.]+)$"


def gene_info_names(rows: DataFrame, taxa: list[int] | None = None, drop: str = VAGUE) -> DataFrame:
    """A gene catalogue (columns by number: 0 taxon, 1 id, 2 symbol, 4 synonyms, 8, 10, 11, 13 names) -> gene_id, taxon, name."""
    c = lambda k: F.col(f"_c{k}")
    many = F.flatten(F.array(F.array(c(2)), *[F.split(F.coalesce(c(k), F.lit("-")), r"\|") for k in (4, 13)], *[F.array(c(k)) for k in (8, 10, 11)]))
    out = rows.where(F.col("_c0").isin([str(t) for t in taxa])) if taxa else rows
    out = out.select(c(1).alias("gene_id"), c(0).try_cast("int").alias("taxon"), F.explode(many).alias("name"))
    return out.where(F.col("name").isNotNull() & ~F.col("name").rlike(drop)).distinct()


def name_counts(names: DataFrame) -> DataFrame:
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def wide_to_pairs(rows: DataFrame) -> DataFrame:
    """id, names array -> id, name."""
    return rows.select("gene_id", F.explode("names").alias("name"))


def pairs_to_wide(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def clean_names(pairs: DataFrame) -> DataFrame:
    """(name, id) for a dictionary: quotes, markup and marks at the end off; bare numbers out; ids by name."""
    name = F.trim(F.regexp_replace(F.regexp_replace("name", "[\"<>&]", ""), r"[@#]+$", ""))
    rows = pairs.select(name.alias("name"), "id").where((F.col("name") != "") & ~F.col("name").rlike(r"^[0-9]+$"))
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def generic_names(pairs: DataFrame, drop: str = VAGUE) -> DataFrame:
    """(name, id) with names at slashes and bars taken apart, and vague ones out."""
    return pairs.select(F.explode(F.split("name", r"\s*[|]\s*")).alias("name"), "id").where(~F.col("name").rlike(drop)).distinct()


def pattern_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """<r p1="id;id">pattern</r> entries -> regex, ids."""
    rows = spark.read.option("lineSep", "</r>").text(path)
    ids, body = F.regexp_extract("value", r"(?s)<r [^>]*?p1=\"([^\"]*)\"", 1), F.regexp_extract("value", r"(?s)<r [^>]*>(.*)$", 1)
    plain = F.replace(F.replace(F.replace(body, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return rows.select(plain.alias("regex"), F.split(ids, ";").alias("ids")).where("regex <> ''")


def name_patterns(dictionary: DataFrame) -> DataFrame:
    """(name, ids) -> regex, ids: patterns of the names' variants; ids of equal patterns are united."""
    from textloom.functions.name_patterns import name_pattern

    @F.pandas_udf(StringType())
    def pattern(names: pd.Series) -> pd.Series:
        return names.map(name_pattern)

    rows = dictionary.withColumn("regex", pattern("name")).where("regex is not null")
    return rows.groupBy("regex").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).orderBy("regex")


def pmid_to_codes(rows: DataFrame) -> DataFrame:
    """(pmids, code) with several article numbers in a cell -> pmid, codes."""
    pairs = rows.select(F.explode(F.split("pmids", r"[;,|\s]+")).alias("pmid"), "code").where("pmid <> ''")
    return pairs.groupBy("pmid").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def closure_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return import_closure(spark.read.schema("parent string, child string, distance int").csv(path))


def word_set(spark: SparkSession, path: str, lower: bool = False, capitalised: bool = False) -> DataFrame:
    """word: the lines of a file; empty lines and those that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')")
    rows = rows.select(F.lower("word").alias("word")) if lower else rows
    if capitalised:
        rows = rows.unionByName(rows.select(F.concat(F.upper(F.substring("word", 1, 1)), F.substr("word", F.lit(2))).alias("word")))
    return rows.distinct()


def identifier_mapping(rows: DataFrame, mapping: DataFrame, key: str = "gene_id") -> DataFrame:
    """Ids replaced by those of another catalogue (old, new); ids without one stay."""
    m = mapping.groupBy(F.col("old").alias("m_old")).agg(F.min("new").alias("m_new"))
    return rows.join(m, F.col(key) == F.col("m_old"), "left").select(*[F.coalesce("m_new", key).alias(key) if c == key else F.col(c) for c in rows.columns])


def xml_values(rows: DataFrame, paths: dict[str, str], id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """(id, xml) -> gene_id, attr, value for each match of each path: one pass instead of a statement a path."""
    each = F.array(*[F.struct(F.lit(n).alias("attr"), F.call_function("xpath", F.col(xml_col), F.lit(p)).alias("vs")) for n, p in paths.items()])
    return rows.select(F.col(id_col).cast("string").alias("gene_id"), F.explode(each).alias("e")).select("gene_id", "e.attr", F.explode("e.vs").alias("value")).where("trim(value) <> ''")


def config_taxa(spark: SparkSession, path: str) -> DataFrame:
    """taxon, address of the dictionaries; further columns are comments."""
    return tsv(spark, path).select(F.trim("_c0").alias("taxon"), F.trim("_c1").alias("address")).where("taxon <> ''")

"""Readers of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip_tag_pairs
from textloom.schema import TEXTS

_COLUMNS = [c.strip().split(" ")[0] for c in TEXTS.split(",")]


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _pmid(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(?i)(?:^|pmid[-_]?)([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def _texts(df: DataFrame, **columns: Column) -> DataFrame:
    """The texts schema; columns not given are null."""
    kinds = dict(c.strip().split(" ", 1) for c in TEXTS.split(","))
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS])


def plain_files(spark: SparkSession, path: str) -> DataFrame:
    """One text a file: lines joined by a space, id and PMID from the name, title from the first line."""
    files = spark.read.text(path, wholetext=True).select("value", _file_name().alias("file"))
    lines = F.split(F.trim(F.col("value")), r"\R+")
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    return _texts(files, text_id=name, id_type=F.lit("FILE"), source_type=F.lit("PLAIN"), title=F.get(lines, F.lit(0)), plain=F.array_join(lines, " "), pmid=_pmid(name))


#: File names of citation records and sets of them.
CITATIONS = r"\.medlines?\.xml$|^medline.*n.*\.xml"


def xml_files_stripped(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """Any XML file as one text, tags stripped line by line; files whose name matches ``but`` are left out."""
    files = spark.read.text(path, wholetext=True)
    files = (files.where(~F.col("_metadata.file_name").rlike(but)) if but else files).select("value", _file_name().alias("file"))
    lines = F.filter(F.transform(F.split("value", r"\R+"), lambda x: F.trim(F.regexp_replace(strip_tag_pairs(F.trim(x)), "<[^>]*>", ""))), lambda x: x != "")
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    return _texts(files, text_id=name, id_type=F.lit("FILE"), source_type=F.lit("XML"), title=F.get(lines, F.lit(0)), plain=F.array_join(lines, " "), xml=F.col("value"), pmid=_pmid(name))


def _record_texts(df: DataFrame, xml: Column) -> DataFrame:
    one = lambda path: F.xpath_string(xml, F.lit(path))
    title = F.trim(F.regexp_replace(one("//Article/ArticleTitle"), r"\s+", " "))
    parts = F.call_function("xpath", xml, F.lit("//Abstract/AbstractText/text()"))
    body = F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))
    pmid = one("//MedlineCitation/PMID[1] | /MedlineCitation/PMID[1]")
    whole = F.when(body == "", title).otherwise(F.concat_ws(" ", title, body))
    return _texts(df, text_id=pmid, id_type=F.lit("PMID"), source_type=F.lit("MEDLINE_XML"), title=title, plain=whole, xml=xml, pmid=pmid.try_cast("int"))


def _without_prolog(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)^.*?(?=<(?:PubmedArticle|MedlineCitation)[\s>])", "")


def medline_files(spark: SparkSession, path: str) -> DataFrame:
    """One citation record a file."""
    files = spark.read.text(path, wholetext=True).select(F.trim(_without_prolog(F.col("value"))).alias("x"))
    return _record_texts(files, F.col("x"))


def medline_sets(spark: SparkSession, path: str) -> DataFrame:
    """Sets of citation records, gzipped or not: records begin at PubmedArticle, or MedlineCitation in older sets.

    The text reader cuts at the records' closing tags while it reads, so a large set is split
    over tasks and never held as a whole.
    """
    found = None
    for tag in ("PubmedArticle", "MedlineCitation"):
        rows = spark.read.option("lineSep", f"</{tag}>").text(path)
        record = F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1)
        cut = rows.select(record.alias("r")).where("r <> ''").select(F.concat("r", F.lit(f"</{tag}>")).alias("x"))
        # in article sets the older tag is a part of each record, closed inside it
        cut = cut if tag == "PubmedArticle" else cut.where(~F.contains("x", F.lit("<PubmedArticle")))
        found = cut if found is None else found.unionByName(cut)
    # of records with one id the one whose XML sorts last, so that reruns agree
    return last_wins(_record_texts(found, F.col("x")), "xml")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """All texts of a directory by their suffix: .txt, .medline.xml, .medlines.xml, medlineNNnNNNN.xml[.gz], other .xml."""
    readers = (
        ("*.txt", plain_files),
        ("*.medline.xml", medline_files),
        ("*.medlines.xml", medline_sets),
        ("medline*n*.xml*", medline_sets),
        ("*.xml", lambda spark, path: xml_files_stripped(spark, path, but=CITATIONS)),
    )
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = None
    for glob, reader in readers:
        pattern = jvm(f"{path.rstrip('/')}/{glob}")
        statuses = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        if statuses is None or not len(statuses):
            continue
        rows = reader(spark, f"{path.rstrip('/')}/{glob}")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], TEXTS)


def from_rows(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None) -> DataFrame:
    """Any table with an id and a text."""
    return _texts(df, text_id=F.col(id_col).cast("string"), id_type=F.lit("ROW"), source_type=F.lit("TABLE"), title=F.col(title_col) if title_col else F.lit(None), plain=F.col(text_col))


def last_wins(texts: DataFrame, order: str) -> DataFrame:
    """One text an id: the last one by ``order``."""
    whole = F.max_by(F.struct(*texts.columns), order)
    return texts.groupBy("text_id").agg(whole.alias("t")).select("t.*")


def article_text(xml: Column) -> Column:
    """A full-text article: first title, first abstract, all paragraphs of its sections."""
    many = lambda p: F.call_function("xpath", xml, F.lit(p))
    title, abstract = F.slice(many("//article-title/text()"), 1, 1), many("//abstract[1]//text()")
    return F.trim(F.regexp_replace(F.array_join(F.concat(title, abstract, many("//body//sec//text()")), " "), r"\s+", " "))


def abstract_text(xml: Column) -> Column:
    """The abstract of a record, whichever of the known roots it has."""
    many = lambda p: F.call_function("xpath", xml, F.lit(p))
    return F.trim(F.regexp_replace(F.array_join(many("//AbstractText/text() | //abstract//text() | //Abstract[not(AbstractText)]/text()"), " "), r"\s+", " "))


def record_pmid(xml: Column) -> Column:
    return F.xpath_string(xml, F.lit("//PMID[1] | //article-id[@pub-id-type='pmid']"))


def xpath_all(xml: Column, path: str, delimiter: str = "; ") -> Column:
    """All matches of a path, joined; nothing found is an empty text."""
    return F.array_join(F.call_function("xpath", xml, F.lit(path)), delimiter)


def sentences(texts: DataFrame, splitter) -> DataFrame:
    """text_id, pos, sentence by any splitter of a column."""
    return texts.select("text_id", F.posexplode(splitter(F.col("plain"))).alias("pos", "sentence"))

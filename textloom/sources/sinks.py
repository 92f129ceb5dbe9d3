"""Result tables and their writers. Each ``*_rows`` function shapes rows; ``write_tsv`` and ``write_lines`` store them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("quote", "").option("escapeQuotes", False).option("emptyValue", "").option("nullValue", "").csv(path)


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    rows.select(column).write.text(path)


def result_rows(identified: DataFrame) -> DataFrame:
    """Seven columns, one row for each identification."""
    return identified.select("text_id", "gene_id", "name", "score", "begin", "end", "taxon")


def unique_rows(identified: DataFrame, seq: str = "seq", by_gene: bool = False) -> DataFrame:
    """Five columns, a (text, gene) once as first seen; sorted by text, then as seen or by gene."""
    first = identified.groupBy("text_id", "gene_id").agg(F.min_by(F.struct("name", "score", "taxon"), seq).alias("f"), F.min(seq).alias("__seq"))
    order = ["text_id", "gene_id"] if by_gene else ["text_id", "__seq"]
    return first.orderBy(*order).select("text_id", "gene_id", "f.name", "f.score", "f.taxon")


def position_rows(identified: DataFrame) -> DataFrame:
    """By place, last first: ids and taxa of one begin joined by semicolons. Keyed by text and begin."""
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("gene_id", "taxon"))), lambda s: s[c].cast("string")), ";")
    rows = identified.groupBy("text_id", "begin").agg(F.max("end").alias("end"), F.max_by("name", "end").alias("name"), in_order("gene_id").alias("gene_ids"), in_order("taxon").alias("taxa"))
    return rows.orderBy("text_id", F.desc("begin"))


def position_lists(identified: DataFrame) -> DataFrame:
    """A text's ``position_rows`` as one list a text."""
    rows = position_rows(identified)
    each = F.struct(-F.col("begin"), "end", "name", "gene_ids", "taxa")
    return rows.groupBy("text_id").agg(F.sort_array(F.collect_list(each)).alias("positions"))


def four_columns(identified: DataFrame) -> DataFrame:
    return identified.select("text_id", "gene_id", "name", "score")


def genes_by_text(identified: DataFrame) -> DataFrame:
    return identified.groupBy("text_id").agg(F.sort_array(F.collect_set("gene_id")).alias("genes"))


def _attribute(name: str, value: Column) -> Column:
    safe = F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f' {name}="'), safe, F.lit('"')))


def inline_xml(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """text_id, annotated: mentions wrapped in tags.

    ``mentions``: text_id, begin, end and gene_id (null if only recognized), other_ids, symbol, taxon,
    score. Of mentions that overlap the leftmost, longest one is written.
    """
    from textloom.operators.match import leftmost_longest

    head = F.when(
        F.col("gene_id").isNotNull(),
        F.concat(F.lit("<gene"), _attribute("id", F.col("gene_id")), _attribute("otherIds", F.col("other_ids")), _attribute("symbol", F.col("symbol")), _attribute("taxon", F.col("taxon")), _attribute("score", F.col("score")), F.lit(">")),
    ).otherwise(F.concat(F.lit("<recognized"), _attribute("otherIds", F.col("other_ids")), F.lit(">")))
    tail = F.when(F.col("gene_id").isNotNull(), "</gene>").otherwise("</recognized>")
    apart = leftmost_longest(mentions.select("text_id", "begin", "end", head.alias("head"), tail.alias("tail")), ["text_id"])
    listed = apart.groupBy(F.col("text_id").alias("m_text")).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "head", "tail"))).alias("ms"))
    joined = texts.select("text_id", "plain").join(listed, F.col("text_id") == F.col("m_text"), "left")
    t, m = F.col("plain"), F.col("ms")
    # each mention with the text since the one before it, so that a text is written once and not once a mention
    before = lambda i: F.when(i > 0, F.get(m, i - 1)["end"] + 1).otherwise(0)
    piece = lambda x, i: F.concat(F.substr(t, before(i) + 1, x["begin"] - before(i)), x["head"], F.substr(t, x["begin"] + 1, x["end"] - x["begin"] + 1), x["tail"])
    written = F.concat(F.array_join(F.transform(m, piece), ""), F.substr(t, F.element_at(m, -1)["end"] + 2))
    return joined.select("text_id", F.when(m.isNull(), t).otherwise(written).alias("annotated"))


def title_and_abstract(annotated: Column) -> Column:
    """struct<title, abstract>: the first sentence, and the rest."""
    title = F.regexp_extract(annotated, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    title = F.when(title == "", annotated).otherwise(title)
    return F.struct(title.alias("title"), F.trim(F.substr(annotated, F.length(title) + 1)).alias("abstract"))


def write_back(xml: Column, title: Column, abstract: Column) -> Column:
    """A citation record with its title and abstract replaced."""
    quote = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    with_title = F.call_function("regexp_replace", xml, F.lit(r"(?s)(<ArticleTitle>).*?(</ArticleTitle>)"), F.concat(F.lit("$1"), quote(title), F.lit("$2")))
    return F.call_function("regexp_replace", with_title, F.lit(r"(?s)(<AbstractText>).*?(</AbstractText>)"), F.concat(F.lit("$1"), quote(abstract), F.lit("$2")))


def rewrap(records: DataFrame, header: str, footer: str, by: str = "file") -> DataFrame:
    """(file, record) -> file, line in order: header, records, footer, to be written partitioned by file.

    Rows stay rows, so a file's records are never one value.
    """
    ends = records.select(by).distinct()
    rows = records.select(by, F.lit(1).alias("part"), F.col("record").alias("line"))
    return rows.unionByName(ends.select(by, F.lit(0).alias("part"), F.lit(header).alias("line"))).unionByName(ends.select(by, F.lit(2).alias("part"), F.lit(footer).alias("line"))).orderBy(by, "part", "line")


def write_rewrapped(rows: DataFrame, path: str, by: str = "file") -> None:
    rows.repartition(F.col(by)).sortWithinPartitions(by, "part", "line").select(by, "line").write.partitionBy(by).text(path)


def mention_rows(mentions: DataFrame, only_with_genes: bool = False) -> DataFrame:
    """One row a mention, from the right, N/A for what is missing."""
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    rows = mentions
    if only_with_genes:
        with_genes = mentions.where("gene_id is not null").select(F.col("text_id").alias("g_text")).distinct()
        rows = rows.join(with_genes, F.col("text_id") == F.col("g_text"), "left_semi")
    ids = F.when(F.size("candidates") > 0, F.array_join("candidates", ";")).otherwise("N/A")
    return rows.orderBy("text_id", F.desc("begin")).select("text_id", "begin", "end", "name", na("gene_id").alias("gene_id"), na("symbol").alias("symbol"), na("taxon").alias("taxon"), na("score").alias("score"), ids.alias("candidates"))


def service_line(columns: list[str]) -> Column:
    """A service's TSV line; "-" for what is missing."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def service_xml(columns: list[str], tag: str = "annotation") -> Column:
    return F.concat(F.lit(f"<{tag}"), *[_attribute(c, F.col(c)) for c in columns], F.lit("/>"))


def gene_line(genes: DataFrame) -> DataFrame:
    """The 19-column gene table: lists by "; ", the last two by ";", "-" for what is missing."""
    from textloom.schema import GENE_TSV

    def cell(c: str) -> Column:
        name = "gene_id" if c == "id" else c
        value = F.array_join(F.col(name), ";" if c in ("go_codes", "keywords") else "; ") if genes.schema[name].dataType.typeName() == "array" else F.col(name).cast("string")
        return F.when(value.isNull() | (value == ""), "-").otherwise(value)

    return genes.select(F.concat_ws("\t", *[cell(c) for c in GENE_TSV]).alias("line"))


def pattern_lines(patterns: DataFrame) -> DataFrame:
    """<r p1="ids">pattern</r>, sorted by pattern."""
    safe = F.replace(F.replace(F.replace(F.col("regex"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return patterns.orderBy("regex").select(F.concat(F.lit('<r p1="'), F.array_join("ids", ";"), F.lit('">'), safe, F.lit("</r>")).alias("line"))


def status_rows(mentions: DataFrame, identified: DataFrame) -> DataFrame:
    """All recognized (R), identified (I) and unidentified (U) mentions."""
    keys = ["text_id", "begin", "end", "name"]
    done = identified.select(*keys).distinct()
    r = mentions.select(F.lit("R").alias("kind"), *keys, F.array_join("candidates", ";").alias("ids"))
    i = identified.select(F.lit("I").alias("kind"), *keys, F.col("gene_id").alias("ids"))
    u = mentions.join(done, keys, "left_anti").select(F.lit("U").alias("kind"), *keys, F.array_join("candidates", ";").alias("ids"))
    return r.unionByName(i).unionByName(u)


def numbered(identified: DataFrame) -> DataFrame:
    """Adds seq: the order in which identifications are seen, by text, begin and gene."""
    return identified.withColumn("seq", F.row_number().over(Window.partitionBy("text_id").orderBy("begin", "end", "gene_id")))

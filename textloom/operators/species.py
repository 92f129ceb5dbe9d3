"""Species of a text: recognition by patterns, clean-up, and frequencies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import bind

HUMAN, MOUSE, RAT, FLY, YEAST = 9606, 10090, 10116, 7227, 559292
#: Words that name a species, as patterns of whole words.
PATTERNS: dict[str, tuple[tuple[int, ...], str]] = {
    "human": ((HUMAN,), r"[Hh]umans?|man|patients?|cohorts?|[Hh](?:\.|omo)\ssap(?:\.|iens)|HTB-134|HT-29|293 cells?|HEK[\-\s]?293|293T|T47D|T-47D|Ramsey|breast cancer|mammalian cells?|mammalian|mammals|vertebrate homolog[a-z]*"),
    "mouse": ((MOUSE,), r"[Mm]ouse|[Mm]ice|[Mm]urine|[Mm](?:\.|us)\s[Mm]us(?:\.|culus)?|C57BL|C3H|3T3|NIH-3T3|STO|Yac-1|CTLL-2|EGG"),
    "rat": ((RAT,), r"[Rr]ats?|[Rr](?:\.|attus)\s[Nn]or(?:v?\.|vegicus)?"),
    "rodent": ((MOUSE, RAT), r"[Rr]odents?"),
    "fly": ((FLY,), r"[Ff]ruit[\s\-]?[Ff]ly|[Ff]lies|[Ff]ly|[Dd](?:\.|rosophila)\s[Mm]el(?:\.|anogaster)|[Dd](?:\.|rosophilae?)"),
    "yeast": ((YEAST,), r"[Yy]east|baker's yeast|Saccharomyces cerevisiae(?: S288c)?|[Ss]\.\s?[Cc]er(?:\.|evisiae)?|ferments?"),
}
#: What a line needs to hold for a hit of the pattern: one of these, all parts of one that is written as several. A plain look-up spares most lines the pattern.
MARKS: dict[str, tuple[str | tuple[str, str], ...]] = {
    "human": ("man", "patient", "cohort", "sap", "HTB-134", "HT-29", "293", "47D", "Ramsey", "breast cancer", "mammal", "vertebrate homolog"),
    "mouse": ("mouse", "Mouse", "mice", "Mice", "murine", "Murine", "mus", "Mus", "C57BL", "C3H", "3T3", "STO", "Yac-1", "CTLL-2", "EGG"),
    "rat": ("rat", "Rat", ("R.", "nor"), ("R.", "Nor"), ("r.", "nor"), ("r.", "Nor")),
    "rodent": ("rodent", "Rodent"),
    "fly": ("fly", "Fly", "flies", "Flies", "rosophila", "D.", "d."),
    "yeast": ("yeast", "Yeast", "cerevisiae", ("S.", "cer"), ("S.", "Cer"), ("s.", "cer"), ("s.", "Cer"), "ferment"),
}
#: A line with one of these speaks of a method or a comparison, not of yeast.
NO_YEAST = r"(?:two|2|to|1|one|3|three)[\s\-]?hybrid|Y2H|YS2H|yeast homolog"
#: Taxa that stand for others; an empty list drops the taxon.
NORMAL = {39107: [MOUSE], 10095: [MOUSE], 10114: [RAT], 10118: [RAT], 32281: [FLY], 10239: [], 9605: [], 9989: [MOUSE, RAT], 562: [562, 83333], 284812: [4896]}
#: Taxa whose names are mostly other words, and these words.
AMBIGUOUS = {6754: "[Cc]ancers?", 79338: "codon", 3846: "glycine", 9641: "bears", 9855: "axis", 8555: "monitors?", 9596: "pans?", 49990: "thymus"}


def species_names(line: Column, pattern: str) -> Column:
    """All whole-word hits of a pattern; look-around lets neighbouring hits share a bound."""
    return F.regexp_extract_all(line, F.lit(rf"(?<!\w)(?:{pattern})(?!\w)"), F.lit(0))


def names_in(pattern: str):
    return lambda line: species_names(line, pattern)


def may_name(kind: str):
    """Does a line hold what every hit of the species' pattern holds?"""
    holds = lambda line, mark: line.contains(mark) if isinstance(mark, str) else line.contains(mark[0]) & line.contains(mark[1])
    return lambda line: reduce(or_, [holds(line, m) for m in MARKS[kind]])


def recognize(texts: DataFrame, text_col: str = "plain", default: tuple[int, ...] = (HUMAN,), assumed: tuple[int, ...] = (), only_default: bool = False) -> DataFrame:
    """texts -> with taxon_names map<int, array<string>> and taxa array<int>.

    A text without species gets the defaults; assumed species are added to every text;
    ``only_default`` skips recognition. All in the row: no shuffle.
    """
    lines = F.split(F.col(text_col), r"[\r\n]+")
    entries = []
    for kind, (taxa, pattern) in PATTERNS.items():
        usable = F.filter(lines, may_name(kind))
        usable = F.filter(usable, lambda x: ~x.rlike(NO_YEAST)) if taxa == (YEAST,) else usable
        hits = F.flatten(F.transform(usable, names_in(pattern)))
        entries += [F.struct(F.lit(t).alias("taxon"), hits.alias("names")) for t in taxa]
    found = F.array(*entries)
    own = lambda t: F.flatten(F.transform(F.filter(F.col("__found"), lambda e: e["taxon"] == t), lambda e: e["names"]))
    by_taxon = F.array(*[F.struct(F.lit(t).alias("key"), own(t).alias("value")) for t in (HUMAN, MOUSE, RAT, FLY, YEAST)])
    out = texts.withColumn("__found", found)
    names = F.map_from_entries(F.filter(by_taxon, lambda e: F.size(e["value"]) > 0))
    if only_default:
        names = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<array<string>>"))
    out = out.withColumn("taxon_names", names).drop("__found")
    taxa = F.when(F.size(F.map_keys("taxon_names")) > 0, F.map_keys("taxon_names")).otherwise(F.array(*[F.lit(t) for t in default]).cast("array<int>"))
    return out.withColumn("taxa", F.array_sort(F.array_union(taxa, F.array(*[F.lit(t) for t in assumed]).cast("array<int>"))))


def frequencies(texts: DataFrame) -> DataFrame:
    """text_id, taxon, n (names found), most_frequent (ties all true)."""
    rows = texts.select("text_id", F.explode("taxon_names").alias("taxon", "names")).withColumn("n", F.size("names"))
    return rows.withColumn("most_frequent", F.rank().over(Window.partitionBy("text_id").orderBy(F.desc("n"))) == 1).select("text_id", "taxon", "n", "most_frequent")


def merge_names(a: Column, b: Column) -> Column:
    """Two maps taxon -> names as one; names of a shared taxon follow each other."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.concat(F.coalesce(x, none), F.coalesce(y, none)))


def normalize_taxa(rows: DataFrame, mapping: dict[int, list[int]] | None = None) -> DataFrame:
    """(text_id, taxon, names) with taxa replaced by those they stand for; names of merged taxa are united."""
    table = NORMAL if mapping is None else mapping
    to = F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<int>") for v in table.values()]))
    new = rows.withColumn("taxon", F.explode(F.coalesce(F.try_element_at(to, F.col("taxon")), F.array("taxon"))))
    return new.groupBy("text_id", "taxon").agg(F.flatten(F.sort_array(F.collect_list("names"))).alias("names"))


def clean(names: Column) -> Column:
    """``normalize_taxa`` and ``drop_ambiguous`` on a text's map taxon -> names: null if no taxon is left. All in the row: no shuffle."""
    to = F.map_from_arrays(F.array(*[F.lit(k) for k in NORMAL]), F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<int>") for v in NORMAL.values()]))
    moved = lambda e: F.transform(F.coalesce(F.try_element_at(to, e["key"]), F.array(e["key"])), lambda t: F.struct(t.alias("taxon"), e["value"].alias("names")))
    rows = F.flatten(F.transform(F.map_entries(names), moved))

    def merged(all_rows: Column) -> Column:
        own = lambda t: F.flatten(F.sort_array(F.transform(F.filter(all_rows, lambda r: r["taxon"] == t), lambda r: r["names"])))
        return F.transform(F.array_distinct(F.transform(all_rows, lambda r: r["taxon"])), lambda t: F.struct(t.alias("taxon"), own(t).alias("names")))

    def doubtful(r: Column) -> Column:
        return F.exists(F.array(*[(r["taxon"] == taxon) & F.forall(r["names"], whole_word(pattern)) for taxon, pattern in AMBIGUOUS.items()]), lambda x: x)

    return bind(F.filter(bind(rows, merged), lambda r: ~doubtful(r)), lambda kept: F.when(F.size(kept) > 0, F.map_from_entries(kept)))


def whole_word(pattern: str):
    return lambda name: name.rlike(f"^(?:{pattern})$")


def drop_ambiguous(rows: DataFrame, table: dict[int, str] | None = None) -> DataFrame:
    """(text_id, taxon, names) without taxa all of whose names are ambiguous words."""
    words = AMBIGUOUS if table is None else table
    doubtful = F.lit(False)
    for taxon, pattern in words.items():
        doubtful = doubtful | ((F.col("taxon") == taxon) & F.forall("names", whole_word(pattern)))
    return rows.where(~doubtful)


def specific_tokens(rows: DataFrame) -> DataFrame:
    """(species, token) rows -> tokens that stand with exactly one species: species, token, n."""
    counted = rows.groupBy("token", "species").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("species").alias("species"), F.sum("n").alias("n")).where("k = 1").select("species", "token", "n")

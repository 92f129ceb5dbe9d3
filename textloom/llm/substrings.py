"""Removal of passages that stand in earlier documents, by hashing of lines or parts of them.

A text is cut into units: at line ends, and for ``unit="part"`` also after sentence ends, before
words that begin with a capital and before one word in ``EVERY``, told by its hash. All cuts
hang on the text at their own place, so a passage pasted into a line still falls into whole
units, but for its ends. Units are normalised; neighbours are digested in pairs, and units of
``MIN_WORDS`` words also alone. Digests are grouped over the corpus, and each keeps its earliest
place by rank. Repeated neighbours form a run, and runs of enough words go. Offsets are those of
the original text, in code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common

MIN_WORDS = 20
#: Parts are also cut before one word in so many.
EVERY = 48
MARKS = ".,;:!?'\"()[]-"
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_GAP = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n"), "part": re.compile(r"\n")}


class Cutter:
    """Units of texts. Words met before are known from a bounded cache to be cut before or not."""

    def __init__(self, unit: str = "part", every: int = EVERY, cache: int = 500_000):
        self.gap, self.parts, self.every, self.limit = _GAP[unit], unit == "part", every, cache
        self.opens: dict[str, bool] = {}

    def _opens(self, word: str) -> bool:
        found = bool(_CAPITAL.match(word)) or zlib.crc32(word.lower().strip(MARKS).encode("utf-8", "surrogatepass")) % self.every == 0
        if len(self.opens) < self.limit and len(word) < 100:
            self.opens[word] = found
        return found

    def units(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """(begin, end, words before it, normal form) of each unit that holds a word.

        Normal form: lower case, single spaces, no marks at the ends; it may be empty.
        """
        known, parts, gap = self.opens, self.parts, self.gap
        begin = end = -1
        first = n = 0
        own: list[str] = []
        for n, found in enumerate(re.finditer(r"\S+", text)):
            word, (a, b) = found[0], found.span()
            if own:
                cut = gap.search(text, end, a) if a > end + 1 or text[end] != " " else None
                if not cut and parts:
                    opens = known.get(word)
                    cut = text[end - 1] in ".!?" or (self._opens(word) if opens is None else opens)
                if cut:
                    yield begin, end, first, " ".join(own).lower().strip(MARKS + " ")
                    own = []
            if not own:
                begin, first = a, n
            own.append(word)
            end = b
        if own:
            yield begin, end, first, " ".join(own).lower().strip(MARKS + " ")

    def digested(self, text: str, min_words: int) -> Iterator[tuple[int, int, int, int, int, int, str]]:
        """(pos, units, begin, end, word, words, what to digest) for pairs of neighbours and for long units alone."""
        last: tuple[int, int, int, str] | None = None
        held = [*self.units(text), None]
        for pos, (unit, following) in enumerate(zip(held, held[1:], strict=False)):
            begin, end, word, normal = unit
            words = normal.count(" ") + 1
            if words >= min_words:
                yield pos, 1, begin, end, word, words, normal
            if following is not None and (normal or following[3]):
                yield pos, 2, begin, following[1], word, following[2] - word + following[3].count(" ") + 1, f"{normal}\n{following[3]}"


def units(docs: DataFrame, unit: str = "part", min_words: int = MIN_WORDS, text_col: str = "text", rank_col: str = "doc_id") -> DataFrame:
    """rank, row, place, span, words, h1, h2 for every pair of neighbouring units, and every long unit, of every text.

    ``row`` tells texts of one rank apart. Numbers share columns, two in the halves of a long, as
    each column of a shuffled row takes eight bytes: ``span`` is begin and end, ``words`` the
    number of the first word and of words. ``place`` is the unit's number, then a bit that says
    pair, then one for a digest met before in the same text.
    """
    kind = docs.schema[rank_col].dataType.simpleString()
    names = ["rank", "row", "place", "span", "words", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cutter, digest = Cutter(unit), xxhash.xxh3_128_intdigest
        for batch in common.slices(batches):
            of: list[int] = []
            place, span, words, h1, h2 = own = [[] for _ in names[2:]]
            for at, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                met: set[int] = set()
                for pos, n, begin, end, word, count, normal in cutter.digested(text, min_words):
                    h = digest(normal.encode("utf-8", "surrogatepass"))
                    of.append(at)
                    place.append(pos << 2 | (n == 2) << 1 | (h in met))
                    span.append(begin << 32 | end)
                    words.append(word << 32 | count)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & 0xFFFFFFFF) - (1 << 31))
                    met.add(h)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            taken = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(2).take(taken), *(pa.array(x, t) for x, t in zip(own, kinds, strict=True))], names=names)

    schema = f"rank {kind}, row long, place int, span long, words long, h1 long, h2 int"
    return docs.select(F.col(rank_col), F.col(text_col).cast("string"), F.xxhash64(text_col)).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, unit: str = "part", min_words: int = MIN_WORDS, text_col: str = "text", rank_col: str = "doc_id") -> DataFrame:
    """rank, row, begin, end, n_units, n_words, kept_rank: the runs to remove.

    A pair of units is a repeat if a smaller rank holds its digest or its own text held it
    before. The grouping is one aggregation with partial sums, so a passage of every document
    is no task of its own. ``kept_rank`` is the smallest rank that keeps a part of the run. A
    null rank comes after all others; texts that share a rank are one document. Null and empty
    texts, and an empty table, have no spans; long texts are cut whole.
    """
    rows = common.materialise(units(docs, unit, min_words, text_col, rank_col), "units", "zstd")
    first = rows.groupBy("h1", "h2").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.max(F.col("rank").isNull()).alias("nulls"), F.max(F.col("place") % 2 == 1).alias("inside"))
    shared = first.where((F.col("low") < F.col("high")) | (F.col("nulls") & F.col("low").isNotNull()) | F.col("inside"))
    # a table of its own: the join is then free to split a digest of very many places over tasks
    shared = common.materialise(shared.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "low"), "shared-units")
    hit = rows.join(shared, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    hit = hit.where((F.col("place") % 2 == 1) | (F.col("low") < F.col("rank")) | (F.col("rank").isNull() & F.col("low").isNotNull()))
    # whole repeated rows give the same units twice
    hit = hit.select("rank", "row", "place", "span", "words", "low").repartition("rank", "row").dropDuplicates(["rank", "row", "place"])
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    pos = F.shiftright("place", 2)
    last = pos + F.shiftright("place", 1) % 2
    own = hit.select("rank", "row", pos.alias("pos"), last.alias("last"), high("span").cast("int").alias("begin"), low("span").cast("int").alias("end"), high("words").alias("word"), (high("words") + low("words")).alias("stop"), "low")
    by_place = Window.partitionBy("rank", "row").orderBy("pos", "last")
    so_far = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("pos") > F.col("so_far") + 1, 1).otherwise(0)).over(by_place)
    runs = own.withColumn("so_far", so_far).withColumn("island", island).groupBy("rank", "row", "island")
    n_units, n_words = F.max("last") - F.min("pos") + 1, F.max("stop") - F.min("word")
    runs = runs.agg(F.min("begin").alias("begin"), F.max("end").alias("end"), n_units.cast("long").alias("n_units"), n_words.cast("long").alias("n_words"), F.min("low").alias("kept_rank"))
    return runs.where(F.col("n_words") >= min_words).drop("island")


def without(text: Column, spans: Column) -> Column:
    """``text`` without the given spans (array of structs with begin and end, in code points, not overlapping)."""
    ordered = F.sort_array(spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(F.substr(text, s["at"] + 1, x["begin"] - s["at"]))).alias("parts"))
    return F.aggregate(ordered, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, s["at"] + 1)))


def remove_repeats(docs: DataFrame, unit: str = "part", min_words: int = MIN_WORDS, text_col: str = "text", rank_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut out, and ``removed``: their spans in the original text.

    A column of that name stays, and the spans' name gets an underscore.

    A text with no repeat, null and empty texts stay as they are, with an empty list. Rows that
    repeat as a whole all stay: they are one document. Extra columns are carried along; an empty
    table stays empty.
    """
    spans = repeated_spans(docs, unit, min_words, text_col, rank_col)
    lists = spans.groupBy(F.col("rank").alias("__rank"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("begin", "end", "n_words", "kept_rank")).alias("__spans"))
    base = docs.withColumn("__own", F.xxhash64(text_col))
    joined = base.join(lists, base[rank_col].eqNullSafe(lists["__rank"]) & (base["__own"] == lists["__row"]), "left")
    text = F.when(F.col("__spans").isNull(), base[text_col]).otherwise(without(base[text_col], F.col("__spans")))
    none = F.array().cast(joined.schema["__spans"].dataType)
    columns = [text.alias(c) if c == text_col else base[c] for c in docs.columns]
    return joined.select(*columns, F.sort_array(F.coalesce("__spans", none)).alias(common.free_name("removed", docs.columns)))

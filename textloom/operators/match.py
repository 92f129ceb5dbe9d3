"""Dictionary matching: exact names by token n-grams and a hash join, patterns by first-character buckets."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import TOKENIZERS

#: Characters a token may follow, and characters that may follow it.
BEFORE = r" :(/\-"
AFTER = r" ,.:;)/\-+("


def key_of(name: Column) -> Column:
    """The form under which names are compared: tokens in lower case, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit(TOKENIZERS["simple"]), F.lit(0)), " ")


def is_bounded(text: Column, begin: Column, end: Column) -> Column:
    """May a mention stand at begin..end (inclusive)? Checks the characters on both sides."""
    left = F.substr(text, begin, F.lit(1))
    right = F.substr(text, end + 2, F.lit(1))
    return ((begin == 0) | left.rlike(f"^[{BEFORE}]$")) & ((end + 1 >= F.length(text)) | right.rlike(f"^[{AFTER}]$"))


def token_table(texts: DataFrame, text_col: str = "plain") -> DataFrame:
    """text_id, pos, token, begin, end (inclusive) for the letter-and-digit runs and marks of each text.

    Places come from the gaps between tokens, so nothing is searched twice.
    """
    pattern = TOKENIZERS["simple"]
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(F.regexp_replace(F.col(text_col), pattern, "\u0001"), "\u0001"), lambda g: F.length(g))
    rows = texts.select("text_id", F.posexplode(F.arrays_zip(found.alias("token"), gaps.alias("gap"))).alias("pos", "t")).where("t.token is not null")
    before = Window.partitionBy("text_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.sum(F.col("t.gap") + F.length("t.token")).over(before)
    return rows.select("text_id", "pos", F.col("t.token").alias("token"), (reach - F.length("t.token")).cast("int").alias("begin"), (reach - 1).cast("int").alias("end"))


#: n-grams that leave Python at once, so that a task's memory follows neither a batch's rows nor a text's length.
GRAMS_AT_ONCE = 8192
#: Characters of whole texts that are looked at together, one longer text by itself.
CHARS_AT_ONCE = 1 << 18
#: Bits of the largest sieve of names (16 MB, beginnings and names); with more names than that it lets more n-grams through to the join.
SIEVE_BITS = 1 << 27
#: Bits of a table of token outlines, of which a sieve begins with three: of one-token names, of other names' first tokens, of their second tokens.
OUTLINE_BITS = 1 << 19


def outline(token: Column) -> Column:
    """First, second and last character and length of a lower-case token, five bits each and four: tokens that are equal have equal ones."""
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(0).bitwiseAND(31)
    size = F.length(token)
    return code(F.substring(token, 1, 1)) + 32 * code(F.substr(token, F.least(size, F.lit(2)), F.lit(1))) + 1024 * code(F.right(token, F.lit(1))) + 32768 * F.least(size, F.lit(15))


def key_sieve(dictionary: DataFrame, n_names: int) -> bytes:
    """Tables of bits, one behind the other: three of outlines, one of the CRC-32 of every key's beginnings of whole tokens, one of that of every key.

    What they lack is no name; what they have is settled by the join with the dictionary.
    """
    bits = min(SIEVE_BITS // 2, max(1 << 16, 1 << (32 * n_names).bit_length()))
    parts, top = F.split("key", " "), 3 * OUTLINE_BITS
    outlines = F.when(F.size(parts) == 1, F.array(outline(parts[0]))).otherwise(F.array(outline(parts[0]) + OUTLINE_BITS, outline(F.get(parts, F.lit(1))) + 2 * OUTLINE_BITS))
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.pmod(F.crc32(F.array_join(F.slice(parts, F.lit(1), n), " ")), F.lit(bits)) + top)
    hashed = dictionary.select(F.explode(F.concat(outlines.cast("array<bigint>"), starts, F.array(F.pmod(F.crc32("key"), F.lit(bits)) + top + bits))).alias("h"))
    words = hashed.groupBy(F.expr("h div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(h % 8 as int))")).alias("set")).toArrow()
    table = np.zeros((top + 2 * bits) // 8, dtype=np.uint8)
    table[words["at"].to_numpy()] = words["set"].to_numpy()
    return table.tobytes()


def _among(characters: str) -> np.ndarray:
    """By code point, the last entry for all beyond ASCII: is it one of these?"""
    return np.array([chr(c) in characters for c in range(128)] + [False])


_ALNUM, _SPACE = (np.array([bool(re.match(p, chr(c), re.ASCII)) for c in range(128)] + [False]) for p in ("[A-Za-z0-9]", r"\s"))
_OPENING, _CLOSING = _among(BEFORE.replace("\\", "")), _among(AFTER.replace("\\", ""))
_FOLDED = np.array([ord(chr(c).lower()) for c in range(128)] + [0], np.int32) & 31


def token_places(text: str, sieve: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (inclusive) of the tokens of a text between spaces, the numbers of those that may begin a name, and which may end one.

    The simple tokenizer over arrays of characters; outlines of a token and of the next one leave out most that begin no name.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.minimum(points, 128).astype(np.uint8)
    alnum = _ALNUM[codes]
    mark = ~(alnum | _SPACE[codes])
    starts, ends = mark.copy(), mark
    starts[1:] |= alnum[1:] & ~alnum[:-1]
    ends[:-1] |= alnum[:-1] & ~alnum[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    may = _OPENING[codes[starts - 1]]
    if sieve is not None:
        folded = _FOLDED[codes]
        folded[points == 0x212A] = ord("k") & 31  # the one letter beyond ASCII that is within it in lower case
        seen = folded[starts] + 32 * folded[np.minimum(starts + 1, ends)] + 1024 * folded[ends] + 32768 * np.minimum(ends - starts + 1, 15)
        table = np.frombuffer(sieve, np.uint8, 3 * OUTLINE_BITS // 8)
        one, first, second = ((table[(seen + k * OUTLINE_BITS) >> 3] >> (seen & 7) & 1).astype(bool) for k in range(3))
        first[:-1] &= second[1:]
        first[-1:] = False
        may &= one | first
    return starts, ends, np.flatnonzero(may), _CLOSING[codes[ends + 1]]


def gram_batches(batches: Iterable[pa.RecordBatch], lengths: list[int], sieve: bytes | None = None, at_once: int = GRAMS_AT_ONCE, chars_at_once: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """(text_id, text) batches -> text_id, key, name, begin, end of their n-grams, about ``at_once`` rows at a time.

    A run of tokens grows only while the sieve has it as the beginning of a name.
    """
    lengths, top, crc = frozenset(lengths), 3 * OUTLINE_BITS, zlib.crc32
    longest, bits = max(lengths, default=0), (4 * len(sieve) - top // 2) if sieve else 0

    def grams(rows: list[int], texts: list[str]) -> Iterator[tuple[int, str, str, int, int]]:
        text = f" {' '.join(texts)} "  # a space may stand on both sides of a mention, as a text's ends may
        starts, ends, may, closes = token_places(text, sieve)
        begins = np.cumsum([1] + [len(x) + 1 for x in texts])
        own = np.searchsorted(begins, starts[may], "right") - 1
        limits = np.minimum(np.searchsorted(starts, begins[own + 1]), may + longest)
        numbers = zip(may.tolist(), own.tolist(), limits.tolist(), begins[own].tolist(), strict=True)
        starts, ends, closes = starts.tolist(), (ends + 1).tolist(), closes.tolist()
        for i, k, limit, at in numbers:
            h, low = 0, ""
            for j in range(i, limit):
                token = text[starts[j] : ends[j]].lower()
                low = f"{low} {token}" if low else token
                if bits:
                    h = crc(token.encode() if j == i else b" " + token.encode(), h)
                    g = h % bits + top
                    if not sieve[g >> 3] >> (g & 7) & 1:
                        break
                    g += bits
                    if not sieve[g >> 3] >> (g & 7) & 1:
                        continue
                if closes[j] and j - i + 1 in lengths:
                    yield rows[k], low, text[starts[i] : ends[j]], starts[i] - at, ends[j] - 1 - at

    for batch in batches:
        ids, values = batch.column(0), batch.column(1)
        out: list[tuple[int, str, str, int, int]] = []

        def made(rows: list[tuple[int, str, str, int, int]], ids: pa.Array = ids) -> pa.RecordBatch:
            row, key, name, begin, end = zip(*rows, strict=True)
            columns = [ids.take(pa.array(row, pa.int32())), pa.array(key, pa.string()), pa.array(name, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["text_id", "key", "name", "begin", "end"])

        rows, texts, n = [], [], 0
        for at in range(batch.num_rows + 1):
            text = values[at].as_py() if at < batch.num_rows else None
            if texts and (at == batch.num_rows or n + len(text or "") > chars_at_once):
                for gram in grams(rows, texts):
                    out.append(gram)
                    if len(out) >= at_once:
                        yield made(out)
                        out = []
                rows, texts, n = [], [], 0
            if text:
                rows.append(at)
                texts.append(text)
                n += len(text)
        if out:
            yield made(out)


#: Bytes of texts that go to Python as one Arrow batch. Spark's own bound is 10,000 rows however long they are, and the JVM holds a batch outside its heap.
BYTES_AT_ONCE = 1 << 22
#: Texts that Parquet's reader unpacks at a time; Spark's own 4096 fill a heap when texts are long.
TEXTS_AT_ONCE = 256


def bounded_batches(texts: DataFrame) -> DataFrame:
    """``texts``, whose session reads and hands them to Python in batches of these bounds from now on, unless it has bounds of its own."""
    conf = texts.sparkSession.conf
    for key, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE), ("spark.sql.parquet.columnarReaderBatchSize", TEXTS_AT_ONCE)):
        if conf.get(key, None) is None:
            conf.set(key, str(bound))
    return texts


def token_grams(texts: DataFrame, lengths: list[int], text_col: str = "plain", sieve: bytes | None = None) -> DataFrame:
    """text_id, key, name, begin, end: runs of tokens where a mention may stand, for each of the lengths.

    One pass over each text in Arrow batches, with no shuffle. With a fold in SQL functions queries
    took three to four times as long, and windows over tokens would shuffle all of them. A ``sieve``
    (from ``key_sieve``) leaves out most n-grams that are no names.
    """
    kind = texts.schema["text_id"].dataType.simpleString()
    shared = None if sieve is None else texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gram_batches(batches, lengths, shared and shared.value)

    return bounded_batches(texts).select("text_id", F.col(text_col).alias("plain")).mapInArrow(run, f"text_id {kind}, key string, name string, begin int, end int")


def merge_dictionary(names: DataFrame) -> DataFrame:
    """(name, id, taxon?) rows -> one row per compared form and taxon: key, taxon, name (smallest), ids (sorted, distinct), n_tokens."""
    rows = names if "taxon" in names.columns else names.withColumn("taxon", F.lit(None).cast("int"))
    keyed = rows.withColumn("key", key_of(F.col("name"))).where("key <> ''")
    merged = keyed.groupBy("key", "taxon").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("id")).alias("ids"))
    return merged.withColumn("n_tokens", F.size(F.split("key", " ")))


def match_names(texts: DataFrame, dictionary: DataFrame, text_col: str = "plain", taxa: DataFrame | None = None, longest: bool = True) -> DataFrame:
    """Mentions of dictionary names (from ``merge_dictionary``) in texts: text_id, begin, end, name, candidates, taxon.

    Each text's tokens make n-grams of the lengths that names have; those that pass a sieve of
    the names' hashes are joined to the names by their form (a hash join that AQE may broadcast). ``taxa`` (text_id, taxon) limits
    a text to the dictionaries of its species. With ``longest`` the leftmost longest match wins
    within a taxon and later ones that overlap it are dropped; other taxa may overlap.
    """
    counts = {r[0]: r[1] for r in dictionary.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}  # distinct lengths, never more than the longest name has tokens
    gram = token_grams(texts, sorted(counts), text_col, key_sieve(dictionary, sum(counts.values())))
    names = dictionary.select("key", "ids", F.col("taxon"))
    found = gram.join(names, "key").select("text_id", "begin", "end", "name", F.col("ids").alias("candidates"), "taxon")
    if taxa is not None:
        wanted = taxa.select(F.col("text_id").alias("t_id"), F.col("taxon").alias("t_taxon")).distinct()
        found = found.join(wanted, (F.col("text_id") == F.col("t_id")) & (F.col("taxon") == F.col("t_taxon")), "left_semi")
    return leftmost_longest(found, ["text_id", "taxon"]) if longest else found


def leftmost_longest(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Of overlapping mentions of one ``by`` the leftmost, then the longest one stays; a scan over each text's sorted mentions."""
    rest = [c for c in mentions.columns if c not in by]
    order = F.array_sort(F.collect_list(F.struct(F.col("begin"), (-F.col("end")).alias("back"), F.struct(*rest).alias("m"))))
    grouped = mentions.groupBy(*by).agg(order.alias("all"))
    kind = grouped.schema["all"].dataType.elementType["m"].dataType.simpleString()
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(s: Column, m: Column) -> Column:
        free = m["begin"] > s["reach"]
        return F.struct(F.when(free, -m["back"]).otherwise(s["reach"]).alias("reach"), F.when(free, F.concat(s["kept"], F.array(m["m"]))).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate("all", start, step, lambda s: s["kept"])
    return grouped.select(*by, F.explode(kept).alias("m")).select(*by, "m.*").select(*mentions.columns)


#: Patterns that one task compiles at a time.
PATTERNS_AT_ONCE = 50_000


def match_patterns(texts: DataFrame, patterns: DataFrame, text_col: str = "plain", at_once: int = PATTERNS_AT_ONCE) -> DataFrame:
    """Mentions of pattern entries (regex, ids): text_id, begin, end, name, candidates.

    Entries are bucketed by the characters that can begin a match, so a token start tries only
    its bucket. They come to the tasks in parts of ``at_once``, so memory does not follow the
    dictionary; each part gives its longest matches at every place, whose ids are united. Longest
    match at a place, no overlaps.
    """
    rows = patterns.select("regex", "ids").distinct().withColumn("part", F.pmod(F.xxhash64("regex"), F.lit(max(1, -(-patterns.count() // at_once)))))
    found = None
    for (part,) in sorted(rows.select("part").distinct().collect()):
        own = pattern_places(texts, rows.where(F.col("part") == part), text_col)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = pattern_places(texts, rows, text_col)
    top = found.groupBy("text_id", "begin").agg(F.max(F.struct("end", "name")).alias("m"), F.collect_list(F.struct("end", "candidates")).alias("all"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: x["end"] == F.col("m.end")), lambda x: x["candidates"]))))
    longest = top.select("text_id", "begin", F.col("m.end").alias("end"), F.col("m.name").alias("name"), ids.alias("candidates"))
    return leftmost_longest(longest, ["text_id"])


def pattern_places(texts: DataFrame, patterns: DataFrame, text_col: str = "plain") -> DataFrame:
    """The longest matches of ``patterns`` at every token start: text_id, begin, end, name, candidates."""
    kind = texts.schema["text_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast([(r["regex"], list(r["ids"])) for r in patterns.orderBy("regex").toLocalIterator()])  # one part of the patterns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = [(re.compile(f"(?:{p})(?=[{AFTER}]|$)"), ids) for p, ids in shared.value]
        buckets: dict[str, list[int]] = {}
        probes = [chr(c) for c in range(33, 127)]
        for k in range(len(entries)):
            for c in first_characters(shared.value[k][0]) or probes:
                buckets.setdefault(c, []).append(k)
        for pdf in batches:
            out = []
            for text_id, text in zip(pdf["text_id"], pdf["__text"], strict=True):
                for at, c in enumerate(text or ""):
                    if c not in buckets or at and text[at - 1] not in " :(/-":
                        continue
                    best, ids = -1, set()
                    for k in buckets[c]:
                        m = entries[k][0].match(text, at)
                        if m and m.end() > at and m.end() >= best:
                            ids = set(entries[k][1]) | (ids if m.end() == best else set())
                            best = m.end()
                    if best > at:
                        out.append((text_id, at, best - 1, text[at:best], sorted(ids)))
            yield pd.DataFrame(out, columns=["text_id", "begin", "end", "name", "candidates"])

    return bounded_batches(texts).select("text_id", F.col(text_col).alias("__text")).mapInPandas(run, f"text_id {kind}, begin int, end int, name string, candidates array<string>")


def first_characters(pattern: str) -> set[str]:
    """The characters with which a match of a pattern made by ``name_pattern`` can begin; empty if unknown."""
    if m := re.match(r"\[([A-Za-z0-9]+)\](?![?*])", pattern):
        return set(m[1])
    if m := re.match(r"\\?([A-Za-z0-9(+])(?![?*])", pattern):
        return {m[1]} if pattern[0] != "(" else set()
    if m := re.match(r"\(\?:((?:[A-Za-z0-9]+\|)*[A-Za-z0-9]+)\)(?![?*])", pattern):
        return {w[0] for w in m[1].split("|")}
    return set()


def exclude_forms(mentions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Mentions whose surface form is not in ``excluded`` (name): what pruning the dictionary would give."""
    return mentions.join(excluded.select(F.col("name").alias("x_name")).distinct(), F.col("name") == F.col("x_name"), "left_anti")


def route_dictionaries(text_taxa: DataFrame, dictionaries: DataFrame, limited: list[int] | None = None, excluded: list[int] | None = None) -> DataFrame:
    """(text_id, taxon) for which a dictionary exists, minus excluded taxa and cut to limited ones.

    ``dictionaries`` (taxon string) may hold ALL, which every text gets, and OTHER, which texts
    without a dictionary of their own get.
    """
    rows = text_taxa.select("text_id", F.col("taxon").cast("string").alias("taxon")).distinct()
    if excluded:
        rows = rows.where(~F.col("taxon").isin([str(t) for t in excluded]))
    if limited:
        rows = rows.where(F.col("taxon").isin([str(t) for t in limited]))
    known = dictionaries.select(F.col("taxon").cast("string").alias("d_taxon")).distinct()
    own = rows.join(known, F.col("taxon") == F.col("d_taxon"), "left_semi")
    texts = rows.select("text_id").distinct()
    special = known.where(F.col("d_taxon").isin("ALL", "OTHER"))
    every = texts.withColumn("taxon", F.lit("ALL"))
    every = every.join(special, F.col("taxon") == F.col("d_taxon"), "left_semi")
    others = texts.join(own.select("text_id").distinct(), "text_id", "left_anti").withColumn("taxon", F.lit("OTHER")).join(special, F.col("taxon") == F.col("d_taxon"), "left_semi")
    return own.unionByName(every).unionByName(others)


def term_codes(mentions: DataFrame, prefix: str = "G") -> DataFrame:
    """Ontology codes of term mentions: ids that begin with ``prefix``, without it and leading zeros."""
    codes = F.transform(F.filter("candidates", lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.regexp_extract(x, r"([1-9][0-9]*)$", 1))
    return mentions.withColumn("codes", F.array_distinct(codes)).where(F.size("codes") > 0)


def codes_by_article(texts: DataFrame, table: DataFrame) -> DataFrame:
    """Codes listed for a text's article number: text_id, codes. ``table`` has (pmid, code)."""
    listed = table.groupBy("pmid").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return texts.select("text_id", "pmid").join(listed, "pmid", "left").select("text_id", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def token_dictionary_tags(sentences: DataFrame, entries: DataFrame, drop_contained: bool = True) -> DataFrame:
    """Matches of token phrases in token lists: sent_id, start, end (in tokens, end exclusive), type.

    ``sentences`` (sent_id, tokens), ``entries`` (phrase array<string>, type). A phrase that ends
    at the last token counts. Contained matches may be dropped.
    """
    lengths = [r[0] for r in entries.select(F.size("phrase")).distinct().collect()] or [1]

    def grams(n: int) -> Column:
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(0), F.size("tokens") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.slice(F.col("tokens"), i + 1, F.lit(n)).alias("phrase")))

    rows = sentences.select("sent_id", F.explode(F.concat(*[grams(n) for n in lengths])).alias("g")).select("sent_id", "g.start", "g.end", "g.phrase")
    found = rows.join(entries, "phrase").select("sent_id", "start", "end", "type").distinct()
    return drop_contained_spans(found, "sent_id") if drop_contained else found


def drop_contained_spans(spans: DataFrame, by: str) -> DataFrame:
    """Spans that lie in no other span of the same ``by``; equal spans stay.

    Sorted by start and longest first, a span is contained if an earlier, different one reaches
    its end: one window of running maxima instead of a range join.
    """
    order = Window.partitionBy(by).orderBy("start", F.desc("end"))
    distinct = spans.select(by, "start", "end").distinct()
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = distinct.withColumn("__reach", reach).where("__reach is null or __reach < end").drop("__reach")
    k = kept.select(F.col(by).alias("k_by"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    return spans.join(k, (F.col(by) == F.col("k_by")) & (F.col("start") == F.col("k_start")) & (F.col("end") == F.col("k_end")), "left_semi")

"""License scan by ordered signature rules behind a keyword prefilter.

A text's words are joined in lower case; plain look-ups of all keywords decide whether any rule
can match. For the texts that pass, only the rules of keywords found are run, and detections
inside another of the same or a better tier are suppressed in one sweep over their sorted
intervals.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.license_rules import INSIDE, RULES
from textloom.llm.quality_rules import bind

#: Places where these words stand in a row: label, words.
BASE = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Confidence of a detection by tier.
CONFIDENCE = (1.0, 0.8, 0.4)


def words_of(text: Column) -> Column:
    """Runs of digits, letters a to z and all beyond ASCII, after A-Z are lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, NOT_WORD, -1), "")


def phrase_starts(words: Column, phrase: tuple[str, ...]) -> Column:
    """Numbers of the words at which the phrase starts."""
    n = len(phrase)
    numbers = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))

    def at(v: Column) -> Column:
        def here(i: Column) -> Column:
            test = F.get(v["w"], i) == phrase[0]
            for k in range(1, n):
                test = test & (F.get(v["w"], i + k) == phrase[k])
            return test

        return F.filter(v["i"], here)

    return bind(F.struct(words.alias("w"), numbers.alias("i")), at)


KIND = "array<struct<start:int,end:int,tier:int,rule:int,label:string>>"


def gate_text(keyword: str) -> str:
    """What a text must hold for a rule of the keyword: it begins a word, unless it may stand inside one."""
    return keyword if keyword in INSIDE else f" {keyword}"


def detections(joined: Column, rules: list[tuple[str, int, str, str]] = RULES) -> Column:
    """array<struct<start, end, tier, rule, label>>: what the rules find in joined words, in character places.

    The rules are one literal table, grouped by keyword, of which the groups are kept whose
    keyword the text holds. One search a rule marks its matches; their places follow from the
    lengths of the pieces between the marks.
    """
    by_keyword: dict[str, list[Column]] = {}
    for number, (label, tier, keyword, pattern) in enumerate(rules):
        # the space before stays out of the match, so that matches side by side are both found
        rule = F.struct(F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"), F.lit(tier).alias("tier"), F.lit(number).alias("rule"), F.lit(label).alias("label"))
        by_keyword.setdefault(keyword, []).append(rule)
    table = F.array(*[F.struct(F.lit(gate_text(k)).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])
    live = F.flatten(F.transform(F.filter(table, lambda k: F.contains(joined, k["keyword"])), lambda k: k["rules"]))
    none = F.array().cast(KIND)

    def places(rule: Column) -> Column:
        pieces = F.split(F.regexp_replace(joined, rule["pattern"], F.lit("\u0001$0\u0001")), "\u0001", -1)

        def sweep(v: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), none.alias("found"))

            def step(s: Column, k: Column) -> Column:
                first = s["at"] + F.length(F.get(v["p"], 2 * k))
                end = first + F.length(F.get(v["p"], 2 * k + 1))
                one = F.struct(first.alias("start"), end.alias("end"), v["tier"].alias("tier"), v["rule"].alias("rule"), v["label"].alias("label"))
                return F.struct(end.alias("at"), F.concat(s["found"], F.array(one)).alias("found"))

            return F.aggregate(F.sequence(F.lit(0), (F.size(v["p"]) / 2).cast("int") - 1), start, step, lambda s: s["found"])

        return bind(F.struct(pieces.alias("p"), *[rule[c].alias(c) for c in ("tier", "rule", "label")]), lambda v: F.when(F.size(v["p"]) > 1, sweep(v)).otherwise(none))

    return F.flatten(F.transform(live, places))


def unsuppressed(found: Column) -> Column:
    """Detections that lie inside no other of the same or a better tier; of equal ones the better tier's, then that of the rule that comes first.

    Sorted by start, then longest first, a detection is inside an earlier one exactly if the
    furthest end so far, over the tiers up to its own, reaches its end.
    """
    keyed = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["label"].alias("label")))
    start = F.struct(F.lit(-1).alias("e0"), F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.array().cast(KIND).alias("kept"))

    def step(s: Column, d: Column) -> Column:
        stop = -d["back"]
        reach = F.when(d["tier"] == 0, s["e0"]).when(d["tier"] == 1, F.greatest(s["e0"], s["e1"])).otherwise(F.greatest(s["e0"], s["e1"], s["e2"]))
        end = lambda t: F.when(d["tier"] == t, F.greatest(s[f"e{t}"], stop)).otherwise(s[f"e{t}"])
        one = F.struct(d["start"].alias("start"), stop.alias("end"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["label"].alias("label"))
        kept = F.when(reach >= stop, s["kept"]).otherwise(F.concat(s["kept"], F.array(one)))
        return F.struct(end(0).alias("e0"), end(1).alias("e1"), end(2).alias("e2"), kept.alias("kept"))

    return F.aggregate(F.sort_array(keyed), start, step, lambda s: s["kept"])


def scan(docs: DataFrame, text_col: str = "text", rules: list[tuple[str, int, str, str]] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (the detections).

    A null or empty text has no words, no labels and the score 0. Whole texts are scanned, row
    by row, with no shuffle; repeated rows are scanned each and extra columns are left out. Long
    texts are scanned whole; an empty table gives no rows.
    ``found`` holds character places in the joined words. Score: the best tier's confidence.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select("doc_id", words_of(text).alias("words"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    keywords = {gate_text(k) for *_, k, _ in rules}
    # of keywords that hold one another the shortest decides
    gates = sorted(k for k in keywords if not any(o != k and o in k for o in keywords))
    none = F.array().cast("array<int>")
    starts = [F.when(F.contains("joined", F.lit(" " + " ".join(p) + " ")), phrase_starts(F.col("words"), p)).otherwise(none) for _, p in BASE]
    rows = rows.withColumns({f"at{k}": s for k, s in enumerate(starts)})
    empty = F.array().cast(KIND)
    gate = reduce(or_, [F.contains("joined", F.lit(k)) for k in gates])
    rows = rows.withColumn("all_found", F.when(gate, detections(F.col("joined"), rules)).otherwise(empty))
    rows = rows.withColumn("found", F.when(F.size("all_found") > 0, unsuppressed(F.col("all_found"))).otherwise(empty))
    places = F.concat(*[F.col(f"at{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(BASE)]))
    added = F.transform("found", lambda d: d["label"])
    best = F.array_min(F.transform("found", lambda d: d["tier"]))
    by_tier = F.when(best == 0, CONFIDENCE[0]).when(best == 1, CONFIDENCE[1]).when(best == 2, CONFIDENCE[2]).otherwise(0.0)
    score = F.greatest(by_tier, F.when(F.size(places) > 0, F.lit(CONFIDENCE[2])).otherwise(0.0))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"),
        score.alias("score"),
        "found",
    )

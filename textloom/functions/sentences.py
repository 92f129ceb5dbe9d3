"""Sentences by rules, in one pass over the marks and brackets of a text.

Each mark may open a cut; an abbreviation before it vetoes the cut, and a bracket that closes
takes back the cuts made since it opened. Brackets without a partner bind nothing.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The headings of structured abstracts.
HEADINGS = (
    "BACKGROUND", "Background", "OBJECTIVE", "Objective", "AIM", "Aim", "PURPOSE", "Purpose", "METHOD", "Method",
    "DESIGN", "Design", "RESULT", "Result", "FINDING", "Finding", "CONCLUSION", "Conclusion", "INTERPRETATION",
    "Interpretation", "INTRODUCTION", "Introduction", "DISCUSSION", "Discussion", "SUMMARY", "Summary",
)
#: Words before a full stop that ends no sentence.
ABBREVIATIONS = frozenset(["Dr", "Drs", "Prof", "Profs", "Mr", "Mrs", "Ms", "ca", "vs", "i.e", "e.g", "s.l"])
#: Words that begin a sentence even where the space before them is missing.
STARTERS = ("The ", "This ", "We ", "Our ", "In ")
OPENING = frozenset("\"'[({")

_PLACE = re.compile(r"[.!?;:()\[\]]")
_CITED = re.compile(r"[\d ,-]*\d[\d ,-]* (?=[A-Z][a-z])")
_HEADING = re.compile(rf"((?:{'|'.join(HEADINGS)})[sS]?(?: ?(?:/|AND|and) ?(?:{'|'.join(HEADINGS)})[sS]?)?:?) *(?=[A-Z])")


class Cut(NamedTuple):
    """A sentence stops at ``stop``, has ``tail`` behind it, and the next one starts at ``resume``."""

    stop: int
    resume: int
    tail: str = ""


def _begins(text: str, at: int) -> bool:
    return at < len(text) and (text[at] in OPENING or text[at].isascii() and (text[at].isupper() or text[at].isdigit()))


def _vetoed(text: str, stop: int, resume: int) -> bool:
    """Does the word before the full stop at ``stop`` shorten something?"""
    first = text.rfind(" ", 0, stop) + 1
    word = text[first:stop].lstrip("([")
    if word in ABBREVIATIONS:
        return True
    if not first or len(word) != 1 or not word.isupper():
        return False
    # a single capital belongs to what follows, but not after a number: "type 3 A. Then"
    *_, owner, number = ("", "", *text[max(0, first - 60) : first - 1].split(" "))
    return not (owner[-1:].islower() and number.strip("0123456789-") == "" and number and text[resume : resume + 1].isupper())


def _cut_at(text: str, i: int) -> Cut | None:
    """The cut that the mark at ``i`` makes, if any."""
    mark, following = text[i], text[i + 1 : i + 2]
    if following == '"' and mark != ":":
        return Cut(i + 2, i + 2 + len(text[i + 2 :]) - len(text[i + 2 :].lstrip(" ")) if text[i + 2 : i + 3] == " " else i + 2)
    if following == " " and _begins(text, i + 2):
        return None if mark == "." and _vetoed(text, i, i + 2) else Cut(i + 1, i + 2)
    if mark == "." and text[max(0, i - 2) : i].islower() and text[max(0, i - 2) : i].isalpha():
        if cited := _CITED.match(text, i + 1):
            return Cut(i, cited.end(), f" {cited[0].strip()}.")
        if text.startswith(STARTERS, i + 1) and text[max(0, i - 3) : i].isalpha():
            return Cut(i + 1, i + 1)
    return None


def split_sentences(text: str | None) -> list[str] | None:
    """Sentences of a text with its lines joined; none are empty. A title in square brackets keeps them."""
    if text is None:
        return None
    line = re.sub(r"\s+", " ", text)
    titled = len(line) > 1 and line[0] == "[" and line[-1] == "]"
    if titled:
        line = line[1:-1]
    cuts: list[Cut] = []
    opened: list[tuple[str, int]] = []
    for place in _PLACE.finditer(line):
        sign = place[0]
        if sign in "([":
            opened.append((sign, len(cuts)))
        elif sign in ")]":
            partner = "(" if sign == ")" else "["
            depth = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == partner), None)
            if depth is not None:
                del cuts[opened[depth][1] :], opened[depth:]
        elif cut := _cut_at(line, place.start()):
            cuts.append(cut)
    out, start = [], 0
    for stop, resume, tail in (*cuts, Cut(len(line), len(line))):
        sentence = line[start:stop] + tail
        start = resume
        while heading := _HEADING.match(sentence):
            out.append(heading[1])
            sentence = sentence[heading.end() :]
        out.append(sentence)
    out = [s for s in out if s.strip()]
    if titled:
        out = [f"[ {s}" if k == 0 else s for k, s in enumerate(out)]
        out[-1:] = [f"{s} ]" for s in out[-1:]]
    return out


def rule_sentences(text: Column) -> Column:
    """Sentences of a text column, in Arrow batches; a null text has none to tell."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_sentences, na_action=None)

    return split(text)

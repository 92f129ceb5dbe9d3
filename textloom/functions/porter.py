"""Porter's stemmer (1980) for English."""

from __future__ import annotations

import re

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M_OVER_0 = re.compile(f"^(?:{_CC})?{_VV}{_CC}")
_M_IS_1 = re.compile(f"^(?:{_CC})?{_VV}{_CC}(?:{_VV})?$")
_M_OVER_1 = re.compile(f"^(?:{_CC})?{_VV}{_CC}{_VV}{_CC}")
_VOWEL = re.compile(f"^(?:{_CC})?{_V}")
_CVC = re.compile(f"^{_CC}{_V}[^aeiouwxy]$")

#: Endings and what stands for them, in the algorithm's steps.
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive",
    biliti="ble", logi="log",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _replaced(word: str, table: dict[str, str]) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + table[ending] if _M_OVER_0.match(stem) else word
    return word


def porter_stem(word: str | None) -> str | None:
    """The stem of a word in lower case; words of one or two letters stay."""
    if word is None or len(word) < 3:
        return word
    w = word.lower()
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M_OVER_0.match(w[:-3]):
            w = w[:-1]
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and _VOWEL.match(w[: -len(ending)]):
                w = w[: -len(ending)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _M_IS_1.match(w) and _CVC.match(w):
                    w += "e"
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2), _STEP3)
    for ending in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(ending):
            if _M_OVER_1.match(w[: -len(ending)]):
                w = w[: -len(ending)]
            break
    else:
        if w.endswith("ion") and w[:-3].endswith(("s", "t")) and _M_OVER_1.match(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        stem = w[:-1]
        if _M_OVER_1.match(stem) or _M_IS_1.match(stem) and not _CVC.match(stem):
            w = stem
    if w.endswith("ll") and _M_OVER_1.match(w[:-1]):
        w = w[:-1]
    return w.lower()

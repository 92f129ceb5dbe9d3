"""Alignment of names by characters, and the long form of an abbreviation."""

from __future__ import annotations

from functools import lru_cache

#: What a pair of characters scores.
EQUAL, CASE, BOND, ONE, GAP, MISMATCH = 1.0, 0.8, 0.9, 0.9, -1.0, -1.5


def pair_score(a: str, b: str) -> float:
    if a == b:
        return EQUAL
    if a.lower() == b.lower():
        return CASE
    if {a, b} == {" ", "-"}:
        return BOND
    if {a, b} == {"I", "1"}:
        return ONE
    return MISMATCH


def gap_score(a: str) -> float:
    """A character against a gap: a hyphen is as good as the gap itself, a space nearly."""
    return EQUAL if a == "-" else BOND if a == " " else GAP


def _table(a: str, b: str, restart: float | None = None) -> list[list[float]]:
    down, across = [gap_score(x) for x in a], [gap_score(x) for x in b]
    first = [0.0]
    for g in across:
        first.append(0.0 if restart is not None else first[-1] + g)
    rows = [first]
    for i, x in enumerate(a):
        above = rows[-1]
        row = [0.0 if restart is not None else above[0] + down[i]]
        for j, y in enumerate(b):
            best = max(above[j + 1] + down[i], row[j] + across[j], above[j] + pair_score(x, y))
            row.append(best if restart is None else max(best, restart))
        rows.append(row)
    return rows


def global_score(a: str, b: str) -> float:
    """Score of the best global alignment."""
    return _table(a, b)[-1][-1]


def local_score(a: str, b: str, restart: float = 0.0) -> float:
    """Score of the best local alignment."""
    return max(map(max, _table(a, b, restart)))


def gap_limited_score(a: str, b: str, most: int) -> float | None:
    """The global score, or nothing if its traceback needs more than ``most`` gaps. Ties go to gaps in ``a``, then in ``b``."""
    rows, i, j, gaps = _table(a, b), len(a), len(b), 0
    while i or j:
        if j and abs(rows[i][j] - rows[i][j - 1] - gap_score(b[j - 1])) < 1e-9:
            j, gaps = j - 1, gaps + 1
        elif i and abs(rows[i][j] - rows[i - 1][j] - gap_score(a[i - 1])) < 1e-9:
            i, gaps = i - 1, gaps + 1
        else:
            i, j = i - 1, j - 1
        if gaps > most:
            return None
    return rows[-1][-1]


@lru_cache(maxsize=50_000)
def self_score(a: str) -> float:
    return global_score(a, a)


def sorted_phrase(name: str) -> str:
    """The distinct words of a name in order."""
    return " ".join(sorted(set(name.split(" "))))


def match_score(name: str | None, synonym: str | None, factor: float = 1.5, local: bool = False) -> float | None:
    """Alignment of two names, words sorted, over the longer one's own score; none if one is over ``factor`` times as long."""
    if name is None or synonym is None:
        return None
    a, b = sorted_phrase(name), sorted_phrase(synonym)
    if not a or not b or len(a) > factor * len(b) or len(b) > factor * len(a):
        return None
    whole = self_score(b if len(b) > len(a) else a)
    return (local_score(a, b) if local else global_score(a, b)) / whole


def _long_form(short: str, text: str) -> str | None:
    """Backward match of a short form's letters and digits; the first one must begin a word."""
    at = len(text) - 1
    for k in range(len(short) - 1, -1, -1):
        c = short[k].lower()
        if not c.isalnum():
            continue
        while at >= 0 and (text[at].lower() != c or k == 0 and at > 0 and text[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
        at -= 1
    return text[text.rfind(" ", 0, at + 1) + 1 :].strip()


def best_long_form(short: str | None, text: str | None, bracket: int | None) -> str | None:
    """The longest long form that ends before the bracket at ``bracket`` and spells the short form.

    It is looked for in up to three times as many words as the short form has letters, a final
    s and a hyphen not counted.
    """
    if not short or text is None or bracket is None or bracket < 0:
        return None
    most = 3 * (len(short) - short.endswith("s") - ("-" in short))
    words = text[:bracket].rstrip(" ").split(" ")
    best = None
    for n in range(1, min(most, len(words)) + 1):
        best = _long_form(short, " ".join(words[-n:])) or best
    return best


def greedy_similarity(pairs: list[tuple[int, int, float]]) -> float | None:
    """One-to-one matching of codes by rising distance: 1 minus the mean distance; none if nothing matches.

    Equal distances are taken in the order of the codes.
    """
    left, right, total, n = set(), set(), 0.0, 0
    for a, b, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if d == float("inf"):
            break
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            total += d
            n += 1
    return 1 - total / n if n else None

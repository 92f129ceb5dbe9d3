"""Signature rules of the license scan, in order of priority.

A rule is (label, tier, keyword, pattern). Patterns run over a text's words in lower case,
joined by single spaces with one at each end, so ``x`` in a pattern means the words ' x '.
Tier 0 names a license and version, 1 a license, 2 a notice without a license. The keyword is
a part of every text that the pattern can match; rules whose keyword is absent are never run. It
begins a word of the text, but for those in ``INSIDE``, which may stand inside one.
Patterns of a family and its versions are built from the lists below.
"""

from __future__ import annotations

#: Keywords that may stand inside a word: relicensed, noncommercial, 0bsd.
INSIDE = frozenset(["licen", "commercial", "bsd"])

#: What stands between a license's name and its version.
_V = r"(?:,? ?(?:licen[sc]e )?(?:version |v ?|ver )?)"

#: label, keyword, pattern of the name, versions (each as words)
FAMILIES: list[tuple[str, str, str, tuple[str, ...]]] = [
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1 0", "3 0", "3")),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e", ("2 1", "3 0", "3")),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e", ("2 0", "2")),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1 0", "3 0", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache (?:software )?(?:foundation )?licen[sc]e", ("1 0", "1 1", "2 0", "2")),
    ("apache", "apache", r"apache", ("1 1", "2 0")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", ("1 0",)),
    ("epl", "epl", r"epl", ("1 0", "2 0")),
    ("eupl", "european union", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r"eupl", ("1 1", "1 2")),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("cpl", "common public", r"common public licen[sc]e", ("1 0",)),
    ("cpal", "common public attribution", r"common public attribution licen[sc]e", ("1 0",)),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ()),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1 0", "2 0")),
    ("artistic-perl", "same terms as perl", r"under the same terms as perl(?: itself)?", ()),
    ("boost", "boost", r"boost software licen[sc]e", ("1 0",)),
    ("bsl", "business source", r"business source licen[sc]e", ("1 0", "1 1")),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ()),
    ("isc", "isc licen", r"isc licen[sc]e", ()),
    ("mit", "licen", r"(?:the )?mit(?: expat| x11)? licen[sc]e", ()),
    ("mit", "expat licen", r"expat licen[sc]e", ()),
    ("x11", "x11 licen", r"x11 licen[sc]e", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ()),
    ("wtfpl", "what the", r"do what the [a-z]+ you want to public licen[sc]e", ("1", "2")),
    ("bsd", "bsd", r"(?:new |modified |simplified |original )?bsd(?: style)? licen[sc]e", ()),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|freebsd licen[sc]e)(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?", ()),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?", ()),
    ("afl", "academic free", r"academic free licen[sc]e", ("1 2", "2 0", "2 1", "3 0")),
    ("osl", "open software", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1 0",)),
    ("pddl", "open data commons", r"open data commons public domain dedication(?: and| &)? licen[sc]e", ("1 0",)),
    ("ogl", "open government", r"open government licen[sc]e", ("1 0", "2 0", "3 0")),
    ("psf", "python software", r"python software foundation licen[sc]e", ("2",)),
    ("psf", "python licen", r"python licen[sc]e", ("2 0",)),
    ("php", "php licen", r"php licen[sc]e", ("3 0", "3 01")),
    ("ruby", "ruby licen", r"ruby licen[sc]e", ()),
    ("openssl", "openssl", r"openssl licen[sc]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", ()),
    ("qpl", "public licen", r"q public licen[sc]e", ("1 0",)),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", ()),
    ("sspl", "server side", r"server side public licen[sc]e", ("1",)),
    ("elastic", "elastic", r"elastic licen[sc]e", ("1 0", "2 0")),
    ("vim", "vim licen", r"vim licen[sc]e", ()),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", ()),
    ("zpl", "zope", r"zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("ncsa", "illinois", r"university of illinois ncsa open source licen[sc]e", ()),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1 0",)),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)", ("1", "2")),
    ("latex", "latex project", r"latex project public licen[sc]e", ("1 0", "1 2", "1 3")),
    ("ibm", "ibm public", r"ibm public licen[sc]e", ("1 0",)),
    ("intel", "intel", r"intel open source licen[sc]e", ()),
    ("nasa", "nasa", r"nasa open source agreement", ("1 3",)),
    ("nokia", "nokia", r"nokia open source licen[sc]e", ()),
    ("rpl", "reciprocal", r"reciprocal public licen[sc]e", ("1 1", "1 5")),
    ("sun", "sun public", r"sun public licen[sc]e", ("1 0",)),
    ("cecill", "cecill", r"cecill(?: b| c)?(?: licen[sc]e)?", ("1 0", "1 1", "2 0", "2 1")),
    ("beerware", "beerware", r"beerware licen[sc]e", ()),
    ("json", "json licen", r"json licen[sc]e", ()),
    ("curl", "curl licen", r"curl licen[sc]e", ()),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?", ()),
    ("fair", "fair licen", r"fair licen[sc]e", ()),
    ("eiffel", "eiffel", r"eiffel forum licen[sc]e", ("1", "2")),
]

#: Creative Commons: parts of a name, in short and in long form.
CC_PARTS = (
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Whole phrases: label, tier, keyword, pattern.
PHRASES: list[tuple[str, int, str, str]] = [
    ("mit", 1, "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 1, "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd", 1, "redistribution", r"redistributions? and use in source and binary forms,? with or without modification"),
    ("bsd-3-clause", 1, "endorse or promote", r"be used to endorse or promote products derived from this software"),
    ("apache", 1, "apache", r"apache org licenses license"),
    ("gpl", 1, "free software foundation", r"terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", 1, "free software foundation", r"terms of the gnu lesser general public license as published by the free software foundation"),
    ("zlib", 1, "provided as is", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", 1, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("cc0", 0, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 0, "creative commons", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("public-domain", 1, "public domain", r"(?:in|into|to) the public domain"),
    ("public-domain", 2, "public domain", r"public domain"),
    ("copyright", 2, "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", 2, "copyright", r"(?:this work is )?protected by copyright"),
    ("copyright", 2, "copyright", r"copyrighted material"),
    ("reserved", 2, "rights reserved", r"(?:some|no|all) rights reserved"),
    ("proprietary", 1, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 1, "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)"),
    ("proprietary", 1, "permission", r"without (?:the )?(?:prior |express )?written permission"),
    ("proprietary", 1, "may not be", r"may not be (?:reproduced|copied|republished)"),
    ("no-derivatives", 1, "derivative", r"no derivative works"),
    ("non-commercial", 1, "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("personal-use", 1, "personal use", r"(?:for )?personal use only"),
    ("license", 2, "licen", r"(?:re)?licen[sc]ed under"),
    ("license", 2, "licen", r"released under (?:the |a )?[a-z0-9]+ licen[sc]e"),
    ("license", 2, "licen", r"terms of (?:the|this) licen[sc]e"),
    ("license", 2, "spdx", r"spdx licen[sc]e identifier [a-z0-9]+"),
]


def build_rules() -> list[tuple[str, int, str, str]]:
    """All rules in order: named versions first, then names, then notices."""
    rules: list[tuple[str, int, str, str]] = []
    for label, keyword, name, versions in FAMILIES:
        rules += [(f"{label}-{v.replace(' ', '.')}", 0, keyword, f"{name}{_V}{v}") for v in versions]
        rules.append((label, 1, keyword, name))
        rules += [(f"{label}-{v.replace(' ', '.')}-or-later", 0, keyword, f"{name}{_V}{v} or (?:any |at your option any )?later(?: version)?") for v in versions if label in ("gpl", "lgpl", "agpl")]
    for short, long in CC_PARTS:
        label = "cc-" + short.replace(" ", "-")
        rules += [(f"{label}-{v.replace(' ', '.')}", 0, "cc", f"cc {short} {v}") for v in CC_VERSIONS]
        rules.append((label, 1, "cc", f"cc {short}"))
        rules += [(f"{label}-{v.replace(' ', '.')}", 0, "creative commons", f"creative commons {long}{_V}{v}(?: international| unported| generic)?") for v in CC_VERSIONS]
        rules.append((label, 1, "creative commons", f"creative commons {long}"))
    rules.append(("cc", 1, "creative commons", r"creative commons(?: licen[sc]e)?"))
    rules += PHRASES
    return [r for tier in (0, 1, 2) for r in rules if r[1] == tier]


RULES = build_rules()

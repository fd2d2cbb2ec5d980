"""Licence recognition by sentence rules.

A text is cut into runs, which a full stop, a blank line or an empty comment line ends. The
words of a run are normalised once (case, white space, punctuation), and known licence
sentences are looked for anywhere in it, longer descriptions of a sentence before shorter
ones; the open parts of a description never run over another known sentence. Texts that were
flattened or stand in comments are thus read like others. The identifiers, in the order of
the text, are then matched
with ordered rules: a rule names a sequence of identifiers, some optional; where it
matches, other licence sentences may not lie between its parts, and the identifiers it
uses are spent. What no rule uses is reported as unmatched.

Defined results: null and empty texts have no licence; repeated rows are scanned each for
itself; a licence named several times is reported once, in the order of its first place,
while the spans list every match; an empty table gives no rows; columns of the names
written are replaced. One pass, no shuffle, whole texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vintry.llm.columns import append

_VERB = "(?:licensed|released|distributed|available|terms)"
_LAST_VERB = f"{_VERB} (?:(?!{_VERB} ).)*?"

# Licence sentences, normalised, as patterns. Versions are taken over into
# the identifier where it ends in "#". "^" and "$" stand where a line or a mark must begin
# or end; with ".*" in front or at the end a sentence also holds what lies there.
SENTENCES = (
    ("MIT-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MIT-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ISC-grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC-warranty", r"the software is provided as is and (?:the authors?|isc) disclaims? all warranties .*"),
    ("AsIs-warranty", r"the software is provided as is without warranty of any kind express or implied .*"),
    ("AsIs-liability", r"in no event shall the (authors?|copyright holders?|authors or copyright holders) be liable .*"),
    ("BSD-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSD-source", r"(\d )?redistributions of source code must retain the above copyright notice .*"),
    ("BSD-binary", r"(\d )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("BSD-advert", r"(\d )?all advertising materials mentioning features or use of this software must display .*"),
    ("BSD-endorse", r"(\d )?neither the name of .* may be used to endorse or promote products .*"),
    ("BSD-warranty", r"this software is provided by .* as is and any express or implied warranties .*"),
    ("BSD-liability", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages .*"),
    ("Apache-grant#", r"(?:licensed|licenses|released|available|distributed|published) (?:this file |the work )?(?:to you )?(?:under|by) (?:either (?:of )?)?(?:the )?(?:terms of (?:the )?)?apache (?:software )?(?:licen[cs]e )?(?:version |v ?)?(\d+(?:\.\d+)*)(?: the license)?.*"),
    ("Apache-terms", r"you may not use this file except in compliance with the license"),
    ("Apache-copy", r"you may obtain a copy of the license at.*"),
    ("Apache-warranty", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("Apache-govern", r"see the license for the specific language governing permissions and limitations under the license"),
    ("GPL-later#", r".*(?:terms of|under) the gnu general public license (?:(?!version \d|public license).)*?version (\d+(?:\.\d+)*) .*or (?:at your option )?any later version"),
    ("GPL-ref#", rf".*{_LAST_VERB}the gnu general public license(?: as published by the free software foundation)? version (\d+(?:\.\d+)*)(?: only)?$"),
    ("LGPL-ref#", r".*the gnu (?:lesser|library) general public license .*?version (\d+(?:\.\d+)*).*"),
    ("AGPL-ref#", r".*the gnu affero general public license .*?version (\d+(?:\.\d+)*).*"),
    ("GPL-warranty", r"this program is distributed in the hope that it will be useful but without any warranty .*"),
    ("GPL-copy", r"you should have received a copy of the gnu general public license .*"),
    ("MPL-ref#", r"(?:this source code form is )?(?:subject to|licensed|released|available|distributed) (?:under )?(?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e (?:version |v ?)?(\d+(?:\.\d+)*).*"),
    ("MPL-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("EPL-ref#", rf".*{_LAST_VERB}the eclipse public license (?:version |v ?)?(\d+(?:\.\d+)*).*"),
    ("CC0-ref", r".*(?:under|to|by|with) (?:the )?(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?(?: licen[cs]e)?(?: public domain dedication)?$"),
    ("CC0-ref", r"^(?:cc0|creative commons zero)(?: 1\.0)?(?: universal)?(?: licen[cs]e)?(?: public domain dedication)?$"),
    ("CC-ref#", r"(?:this work is )?(?:licensed|released|available|distributed|published|shared) (?:under|by|with) (?:a |the )?(?:terms of (?:a |the )?)?(?:creative commons |cc )((?:by|attribution)(?: (?:nc|nd|sa|non ?commercial|no ?deriv(?:ative)?s(?: works)?|share ?alike))*(?: licen[cs]e)?(?: version)? \d\.\d).*"),
    ("MIT-ref", r".*(?:licensed|released|available|distributed) under (?:the )?(?:terms of the )?mit licen[cs]e$"),
    ("BSD-ref#", r".*(?:licensed|released|available|distributed) under (?:the )?(?:terms of the )?(?:(\d) clause )?bsd licen[cs]e$"),
    ("ISC-ref", r".*(?:licensed|released|available|distributed) under (?:the )?(?:terms of the )?isc licen[cs]e$"),
    ("Unlicense-grant", r"this is free and unencumbered software released into the public domain"),
    ("Domain-ref", r".*(?:released|placed|dedicated|is) (?:in|into|to) the public domain$"),
    ("SPDX-ref#", r"spdx license identifier [a-z0-9.]+.*"),
    ("Rights-reserved", r".*all rights reserved$"),
)

# Ordered rules. "?" marks a part that may be missing; "{}" takes the version.
RULES = (
    ("MIT", ("MIT-grant", "MIT-notice", "AsIs-warranty?", "AsIs-liability?")),
    ("ISC", ("ISC-grant", "ISC-warranty?", "AsIs-liability?")),
    ("BSD-4-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-advert", "BSD-endorse", "BSD-warranty?", "BSD-liability?")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-warranty?", "BSD-liability?")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-warranty?", "BSD-liability?")),
    ("Apache-{}", ("Apache-grant#", "Apache-terms?", "Apache-copy?", "Apache-warranty?", "Apache-govern?")),
    ("GPL-{}-or-later", ("GPL-later#", "GPL-warranty?", "GPL-copy?")),
    ("GPL-{}", ("GPL-ref#", "GPL-warranty?", "GPL-copy?")),
    ("LGPL-{}", ("LGPL-ref#", "GPL-warranty?", "GPL-copy?")),
    ("AGPL-{}", ("AGPL-ref#", "GPL-warranty?", "GPL-copy?")),
    ("MPL-{}", ("MPL-ref#", "MPL-copy?")),
    ("EPL-{}", ("EPL-ref#",)),
    ("CC0-1.0", ("CC0-ref",)),
    ("CC-{}", ("CC-ref#",)),
    ("MIT", ("MIT-ref",)),
    ("BSD-{}", ("BSD-ref#",)),
    ("ISC", ("ISC-ref",)),
    ("Unlicense", ("Unlicense-grant",)),
    ("Public-domain", ("Domain-ref",)),
    ("{}", ("SPDX-ref#",)),
)

# Every known sentence holds one of these, each within one word, so a text without any of
# them has no licence sentence.
MARKS = (
    "licen", "permi", "redistribut", "warrant", "liable", "advertising", "endorse", "domain",
    "reserved", "copyright", "cc0", "mpl", "commons", "mozilla", "apache",
)
_SPDX = re.compile(r"(?i)identifier\W+([A-Za-z0-9.+-]+)")
_CC_BY = re.compile(r"\bcc\W+by\b")


def _marked(low: str) -> bool:
    return any(mark in low for mark in MARKS) or "cc" in low and bool(_CC_BY.search(low))


# A sentence ends with its mark or its line; the full stop of "v. 2.0" ends none.
_END = re.compile(r"(?<=[.!?;:])(?!(?<=\b[vV]\.)\s*\d)\s+|\n")
_BREAK = re.compile(r"\n\s*\n")
_VERSION_MARK = re.compile(r"\b[vV]\.$")
_WORD = re.compile(r"(?:\w|(?<=\d)\.(?=\d))+")
# Beginnings of known sentences, which the open parts of other sentences do not run over.
_HEADS = "|".join((
    "permission is hereby granted free", "permission to use copy modify",
    "the above copyright notice and this permission notice shall", "the software is provided as is",
    "redistribution and use in source", "redistributions of source code must",
    "redistributions in binary form must", "all advertising materials mentioning",
    "neither the name of", "this software is provided by", "in no event shall",
    "unless required by applicable law", "this program is distributed in the hope",
    "you should have received a copy of the gnu", "this source code form is subject",
    "this is free and unencumbered", "spdx license identifier",
    "gnu (?:(?:lesser|library|affero) )?(?:general )?public license",
))
_CC_PARTS = tuple((short, re.compile(rf"\b(?:{words})\b")) for short, words in (
    ("by", "by|attribution"), ("nc", "nc|non ?commercial"), ("nd", r"nd|no ?deriv\w*"), ("sa", "sa|share ?alike"),
))


def _compiled(pattern: str) -> tuple[re.Pattern, bool, bool]:
    """What must be found of a sentence, and whether it holds what lies before and after."""
    core = pattern.removeprefix(".*")
    lead, trail = core != pattern, core.endswith(".*")
    core = core.removesuffix(".*").rstrip(" ").replace(".*?", ".*").replace(".*", rf"(?:(?!\b(?:{_HEADS})).)*?")
    # Lines are parted by their ends, words by blanks; both may stand between words.
    core = core.replace(" ", "[ \n]")
    return re.compile(rf"(?<![^ \n])(?:{core})(?![^ \n])", re.DOTALL | re.MULTILINE), lead, trail


_KNOWN = tuple((name, *_compiled(pattern)) for name, pattern in SENTENCES)


def sentences(text: str) -> list[tuple[int, int]]:
    """Sentences and lines as places in the text."""
    found, start = [], 0
    for end in _END.finditer(text):
        found.append((start, end.start()))
        start = end.end()
    found.append((start, len(text)))
    return [(a, b) for a, b in found if b > a]


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Pieces that may be one wrapped sentence: up to a full stop, or a line without words."""
    run: list[tuple[int, int]] = []
    for a, b in sentences(text):
        first = _WORD.search(text, a, b)
        if run:
            end = run[-1][1]
            stop = text[end - 1] in ".!?" and not (
                first and first[0][0].isdigit() and _VERSION_MARK.search(text[max(0, end - 3) : end])
            )
            if stop or _BREAK.search(text, end, a):
                yield run
                run = []
        if first:
            run.append((a, b))
        elif run and text[a - 1] == "\n" and text[b : b + 1] in ("", "\n"):
            yield run
            run = []
    if run:
        yield run


def _identifier(name: str, found: re.Match, text: str, place: int) -> str:
    """The identifier of a known sentence, with its version after a colon."""
    if name == "SPDX-ref#":
        # Such identifiers keep their case and signs.
        return f"{name}:{_SPDX.search(text, place)[1]}"
    if not name.endswith("#"):
        return name
    version = " ".join(next((g for g in found.groups() if g), "").split())
    if name == "CC-ref#":
        parts = [short for short, words in _CC_PARTS if words.search(version)]
        version = " ".join([*parts, version.rsplit(" ", 1)[-1]])
    return f"{name}:{version}"


def _identified_in(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences of a run."""
    plain, at, size = [], [], 0  # the run's text, and where its words begin in it
    places: list[tuple[int, int]] = []  # of the words in the text, with their piece's edges
    heads: list[int] = []  # the first word of each word's piece
    for a, b in run:
        words = list(_WORD.finditer(text, a, b))
        heads += [len(places)] * len(words)
        for k, word in enumerate(words):
            low = word[0].lower()
            plain.append(low + ("\n" if k + 1 == len(words) else " "))
            at.append(size)
            size += len(plain[-1])
            places.append((word.start() if k else a, word.end() if k + 1 < len(words) else b))
    joined = "".join(plain)[:-1]
    taken = bytearray(size)
    known = []
    for name, pattern, lead, trail in _KNOWN:
        for found in pattern.finditer(joined):
            start, end = found.span()
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                first, last = bisect_right(at, start) - 1, bisect_left(at, end) - 1
                known.append((first, last, lead, trail, _identifier(name, found, text, places[first][0])))
    known.sort()
    out, free = [], 0
    for k, (first, last, lead, trail, name) in enumerate(known):
        if trail:
            last = max(last, (heads[known[k + 1][0]] if k + 1 < len(known) else len(places)) - 1)
        out.append((places[free if lead else first][0], places[last][1], name))
        free = last + 1
    return out


def identified(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of all known sentences, in the order of the text."""
    # Lower-casing may move places in other scripts, so places are those of the text itself.
    if not _marked(text.lower()):
        return []
    return [
        found for run in _runs(text) if _marked(text[run[0][0] : run[-1][1]].lower())
        for found in _identified_in(text, run)
    ]


def _matches(parts: tuple[str, ...], names: list[str], at: int) -> tuple[int, str] | None:
    """Where a rule's sequence ends if it begins at a place, and the version it takes."""
    version = ""
    place = at
    for part in parts:
        wanted = part.removesuffix("?")
        name, _, number = (names[place] if place < len(names) else "").partition(":")
        if name == wanted:
            version = number or version
            place += 1
        elif not part.endswith("?"):
            return None
    return (place, version) if place > at else None


def licences(found: list[tuple[int, int, str]]) -> tuple[list[tuple[str, int, int]], int]:
    """(licence, start, end) of every match by the ordered rules, and the unmatched rest."""
    names = [name for _, _, name in found]
    spent: set[int] = set()
    out = []
    for licence, parts in RULES:
        at = 0
        while at < len(names):
            got = None if at in spent else _matches(parts, names, at)
            if got and not spent.intersection(range(at, got[0])):
                end, version = got
                spent.update(range(at, end))
                label = "-".join(version.upper().split()) if licence == "CC-{}" else version
                out.append((licence.replace("{}", label), found[at][0], found[end - 1][1]))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda x: (x[1], x[2])), len(names) - len(spent)


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add ``licences`` (names), ``licence_spans`` (name, start, end), ``sentence_ids`` and
    ``unmatched`` (known sentences no rule used). Places count characters."""
    span = pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scanned(texts: pa.Array) -> pa.Array:
        names, spans, ids, rest = [], [], [], []
        for text in texts.to_pylist():
            found = identified(text) if text else []
            matched, unmatched = licences(found)
            names.append(list(dict.fromkeys(m[0] for m in matched)))
            spans.append([dict(zip(("licence", "start", "end"), m)) for m in matched])
            ids.append([name for _, _, name in found])
            rest.append(unmatched)
        return pa.StructArray.from_arrays(
            [
                pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span)),
                pa.array(ids, pa.list_(pa.string())), pa.array(rest, pa.int32()),
            ],
            ["licences", "licence_spans", "sentence_ids", "unmatched"],
        )

    return append(docs, scanned, [text_column], (
        "licences array<string>, licence_spans array<struct<licence: string, start: bigint, end: bigint>>, "
        "sentence_ids array<string>, unmatched int"
    ))

"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map

COVERAGE = 0.8  # share of a template's words that an occurrence must have in order
#: Notices as their licenses word them.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                  "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                  "either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
           "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
               "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
_GNU = {"gpl": "General", "lgpl": "Lesser General", "agpl": "Affero General"}
for _name, _version in (("gpl", "2"), ("lgpl", "3"), ("lgpl", "2.1"), ("agpl", "3")):
    _full = _version if "." in _version else f"{_version}.0"
    TEMPLATES[f"{_name}-{_full}-line" if _name == "gpl" or "." in _version else f"{_name}-line"] = f"This work is licensed under the GNU {_GNU[_name]} Public License, version {_version}."
    TEMPLATES[f"{_name}-{_full}"] = TEMPLATES["gpl-3.0"].replace("General", _GNU[_name]).replace("version 3", f"version {_version}")
for _name, _version, _date in (("gpl", "2", "June 1991"), ("gpl", "3", "29 June 2007"), ("lgpl", "2.1", "February 1999"), ("lgpl", "3", "29 June 2007"), ("agpl", "3", "19 November 2007")):
    TEMPLATES[f"{_name}-{_version if '.' in _version else _version + '.0'}-text"] = (
        f"GNU {_GNU[_name]} Public License Version {_version}, {_date} Copyright (C) Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.")
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    TEMPLATES.setdefault(f"cc-{_kind.lower()}-line", f"Licensed under CC {_kind} 4.0.")
    _names = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    TEMPLATES[f"cc-{_kind.lower()}"] = f"This work is licensed under a Creative Commons {'-'.join(_names[k] for k in _kind.split('-'))} 4.0 International License."
TEMPLATES |= {
    "cc0-line": "Licensed under CC0 1.0.",
    "cc0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work "
           "worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "bsd-line": "Released under the BSD License.",
    "isc-line": "Released under the ISC License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
               "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, "
                    "contributes to the creation of, or owns Covered Software.",
    "epl-2.0-line": "Licensed under the Eclipse Public License, Version 2.0.",
    "epl-1.0-line": "Licensed under the Eclipse Public License, Version 1.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
               "https://www.eclipse.org/legal/epl-2.0/",
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
               "distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0-text": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). "
                    "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
                       "DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined "
                       "by Sections 1 through 9 of this document.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                 "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
                 "any means.",
    "bsd-3-clause": TEMPLATES["bsd"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission.",
}
#: Words that tell a license from others: an occurrence has all that its template has, and its version.
NAMES = frozenset("mit apache bsd isc mpl mozilla eclipse gpl lgpl agpl general lesser affero creative commons cc cc0 nc sa nd attribution noncommercial "
                  "sharealike noderivatives unencumbered neither".split())
_VERSION = re.compile(r"\b(?:version |license |v\. |(?=v\d))(?:- v )?(v?\d+(?:\.\d+)?)(?![\d/])", re.I)
LONG = 20  # words from which a template is no single line
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _unique(words: list[str], lo: int, hi: int) -> dict[str, int]:
    """Places of the words that occur once in words[lo:hi]."""
    at = {}
    for i in range(lo, hi):
        at[words[i]] = -1 if words[i] in at else i
    return {w: i for w, i in at.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (template place, text place) with rising text places, by piles of patience."""
    tops, ends, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[pile], ends[pile] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words of a (template) and b (text), rising in both.

    Equal ends are matched first; words that occur once on both sides anchor what lies between, and the gaps
    between anchors are aligned in the same way, with words that are unique within the gap. In a gap without such a
    word, each word takes the next equal one.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        left, right = _unique(a, alo, ahi), _unique(b, blo, bhi)
        anchors = _rising(sorted((i, right[w]) for w, i in left.items() if w in right))
        if anchors:
            out += anchors
            edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
        else:
            at = blo
            for i in range(alo, ahi):
                found = next((j for j in range(at, bhi) if b[j] == a[i]), None)
                if found is not None:
                    out.append((i, found))
                    at = found + 1
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        numbers = {w for m in _VERSION.finditer(text) for w in words_of(m[1])}
        if len(self.words) <= LONG:
            self.needs = {i for i, w in enumerate(self.words) if w in NAMES or w == "by" or not w.isalpha()}
        else:  # a name that a long template repeats is needed once
            self.needs = {self.words.index(w) for w in self.words if w in NAMES or w in numbers}
        self.must = {self.words[i] for i in self.needs}
        self.least = -int(-COVERAGE * len(self.words) // 1)  # words that an occurrence needs
        # An occurrence lacks at most `spare` of the template's words, so it has one of any spare + 1: the longest are the rarest.
        spare, rare = len(self.words) - self.least, set()
        for w in sorted(set(self.words), key=lambda w: (-len(w), w)):
            rare.add(w)
            if sum(x in rare for x in self.words) > spare:
                break
        self.rare = rare

    def occurrences(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """(first word, end, words aligned) of the occurrences in a text. Each is looked for around a rare word.

        The text around a rare word is cut where that word would stand in the template, with room for words put in.
        """
        m, out, done = len(self.words), [], -1
        for at in sorted({i for w in self.rare for i in places.get(w, ())}):
            if at < done:
                continue
            best = None
            for where in (i for i, w in enumerate(self.words) if w == words[at]):
                lo = max(done, at - where - m // 4 - 1, 0)
                hi = min(len(words), at - where + m + m // 4 + 1)
                pairs = align(self.words, words[lo:hi])
                if len(pairs) >= self.least and self.needs <= {i for i, _ in pairs} and (best is None or len(pairs) > best[2]):
                    best = (lo + pairs[0][1], lo + pairs[-1][1] + 1, len(pairs))
            if best:
                out.append(best)
                done = best[1]
        return out


def scan(text: str, templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """(license, first word, end, coverage) of all occurrences in a text, by place and name.

    Of occurrences that overlap, the one with the most words of its template stays, then the best covered.
    """
    lower = text.lower()
    likely = [t for t in templates if all(w in lower for w in t.must) and any(w in lower for w in t.rare)]
    if not likely:
        return []
    words = _WORD.findall(lower)
    wanted, places = set().union(*(t.rare for t in likely)), {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found = [(n, n / len(t.words), t.name, s, e) for t in likely for s, e, n in t.occurrences(words, places)]
    starts, out = [], []
    for _, share, name, s, e in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        at = bisect_left(starts, s)
        if (at == len(out) or e <= starts[at]) and (not at or out[at - 1][2] <= s):
            starts.insert(at, s)
            out.insert(at, (name, s, e, share))
    return out


def _scan(templates: dict[str, str]):
    def run(batches):
        known = [Template(name, text) for name, text in templates.items()]
        for batch in batches:
            out = {"ids": [], "spans": [], "best": [], "n": []}
            for text in batch["text"].to_pylist():
                found = scan(text or "", known)
                out["ids"].append(",".join(sorted({f[0] for f in found})))
                out["spans"].append(",".join(f"{n}:{s}:{e}" for n, s, e, _ in found))
                out["best"].append(max((round(f[3], 6) for f in found), default=0.0))
                out["n"].append(len(found))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_licenses": pa.array(out["n"], pa.int64()), "licenses": pa.array(out["ids"], pa.string()),
                                              "coverage": pa.array(out["best"], pa.float64()), "spans": pa.array(out["spans"], pa.string())})
    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses, coverage, spans for every row of `docs` (doc_id, text; other columns are ignored).

    An occurrence of a template has at least COVERAGE of its words in order, aligned around one of its rare words, and all words that
    tell the license from others (NAMES, versions). Occurrences do not overlap: the longer one stays. `licenses` are the
    names found, sorted; `spans` name:first word:end by place; `coverage` the largest share, 0 without any. Null and empty texts have
    none. Several and repeated occurrences each count; repeated rows are scanned each, a null doc_id stays null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, _scan(templates or TEMPLATES), "doc_id long, n_licenses long, licenses string, coverage double, spans string")

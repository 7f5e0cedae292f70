"""Licences of files and repositories (problem 3): nearest template by tokens.

The templates are licence names, the headers by which a work states a licence
(`released under ...`) and passages of the licence texts themselves.  Each kind
stands in metric trees, one for each length in tokens, under the token edit
distance (bit-parallel); a query visits the lengths it can reach, the triangle
inequality prunes them, and the nearest template counts if its difference is
within the bound and no other licence is as near.  Nothing is looked up beside
the trees; an exact match is a difference of 0 found there.

Candidate passages are not found by their wording: every place of a word that
tells a licence name apart is one, and every place where a passage of a licence
text may begin.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import broadcast_if_small

#: Names by which the licences of the reference list are stated.
NAMES = {
    "MIT": ["MIT", "MIT License", "Expat", "Expat License", "Expat (MIT) License", "MIT terms", "MIT/X11 License"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "apache2", "ASL 2.0", "Apache License 2.0", "Apache License, Version 2.0", "version 2.0 of the Apache License", "Apache 2"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2 clause", "bsd2", "Simplified BSD", "Simplified BSD License", "FreeBSD License", "2-clause BSD License", "two-clause BSD License", "BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3 clause", "bsd3", "New BSD", "New BSD License", "Modified BSD", "Modified BSD License", "3-clause BSD License", "three-clause BSD License", "BSD 3-Clause License"],
    "ISC": ["ISC", "ISC License", "ISC License terms"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "mpl2", "MPLv2", "MPL version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL 2", "GPL v2", "GPLv2", "gpl2", "GNU GPL 2", "GNU GPLv2", "GNU GPL v2", "GNU GPL, version 2", "version 2 of the GNU General Public License", "GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GPL-3.0", "GPL 3", "GPL v3", "GPLv3", "gpl3", "GNU GPL 3", "GNU GPLv3", "GNU GPL v3", "GNU GPL, version 3", "version 3 of the GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL v3", "LGPLv3", "lgpl3", "GNU LGPLv3", "GNU Lesser GPL v3", "LGPL version 3", "GNU Lesser General Public License, version 3", "version 3 of the GNU Lesser General Public License", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["AGPL-3.0", "AGPL v3", "AGPLv3", "agpl3", "GNU AGPLv3", "GNU Affero GPL v3", "AGPL version 3", "GNU Affero General Public License, version 3", "version 3 of the GNU Affero General Public License", "GNU Affero General Public License v3.0"],
    "Unlicense": ["Unlicense", "Unlicense (public domain)"],
    "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 License"],
    "CC0-1.0": ["CC0-1.0", "CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons Zero 1.0", "Creative Commons Zero dedication (CC0 1.0)", "Creative Commons Zero v1.0 Universal"],
}
#: How works speak of their licence, before its name; alternatives are multiplied out.
HEADERS = [
    "spdx-license-identifier :",
    "license :",
    "dual licensed :",
    "dual-licensed :",
    "dual licensed under",
    "dual-licensed under",
    "{licensed|released|published|distributed|provided|offered|shared|available|covered|governed} {under|by}{| terms of| conditions of}",
    "subject to{| terms of| conditions of}",
    "{use|copy|share|distribute|redistribute|modify} {it|this work|this file|this software|this program|this skill} {under|as}{| terms of}",
    "{may|can} be {used|shared|copied|modified|distributed|redistributed} under{| terms of}",
    "{steht|stehen} unter {der|den} {lizenz|bedingungen der}",
    "{lizenziert|veröffentlicht} unter{| der lizenz}",
    "{publicado|distribuido|licenciado} bajo{| la licencia| los términos de}",
    "{distribué|distribuée|publié|publiée} sous{| license| les termes de}",
]
#: Passages of the licence texts; one that several licences hold
#: speaks for each of them.
PASSAGES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
]
#: A part of a passage that is as long as this counts, if it is its beginning.
OPENING = 12
#: A sentence ends here; markup and comment ends too.
_END = re.compile(r"\.(?=\s|$)|[;\n\r]|-->|\*/|<|$")
_BEGIN = re.compile(r".*(?:[.!?](?=\s)|[;\n\r<>])", re.S)
_COMMENT = re.compile(r"[ \t]*(#|//|\*|%|--|;)+[ \t]*")
_LATER = re.compile(r"[\s,-]*(?:\bonly\b|\bor[\s-]+(?:\(at your option\)[\s-]+)?(?:any[\s-]+)?later(?:[\s-]+version)?\b)|(?<=\d)\+", re.I)
_EITHER = re.compile(r"\s*,?\s*\bor\b\s*,?\s*(?:at your option\s*,?)?\s*|/|\s*\|\|\s*", re.I)
_TOKEN = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_SKIP = frozenset(("the", "a", "an", "of", "under", "v", "version", "and"))
_HEADER_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|:")
_ARTICLES = frozenset(("the", "a", "an", "and", "either", "cette", "dieser"))
_NOT = frozenset(("not", "never", "no", "nicht", "kein", "keine", "pas", "non", "isn", "aren"))
#: Words of names that many other texts hold; a name is told by its other words.
_COMMON = frozenset("license public general new modified simplified clause two three terms lesser affero free domain zero dedication universal international attribution creative commons by cc x version".split())


def tokens(text: str) -> tuple[str, ...]:
    """Lower-case words and numbers; British and American spelling are one, `2`
    and `2.0` too, also `GPLv3` and `GPL v3`; articles do not count."""
    out = []
    for t in _TOKEN.findall(text.lower()):
        t = re.sub(r"(?:\.0)+$", "", t)
        if t in ("licence", "licenses", "licences"):
            t = "license"
        elif t in ("gplv", "lgplv", "agplv", "mplv"):
            t = t[:-1]
        if t not in _SKIP:
            out.append(t)
    return tuple(out)


def header_tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end); articles do not count, a colon does."""
    out = []
    for m in _HEADER_TOKEN.finditer(text):
        t = m[0].lower()
        t = {"licence": "license", "licenced": "licensed", "dual-licenced": "dual-licensed"}.get(t, t)
        if t not in _ARTICLES:
            out.append((t, m.start(), m.end()))
    return out


def multiplied(pattern: str) -> list[str]:
    """`{a|b} c` as `a c` and `b c`."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [" ".join(pattern.split())]
    return [x for alt in m[1].split("|") for x in multiplied(pattern[: m.start()] + alt + pattern[m.end() :])]


def token_distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Bit-parallel edit distance of token sequences."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for t in b:
        eq = at.get(t, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (~(x | up) & mask), up & x
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        up, down = fall | (~((eq | down) | rise) & mask), rise & (eq | down)
    return score


class MetricTrees:
    """Token sequences by length, each length a metric tree; a sequence may
    stand for several labels."""

    def __init__(self):
        self.labels: dict[tuple[str, ...], set[str]] = {}
        self.trees: dict[int, list] = {}

    def add(self, t: tuple[str, ...], label: str) -> None:
        if t in self.labels:
            self.labels[t].add(label)
            return
        self.labels[t] = {label}
        root = self.trees.setdefault(len(t), [t, {}])
        while root[0] != t:
            root = root[1].setdefault(token_distance(root[0], t), [t, {}])

    def within(self, q: tuple[str, ...], bound: int) -> Iterator[tuple[int, tuple[str, ...]]]:
        for n in range(len(q) - bound, len(q) + bound + 1):
            todo = [self.trees[n]] if n in self.trees else []
            while todo:
                t, children = todo.pop()
                d = token_distance(t, q)
                if d <= bound:
                    yield d, t
                todo.extend(c for e, c in children.items() if d - bound <= e <= d + bound)

    def nearest(self, q: tuple[str, ...], bound: int) -> tuple[int, set[str]] | None:
        """Distance and labels of the nearest; numbers must be the same, as they
        tell versions apart.  Smaller bounds are tried first: they visit less."""
        numbers = sorted(x for x in q if x[0].isdigit())
        for k in sorted({0, bound}):
            found = [(d, t) for d, t in self.within(q, k) if d == 0 or sorted(x for x in t if x[0].isdigit()) == numbers]
            if found:
                least = min(d for d, _ in found)
                return least, set().union(*(self.labels[t] for d, t in found if d == least))
        return None


class Templates:
    """The metric trees of names, headers and passages.

    `decided` counts what the trees found by its distance."""

    def __init__(self, names: dict[str, list[str]]):
        self.names, self.headers, self.passages = MetricTrees(), MetricTrees(), MetricTrees()
        self.decided: Counter = Counter()
        for lic in names:
            for n in [lic, *names[lic]]:
                if t := tokens(n):
                    self.names.add(t, lic)
        for h in HEADERS:
            for x in multiplied(h):
                self.headers.add(tuple(w for w, _, _ in header_tokens(x)), "header")
        words = {w for t in self.names.labels for w in t if w.isalpha() and w not in _COMMON} | {"creative", "cc"}
        self.telling = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")(?:v?\d|(?![^\W\d_]))", re.I)
        self.starts: dict[tuple[str, ...], set[int]] = {}
        self.rare: set[str] = set()
        for lics, text in PASSAGES:
            t = tokens(text)
            for n in {OPENING, 2 * OPENING, len(t)}:
                for lic in lics.split():
                    if n <= len(t) and lic in names:
                        self.passages.add(t[:n], lic)
                        for pair in (t[:2], t[1:3], (t[0], t[2])):  # one of these stays if a word differs
                            self.starts.setdefault(pair, set()).add(n)
            self.rare.add(max(t[:OPENING], key=len))
        self._seen: dict[tuple[str, bool], str | None] = {}
        self._stating: dict[tuple[str, ...], bool] = {}

    def nearest(self, text: str, lead: bool = False) -> str | None:
        """The licence named, with at most one token of four different; else the
        longest beginning of the text that is a name (`lead`: a single word too)."""
        key = (text, lead)
        if key not in self._seen:
            if len(self._seen) > 50_000:
                self._seen.clear()
            self._seen[key] = self._nearest(tokens(_LATER.sub(" ", text)), lead)
        return self._seen[key]

    def _nearest(self, q: tuple[str, ...], lead: bool) -> str | None:
        longest = max(self.names.trees)
        slack = longest // 4 + 1
        tries = [(q, len(q) // 4)] if 0 < len(q) <= longest + slack else []
        tries += [(q[:n], 0) for n in range(min(len(q) - 1, longest), 0, -1) if n > 1 or lead]
        tries += [(q[:n], n // 4) for n in range(min(len(q) - 1, longest + slack), 3, -1)]
        for t, bound in tries:
            got = self.names.nearest(t, bound)
            if got and len(got[1]) == 1:
                self.decided[got[0]] += 1
                return next(iter(got[1]))
        return None

    def states(self, before: list[str]) -> bool:
        """Whether the words before a name end with a header, with at most one
        word of four different but not its last, and no negation in front."""
        for n in range(min(len(before), max(self.headers.trees) + 1), 0, -1):
            t = tuple(before[-n:])
            if t not in self._stating:
                if len(self._stating) > 50_000:
                    self._stating.clear()
                self._stating[t] = any(h[-1] == t[-1] for _, h in self.headers.within(t, n // 4))
            if self._stating[t]:
                return not _NOT & set(before[-n - 1 : -n]) and not _NOT & set(t)
        return False

    def texts(self, low: str) -> set[str]:
        """Licences whose own text stands in a lower-case text."""
        if not any(w in low for w in self.rare):
            return set()
        q = tokens(low)
        found: list[set[str]] = []
        for i, pair in enumerate(zip(q, q[1:])):
            for n in sorted(self.starts.get(pair, ()), reverse=True):
                if i + n <= len(q) and (got := self.passages.nearest(q[i : i + n], n // 4)):
                    found.append(got[1])
                    self.decided[got[0]] += 1
                    break
        sure = {next(iter(x)) for x in found if len(x) == 1}
        if "BSD-3-Clause" in sure:  # it holds the shorter text
            sure.discard("BSD-2-Clause")
        return sure


def expression(text: str | None, names: Templates, lead: bool = False) -> str | None:
    """One statement: an id, or ids of a choice sorted and joined by ` OR `."""
    if not text:
        return None
    text = re.sub(r"\beither of\b", " ", text.strip().strip("\"'`()[]{} \t"), flags=re.I)
    bare = _LATER.sub(" ", text)
    whole = names.nearest(bare, lead)
    parts = [p for p in _EITHER.split(bare) if p.strip(" ()\"'")]
    if len(parts) > 1:
        each: list[str] = []
        for p in parts:  # the choice, then more of the sentence
            got = names.nearest(p.strip(" ()\"'"), lead)
            if not got:
                break
            each.append(got)
        if len(each) == len(parts) or len(each) > 1 and lead:
            return " OR ".join(sorted(set(each)))
    return whole


def file_statements(text: str | None, names: Templates) -> set[str]:
    """Statements a file makes of itself; names without a header do not count.

    A name that is broken over two comment lines is joined."""
    out: set[str] = set()
    if not text:
        return out
    if "&" in text:
        text = html.unescape(html.unescape(text))
    out |= names.texts(text.lower())
    if "." in text:
        text = re.sub(r"\bv\.\s+(?=\d)", "v ", text)
    done = -1
    for m in names.telling.finditer(text):
        if m.start() < done:
            continue
        begin = max(0, m.start() - 300)  # longer than any header and name
        if b := _BEGIN.match(text, begin, m.start()):
            begin = b.end()
        words = header_tokens(text[begin : m.start()])
        for k in range(len(words), max(0, len(words) - 7), -1):
            before = [w for w, _, _ in words[:k]]
            if not names.states(before):
                continue
            at = begin + words[k - 1][2]
            end = _END.search(text, m.end()).start()
            got = expression(text[at:end], names, True)
            if (not got or " OR " not in got and _EITHER.search(text, at, end)) and (lead := _COMMENT.match(text[text.rfind("\n", 0, at) + 1 : end])) and text.startswith(lead[0], end + 1):
                more = end + 1 + len(lead[0])
                got = expression(text[at:end] + " " + text[more : _END.search(text, more).start()], names, True) or got
            if got:
                out.add(got)
                done = end if " OR " in got else -1
                break
    return out


def field_statements(value: str | None, names: Templates) -> set[str]:
    """Statements of a licence field: bare text, JSON text, or an object with
    type, license_type, value or license_file.head."""
    if value is None or not value.strip():
        return set()
    try:
        o = json.loads(value)
    except ValueError:
        o = value
    out: set[str] = set()
    todo = [o]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x[:1] in "{[" and x is not value:
                try:
                    todo.append(json.loads(x))
                    continue
                except ValueError:
                    pass
            got = expression(x, names)
            out |= {got} if got else file_statements(x, names)
        elif isinstance(x, list):
            todo.extend(x)
        elif isinstance(x, dict):
            todo.extend(x[k] for k in ("type", "license_type", "spdx_id", "id", "name", "value") if x.get(k))
            head = x.get("license_file")
            if isinstance(head, dict) and isinstance(head.get("head"), str):
                got = file_statements(head["head"], names)
                whole = expression(head["head"], names) if not got else None  # the title of a licence file
                out |= got or ({whole} if whole else set())
    return out


def _stated(rows: DataFrame, texts: list[str], fields: list[str], keep: list[str], known: list[str]) -> DataFrame:
    """keep + `own`, the sorted distinct statements of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Templates({k: NAMES.get(k, []) for k in known})
        for b in batches:
            own = [set() for _ in range(len(b))]
            for c in texts:
                for o, t in zip(own, b[c]):
                    o |= file_statements(t, names)
            for c in fields:
                for o, t in zip(own, b[c]):
                    o |= field_statements(t, names)
            yield b[keep].assign(own=[sorted(o) for o in own])

    types = dict(rows.dtypes)
    return rows.select(*keep, *texts, *fields).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", own array<string>")


def licences(versions: DataFrame, repositories: DataFrame, reference: DataFrame) -> DataFrame:
    """(scope, entity, license, status) of each file and each repository.

    versions(id, source_repo, license, raw_content), repositories(id, license),
    reference(license_id).  Null, blank, broken and very long values state
    nothing; a file whose repository is not in the table has only its own
    statements.  Of repositories with the same id each gets its row, and a file
    takes the statement if one of them is alone `stated`."""
    known = sorted(r[0] for r in reference.select("license_id").distinct().collect() if r[0] in NAMES)  # at most as many as NAMES has
    files = _stated(versions.select(F.col("id").cast("string").alias("entity"), F.col("source_repo").alias("repo"), "license", "raw_content"), ["raw_content"], ["license"], ["entity", "repo"], known)
    repos = _stated(repositories.select(F.col("id").alias("entity"), "license"), [], ["license"], ["entity"], known)
    n = F.size("own")
    status = F.when(n == 0, "unknown").when(n == 1, "stated").otherwise("conflict")
    name = F.when(F.size("all") == 0, F.lit("unknown")).otherwise(F.array_join("all", " | "))
    of_repo = repos.where(n == 1).groupBy(F.col("entity").alias("repo")).agg(F.min(F.col("own")[0]).alias("theirs"))
    every = files.join(broadcast_if_small(of_repo), "repo", "left").withColumn("all", F.array_sort(F.array_distinct(F.concat("own", F.when(F.col("theirs").isNull(), F.array().cast("array<string>")).otherwise(F.array("theirs"))))))
    k = F.size("all")
    file_status = F.when(k == 0, "unknown").when(k > 1, "conflict").when(n > 0, "stated").otherwise("inherited")
    return every.select(F.lit("file").alias("scope"), "entity", name.alias("license"), file_status.alias("status")).unionByName(
        repos.withColumn("all", F.col("own")).select(F.lit("repository").alias("scope"), "entity", name.alias("license"), status.alias("status"))
    )

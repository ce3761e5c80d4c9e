"""License detection by ordered signature rules.

Texts are normalised to lower-case words with single spaces; rules are regular
expressions over that form. An Aho-Corasick pass finds the keywords a text
has, and only rules whose keyword is there run. Detections overlap ("apache
license version 2" holds "apache license"): they are settled by priority, then
length, then place; a detection that lies inside a kept one is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame

from .common import by_text

#: Phrases and labels that are always reported (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licenses: label, name as words (a pattern), versions. Each makes rules by the FORMS below.
FAMILIES = (
    ("mit", "mit|expat|x11", ()),
    ("apache", "apache(?: software)?", ("2 0", "1 1", "1 0", "2")),
    ("gpl", "(?:gnu )?(?:general public|gpl)", ("3 0", "2 0", "1 0", "3", "2", "1")),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public|lgpl)", ("3 0", "2 1", "2 0", "3", "2")),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", ("3 0", "1 0", "3")),
    ("gfdl", "(?:gnu )?(?:free documentation|fdl)", ("1 3", "1 2", "1 1")),
    ("bsd", "(?:2 clause |3 clause |4 clause |new |modified |simplified )?(?:bsd|berkeley software distribution)", ("2 clause", "3 clause", "4 clause")),
    ("mpl", "mozilla public|mpl", ("2 0", "1 1", "1 0", "2")),
    ("epl", "eclipse public|epl", ("2 0", "1 0")),
    ("cddl", "common development and distribution|cddl", ("1 1", "1 0")),
    ("cpl", "common public", ("1 0",)),
    ("eupl", "european union public|eupl", ("1 2", "1 1", "1 0")),
    ("osl", "open software|osl", ("3 0", "2 1", "2 0", "1 0")),
    ("afl", "academic free|afl", ("3 0", "2 1", "2 0", "1 2")),
    ("artistic", "(?:perl )?artistic", ("2 0", "1 0")),
    ("bsl", "boost software", ("1 0",)),
    ("isc", "isc|internet systems consortium", ()),
    ("zlib", "zlib|zlib libpng|libpng", ()),
    ("unlicense", "unlicense|the unlicense", ()),
    ("wtfpl", "wtfpl|do what the fuck you want to public", ("2",)),
    ("ofl", "(?:sil )?open font|ofl", ("1 1", "1 0")),
    ("python", "python software foundation|psf", ("2", "2 0")),
    ("php", "php", ("3 0", "3 01")),
    ("postgresql", "postgresql", ()),
    ("openssl", "openssl", ()),
    ("ms-pl", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", ()),
    ("upl", "universal permissive", ("1 0",)),
    ("ncsa", "university of illinois ncsa|ncsa", ()),
    ("blueoak", "blue oak model", ("1 0 0",)),
    ("mulan", "mulan (?:permissive software|psl)", ("2", "1")),
    ("cecill", "cecill", ("2 1", "2 0")),
    ("odbl", "open (?:data commons )?(?:open )?database|odbl", ("1 0",)),
    ("odc-by", "open data commons attribution", ("1 0",)),
    ("cc0", "cc0|creative commons zero", ("1 0",)),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", ("4 0", "3 0", "2 5", "2 0")),
    ("cc-by", "cc by|creative commons attribution", ("4 0", "3 0", "2 5", "2 0")),
    ("elastic", "elastic", ("2 0", "2")),
    ("sspl", "server side public|sspl", ("1",)),
    ("busl", "business source|busl", ("1 1",)),
    ("llama", "llama (?:2|3) community", ()),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?", ()),
)

#: Signatures: sentences of license texts and notices, by label. Each line is a rule of its own, in the folded form of a text
#: (lower case, single spaces); | stands for alternatives.
SIGNATURES = {
    "mit": """
        permission is hereby granted free of charge to any person obtaining a copy
        to deal in the software without restriction including without limitation the rights
        the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies
        in no event shall the (?:authors|x consortium) or copyright holders? be liable for any claim damages or other liability
        this (?:software|project|code|library|package|module) is (?:released|licensed|distributed) under mit
        mit licensed
        see the mit licen[sc]e file""",
    "bsd": """
        redistribution and use in source and binary forms with or without modification
        redistributions of source code must retain the above copyright notice
        redistributions in binary form must reproduce the above copyright notice
        this software is provided by the (?:copyright holders?|regents|author|project) (?:and contributors )?as is
        (?:revised|two clause|three clause) bsd
        bsd licensed
        bsd style licen[sc]e""",
    "bsd-3-clause": """
        neither the names? of .{1,80} nor the names of (?:its|their|any) contributors may be used to endorse
        may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission""",
    "bsd-4-clause": """
        all advertising materials mentioning features or use of this software must display the following acknowledge?ment""",
    "bsd-0-clause": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided""",
    "isc": """
        permission to use copy modify and or distribute this software for any purpose
        permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
        the author disclaims all warranties with regard to this software""",
    "apache-2": """
        you may not use this file except in compliance with the license
        www apache org licenses license 2 0
        each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
        licensed to the apache software foundation asf under one or more contributor license agreements
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis""",
    "gpl": """
        free software you can redistribute it and or modify it under the terms of the gnu general public
        everyone is permitted to copy and distribute verbatim copies of this license document
        you should have received a copy of the gnu general public license along with
        the gnu general public license is a free copyleft license
        this program comes with absolutely no warranty
        without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
        www gnu org licenses gpl""",
    "gpl-2": """
        either version 2 of the license or (?:at your option )?any later version
        gnu general public license version 2 june 1991
        published by the free software foundation version 2""",
    "gpl-3": """
        either version 3 of the license or (?:at your option )?any later version
        gnu general public license version 3 29 june 2007
        www gnu org licenses gpl 3 0""",
    "lgpl": """
        free software you can redistribute it and or modify it under the terms of the gnu lesser general public
        you should have received a copy of the gnu (?:lesser|library) general public license along with
        a work that uses the library
        www gnu org licenses lgpl""",
    "lgpl-2.1": """
        either version 2 1 of the license or (?:at your option )?any later version
        gnu lesser general public license version 2 1 february 1999""",
    "agpl-3": """
        free software you can redistribute it and or modify it under the terms of the gnu affero general public
        gnu affero general public license version 3 19 november 2007
        if you modify the program your modified version must prominently offer all users interacting with it remotely
        www gnu org licenses agpl""",
    "gfdl": """
        permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation
        with no invariant sections no front cover texts and no back cover texts""",
    "mpl-2": """
        this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one
        mozilla org mpl 2 0""",
    "mpl-1.1": """
        the contents of this file are subject to the mozilla public license version 1 1
        www mozilla org mpl""",
    "epl": """
        this program and the accompanying materials are made available under the terms of the eclipse public
        www eclipse org legal epl""",
    "cddl": """
        the contents of this file are subject to the terms of the common development and distribution
        see the license for the specific language governing permissions and limitations under the license when distributing covered code""",
    "eupl": """
        licensed under the eupl
        joinup ec europa eu software page eupl""",
    "artistic": """
        you may make and give away verbatim copies of the source form of the standard version
        under the same terms as perl itself""",
    "bsl": """
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        distributed under the boost software license
        www boost org license 1 0""",
    "zlib": """
        provided as is without any express or implied warranty in no event will the authors
        the origin of this software must not be misrepresented
        altered source versions must be plainly marked as such""",
    "unlicense": """
        free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software
        unlicense org""",
    "wtfpl": """
        you just do what the fuck you want to
        everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed""",
    "ofl": """
        this font software is licensed under the sil open font
        the fonts and derivatives however cannot be released under any other type of license
        scripts sil org ofl""",
    "python": """
        psf is making python available to licensee on an as is basis
        this license agreement is between the python software foundation""",
    "php": """
        this source file is subject to version 3 01 of the php license
        this product includes php software freely available from""",
    "postgresql": """
        permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement""",
    "openssl": """
        this product includes software developed by the openssl project
        this product includes cryptographic software written by eric young""",
    "ncsa": """
        to deal with the software without restriction including without limitation the rights""",
    "ms-pl": """
        if you bring a patent claim against any contributor over patents that you claim are infringed by the software""",
    "elastic": """
        you may not provide the software to third parties as a hosted or managed service""",
    "sspl": """
        if you make the functionality of the program or a modified version available to third parties as a service""",
    "busl": """
        the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
        effective on the change date or the fourth anniversary of the first publicly available distribution""",
    "commons-clause": """
        the license does not grant to you the right to sell the software
        commons clause (?:license )?condition""",
    "cc0": """
        the person who associated a work with this deed has dedicated the work to the public domain
        to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights
        creativecommons org publicdomain zero""",
    "cc-by": """
        creativecommons org licenses by [0-9]
        this work is licensed under a creative commons attribution [0-9]
        you must give appropriate credit provide a link to the license and indicate if changes were made""",
    "cc-by-sa": """
        creativecommons org licenses by sa
        if you remix transform or build upon the material you must distribute your contributions under the same license
        text is available under the creative commons attribution share ?alike""",
    "cc-by-nd": """
        creativecommons org licenses by nd
        if you remix transform or build upon the material you may not distribute the modified material""",
    "cc-by-nc": """
        creativecommons org licenses by nc [0-9]
        you may not use the material for commercial purposes""",
    "cc-by-nc-sa": """
        creativecommons org licenses by nc sa""",
    "cc-by-nc-nd": """
        creativecommons org licenses by nc nd""",
    "odbl": """
        this database is made available under the open database license
        contains information from .{1,80} which is made available here under the open database license
        opendatacommons org licenses odbl""",
    "odc-by": """
        opendatacommons org licenses by""",
    "pddl": """
        opendatacommons org licenses pddl
        public domain dedication and licen[sc]e""",
    "ogl-uk": """
        contains public sector information licensed under the open government licen[sc]e
        open government licen[sc]e v?[0-9]""",
    "llama": """
        llama [23] is licensed under the llama [23] community license
        built with meta llama""",
    "openrail": """
        use based restrictions as referenced in paragraph 5""",
    "public-domain": """
        (?:released|placed|dedicated) (?:in|into|to) the public domain
        this (?:work|file|code|document) is in the public domain
        no copyright is claimed
        this is a work of the united states government and is not subject to copyright protection""",
    "proprietary": """
        all rights reserved
        proprietary and confidential
        confidential and proprietary
        unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|document|material|software|website)
        no part of this (?:publication|book|work|document|website) may be reproduced
        may not be (?:reproduced|copied|redistributed|published broadcast rewritten) (?:or redistributed )?without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
        reproduction (?:in whole or in part )?(?:without permission )?is (?:strictly )?prohibited
        for personal (?:and )?non commercial use only
        licensed not sold
        this is an unpublished work
        trade secrets? of""",
    "warranty-disclaimer": """
        without warrant(?:y|ies) (?:of any kind|or conditions)
        the software is provided as is
        as is and as available
        including but not limited to the (?:implied )?warranties of merchantability""",
}

#: Forms of a mention: name, pattern around {n} (name) and {v} (version), priority (higher wins), weight for the score.
FORMS = (
    ("spdx", "spdx license identifier {n}(?: {v})?(?: only| or later)?", 9, 1.0),
    ("grant-version", "(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{n}(?: public)?(?: licen[sc]e)?(?: version| v)? {v}", 8, 1.0),
    ("name-version", "{n}(?: public)?(?: licen[sc]e)?(?: version| v)? {v}", 7, 0.9),
    ("grant", "(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[sc]e)?", 6, 0.9),
    ("name", "{n} licen[sc]e", 4, 0.7),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: re.Pattern
    keyword: str
    priority: int
    weight: float


def _keywords(name: str) -> list[str]:
    """The longest plain word run of each alternative of a name pattern: what a text must hold for it."""
    plain = re.sub(r"\(\?:[^()]*\)\??", "|", name)
    while "(" in plain:
        plain = re.sub(r"\([^()]*\)\??", "|", plain)
    return [k.strip() for k in re.sub(r".\?", "|", plain).split("|") if k.strip()]


def _longest_plain(pattern: str) -> str:
    """The longest run of plain words that every match of a signature holds."""
    plain = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\??|\.\{[0-9,]*\}|.\?", "\n", pattern)
    return max(plain.split("\n"), key=len).strip()


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first: the signatures, and the mentions of families in their versions and forms."""
    found = []
    for label, name, versions in FAMILIES:
        for form, shape, priority, weight in FORMS:
            for version in versions if "{v}" in shape and form != "spdx" else ("",):
                pattern = shape.replace("{n}", f"(?:{name})").replace("{v}", version or r"[0-9]+(?: [0-9]+)?")
                own = label if not version else f"{label}-{version.replace(' ', '.').removesuffix('.0')}"
                keyword = {"spdx": "spdx", "grant-version": " under ", "grant": " under ", "name-version": version, "name": "licen"}[form]
                found.append(Rule(f"{label}:{form}:{version}", own, re.compile(rf"(?<= )(?:{pattern})(?= )"), keyword, priority, weight))
    for label, lines in SIGNATURES.items():
        for i, pattern in enumerate(lines.strip().splitlines()):
            pattern = pattern.strip()
            found.append(Rule(f"{label}:signature:{i}", label, re.compile(rf"(?<= )(?:{pattern})(?= )"), _longest_plain(pattern), 5, 0.6))
    return tuple(sorted(found, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _gate():
    """An automaton of all keywords; for each, the numbers of its rules."""
    import ahocorasick

    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by_keyword.setdefault(r.keyword, []).append(i)
    names: dict[str, set[int]] = {}
    for label, name, _ in FAMILIES:
        plain = _keywords(name)
        own = {i for i, r in enumerate(rules()) if r.name.startswith(f"{label}:") and ":signature:" not in r.name}
        for k in plain or [""]:
            names.setdefault(k, set()).update(own)
    automaton = ahocorasick.Automaton()
    for k in {*by_keyword, *names} - {""}:
        automaton.add_word(k, k)
    automaton.make_automaton()
    free = names.get("", set())
    signature = {i for i, r in enumerate(rules()) if ":signature:" in r.name}
    return automaton, by_keyword, names, free | signature


#: Separators become spaces and A-Z lower case; all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str | None) -> tuple[str, int]:
    """The text's words with a space before and behind each, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return " " + b" ".join(words).decode("utf-8", "surrogatepass") + " " if words else " ", len(words)


def candidates(text: str) -> list[tuple[Rule, int, int]]:
    """All rule matches in a folded text."""
    automaton, by_keyword, names, ungated = _gate()
    seen = {k for _, k in automaton.iter(text)}
    named = set().union(ungated, *(names[k] for k in seen if k in names))
    keyed = {i for k in seen for i in by_keyword.get(k, ())}
    return [(r, m.start(), m.end()) for i in sorted(named & keyed) for r in (rules()[i],) for m in r.pattern.finditer(text)]


def settle(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections that none before them contains: by priority, length, place, then rule name.

    A detection within one that is itself suppressed also lies within the one
    that suppresses that, so it is enough to ask whether any earlier detection
    contains it: of a higher priority, by the furthest end of those that start
    no later, and of the same one in a sweep by start and falling end.
    """
    kept, starts, ends = [], [], []
    for _, level in groupby(sorted(found, key=lambda x: (-x[0].priority, x[1], -x[2], x[0].name)), key=lambda x: x[0].priority):
        own, reach = [], -1
        for r, a, b in level:
            at = bisect_right(starts, a)
            if b > reach and not (at and ends[at - 1] >= b):
                own.append((r, a, b))
            reach = max(reach, b)
        kept += own
        both = sorted([*zip(starts, ends), *((a, b) for _, a, b in own)])
        starts, ends = [a for a, _ in both], list(accumulate((b for _, b in both), max))
    return sorted(kept, key=lambda x: (-x[0].priority, x[1] - x[2], x[1], x[0].name))


def scan_text(text: str | None) -> dict:
    """Detections of one text; see scan() for the fields."""
    line, n = folded(text)
    starts, base = [], set()
    for phrase, label in BASE:
        needle, at = f" {phrase} ", -1
        while (at := line.find(needle, at + 1)) >= 0:
            starts.append(at)
            base.add(label)
    kept = settle(candidates(line))
    spaces = [m.start() for m in re.finditer(" ", line)] if starts or kept else []
    before = lambda at: bisect_left(spaces, at)  # noqa: E731  spaces before a place, which number the words
    places = [before(at) for at in starts]
    labels = base | {r.label for r, _, _ in kept}
    spans = sorted((before(a) - 1, before(b), r.label, r.name) for r, a, b in kept)
    score = max([r.weight for r, _, _ in kept] + [1.0] * bool(base), default=0.0)
    return {"n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "detections": spans}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row.

    n_base counts all places of the BASE phrases, first_word and last_word are
    their smallest and largest start (null if none). detections lists
    (first word, end word, label, rule) of the rules kept; labels joins base
    and rule labels, distinct and sorted. score is the strongest detection's
    weight, 0 without any. Null and empty texts have no words. Repeated rows
    give repeated rows, an empty table an empty result.
    """
    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,stop:long,label:string,rule:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([scan_text(t) for t in b["text"]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            rows["detections"] = [[dict(zip(("first", "stop", "label", "rule"), d, strict=True)) for d in ds] for ds in rows["detections"]]
            rows[["first_word", "last_word"]] = rows[["first_word", "last_word"]].astype("Int64")
            rows.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield rows

    return by_text(docs, run, columns, id_col, text_col)

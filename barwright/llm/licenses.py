"""License scan: ordered signature rules with keyword gates and suppression of contained detections.

A rule is a regular expression over the text's words (lower-case, one blank between them), a label, a weight and a
keyword. Rules come in the order of their priority: SPDX tags, full sentences that only one license has, named grants,
bare names, hints. A rule's expression runs only where its keyword stands in the text; one automaton finds all
keywords in a single pass. Detections are taken in the order of priority, longer ones first within it; one whose
interval lies within that of a detection already taken is dropped. What remains names the licenses.

Base phrases are looked for apart from the rules; their labels always stay.

Defined cases
- A null or empty text has no words, no labels and score 0.
- A phrase counts at every place where its words stand one after the other, overlapping places too.
- Rows keep their ``doc_id``, null or repeated; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import column, slices

# --- fixed values: the base phrases and their labels ---
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# -------------------------------------------------------
#: Bytes that are no part of a word become blanks; the others stay, A-Z lower-cased.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: label: names as they are written in prose, as expressions over words.
NAMES = {
    "mit": (r"mit(?: expat| x11)?", r"expat"),
    "apache-2": (r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?",),
    "apache-1": (r"apache(?: software)?(?: license)?(?: version| v)? ?1(?: [01])?",),
    "gpl-3": (r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", r"gplv3"),
    "gpl-2": (r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", r"gplv2"),
    "lgpl-3": (r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", r"lgplv3"),
    "lgpl-2": (r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version| v)? ?2(?: [01])?", r"lgplv2"),
    "agpl-3": (r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)?(?: ?3(?: 0)?)?", r"agplv3"),
    "bsd-2": (r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)",),
    "bsd-3": (r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)",),
    "bsd-4": (r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)",),
    "isc": (r"isc", r"internet systems consortium"),
    "mpl-2": (r"mozilla public(?: license)?(?: version| v)? ?2(?: 0)?", r"mpl(?: version| v)? ?2(?: 0)?"),
    "mpl-1": (r"mozilla public(?: license)?(?: version| v)? ?1(?: [01])?", r"mpl(?: version| v)? ?1(?: [01])?"),
    "epl-2": (r"eclipse public(?: license)?(?: version| v)? ?2(?: 0)?", r"epl(?: version| v)? ?2(?: 0)?"),
    "epl-1": (r"eclipse public(?: license)?(?: version| v)? ?1(?: 0)?", r"epl(?: version| v)? ?1(?: 0)?"),
    "cddl-1": (r"common development and distribution", r"cddl"),
    "cc-by-nc-nd": (r"cc by nc nd", r"creative commons attribution non ?commercial no ?deriv\w*"),
    "cc-by-nc-sa": (r"cc by nc sa", r"creative commons attribution non ?commercial share ?alike"),
    "cc-by-nc": (r"cc by nc(?! nd| sa)", r"creative commons attribution non ?commercial(?! no ?deriv| share ?alike)"),
    "cc-by-nd": (r"cc by nd", r"creative commons attribution no ?deriv\w*"),
    "cc-by-sa": (r"cc by sa", r"creative commons attribution share ?alike"),
    "cc-by": (r"cc by(?! n| sa)", r"creative commons attribution(?! n| share)"),
    "cc0": (r"cc0", r"cc zero", r"creative commons zero"),
    "unlicense": (r"unlicense",),
    "wtfpl": (r"wtfpl", r"do what the \w+ you want to public license"),
    "zlib": (r"zlib(?: libpng)?",),
    "boost-1": (r"boost software", r"bsl(?: version| v)? ?1(?: 0)?"),
    "artistic-2": (r"artistic(?: license)?(?: version| v)? ?2(?: 0)?",),
    "artistic-1": (r"artistic(?: license)?(?: version| v)? ?1(?: 0)?",),
    "python-2": (r"python software foundation", r"psf"),
    "postgresql": (r"postgresql",),
    "openssl": (r"openssl",),
    "ofl-1": (r"sil open font", r"open font", r"ofl(?: version| v)? ?1(?: 1)?"),
    "eupl-1": (r"european union public", r"eupl"),
    "ms-pl": (r"microsoft public", r"ms pl"),
    "ncsa": (r"university of illinois ncsa open source", r"ncsa"),
    "odbl": (r"open database", r"odbl"),
    "openrail": (r"open ?rail(?: m)?", r"responsible ai"),
    "llama": (r"llama \d(?: \d)? community",),
}
#: label: SPDX identifiers as words.
TAGS = {
    "mit": "mit", "apache-2": "apache 2 0", "apache-1": r"apache 1 [01]", "gpl-3": r"gpl 3 0(?: only| or later)?",
    "gpl-2": r"gpl 2 0(?: only| or later)?", "lgpl-3": r"lgpl 3 0(?: only| or later)?", "lgpl-2": r"lgpl 2 [01](?: only| or later)?",
    "agpl-3": r"agpl 3 0(?: only| or later)?", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause", "bsd-4": "bsd 4 clause",
    "isc": "isc", "mpl-2": "mpl 2 0", "mpl-1": r"mpl 1 [01]", "epl-2": "epl 2 0", "epl-1": "epl 1 0", "cddl-1": r"cddl 1 [01]",
    "cc-by-nc-nd": r"cc by nc nd \d 0", "cc-by-nc-sa": r"cc by nc sa \d 0", "cc-by-nc": r"cc by nc \d 0", "cc-by-nd": r"cc by nd \d 0",
    "cc-by-sa": r"cc by sa \d 0", "cc-by": r"cc by \d 0", "cc0": "cc0 1 0", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "zlib": "zlib", "boost-1": "bsl 1 0", "artistic-2": "artistic 2 0", "python-2": r"(?:psf|python) 2 0", "postgresql": "postgresql",
    "openssl": "openssl", "ofl-1": r"ofl 1 [01]", "eupl-1": r"eupl 1 [12]", "ms-pl": "ms pl", "ncsa": "ncsa", "odbl": r"odbl 1 0",
}
#: Sentences that one license alone has: label, keyword, expression.
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-3", "redistributions", r"redistributions of source code must retain .{0,900}neither the name of"),
    ("bsd-2", "redistributions", r"redistributions of source code must retain .{0,400}redistributions in binary form"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache license", r"you may not use this file except in compliance with the license"),
    ("gpl-3", "either version 3", r"gnu general public license .{0,120}either version 3"),
    ("gpl-2", "either version 2", r"gnu general public license .{0,120}either version 2"),
    ("lgpl-3", "either version 3", r"gnu lesser general public license .{0,120}either version 3"),
    ("lgpl-2", "either version 2", r"gnu (?:lesser|library) general public license .{0,120}either version 2"),
    ("agpl-3", "affero", r"gnu affero general public license .{0,120}either version 3"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("boost-1", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
)
#: Weaker signs: label, keyword, expression, weight.
HINTS = (
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.6),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 0.5),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.6),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use)", 0.5),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes) only", 0.5),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 0.3),
)
#: How a grant names a license: a keyword that each match holds, and the expression; {} is the name.
GRANTS = (
    ("under", r"(?:licensed|released|distributed|available|published|provided|covered|made available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{}(?: public)?(?: licen[sc]e)?"),
    ("licen", r"(?:under|subject to) the (?:terms(?: and conditions)? of the )?(?:gnu )?{}(?: public)? licen[sc]e"),
    ("licen", r"licen[sc]e[ds]? (?:is |under |as )?(?:the )?{}(?: licen[sc]e)?"),
)
TAG, SENTENCE, GRANT, NAME, HINT = range(5)
WEIGHTS = {TAG: 1.0, SENTENCE: 0.98, GRANT: 0.9, NAME: 0.6}


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    weight: float


def keyword_of(name: str) -> str:
    """The longest piece of plain text that every match of a name expression holds."""
    plain = re.sub(r"\(\?[:!](?:[^()]|\([^()]*\))*\)\??", "\0", name)
    plain = re.sub(r".\?|\\\w[*+]?", "\0", plain)
    return max((p.strip() for p in plain.split("\0")), key=len) if "|" not in plain else ""


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules in the order of their priority."""
    out = []

    def add(priority: int, label: str, keyword: str, pattern: str, weight: float) -> None:
        out.append(Rule(priority, label, keyword, re.compile(rf"(?<= )(?:{pattern})(?= )"), weight))

    for label, tag in TAGS.items():
        add(TAG, label, "spdx license identifier", rf"spdx license identifier {tag}", WEIGHTS[TAG])
    for label, keyword, pattern in SENTENCES:
        add(SENTENCE, label, keyword, pattern, WEIGHTS[SENTENCE])
    for priority in (GRANT, NAME):
        for label, names in NAMES.items():
            for name in names:
                if priority == NAME:
                    add(NAME, label, keyword_of(name) or "licen", rf"(?:the )?{name}(?: public)? licen[sc]e", WEIGHTS[NAME])
                else:
                    for keyword, grant in GRANTS:
                        add(GRANT, label, keyword_of(name) or keyword, grant.replace("{}", f"(?:{name})"), WEIGHTS[GRANT])
    for label, keyword, pattern, weight in HINTS:
        add(HINT, label, keyword, pattern, weight)
    return out


class Scanner:
    """Finds the keywords of all rules at once, then runs the rules that are left."""

    def __init__(self, own: list[Rule]):
        self.rules = own
        self.always = [i for i, r in enumerate(own) if not r.keyword]
        self.gates = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, rule in enumerate(own):
            if rule.keyword:
                by.setdefault(rule.keyword, []).append(i)
        for keyword, numbers in by.items():
            self.gates.add_word(keyword, tuple(numbers))
        if by:
            self.gates.make_automaton()

    def detections(self, words: str) -> list[tuple[int, int, Rule]]:
        """Intervals that are left after suppression, best first. ``words`` begins and ends with a blank."""
        chosen = set(self.always)
        for _, numbers in self.gates.iter(words) if len(self.gates) else ():
            chosen.update(numbers)
        found = [(m.start(), m.end(), self.rules[i]) for i in sorted(chosen) for m in self.rules[i].pattern.finditer(words)]
        found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0]))
        kept: list[tuple[int, int, Rule]] = []
        for start, end, rule in found:
            if not any(s <= start and end <= e for s, e, _ in kept):
                kept.append((start, end, rule))
        return kept


def places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands in words joined by blanks, with a blank at both ends."""
    out, at, number, before = [], words.find(phrase), 0, 0
    while at >= 0:
        number += words.count(b" ", before, at)
        out.append(number)
        before = at
        at = words.find(phrase, at + 1)
    return out


def scan_text(scanner: Scanner, text: str | None) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    base = [(label, places(joined, b" " + phrase.encode() + b" ")) for phrase, label in BASE]
    at = [i for _, found in base for i in found]
    base_labels = {label for label, found in base if found}
    kept = scanner.detections(joined.decode("utf-8", "surrogatepass"))
    labels = base_labels | {rule.label for _, _, rule in kept}
    score = max([rule.weight for _, _, rule in kept] + ([WEIGHTS[GRANT]] if at else []), default=0.0)
    spans = [(rule.label, start, end, rule.priority) for start, end, rule in kept]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(base_labels), sorted(labels), score, spans


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules())
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))
    for batch in slices(batches):
        rows = [scan_text(scanner, t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows)) if rows else [[]] * 8
        spans = [[dict(zip(("label", "start", "end", "priority"), s)) for s in own] for own in columns[7]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(columns[i], pa.int64()) for i in range(4)),
             *(pa.array(columns[i], pa.list_(pa.string())) for i in (4, 5)), pa.array(columns[6], pa.float64()), pa.array(spans, kind)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
        )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, labels, score and detections (label, character interval in the joined words, priority) of every row."""
    docs = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return docs.mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "score double, detections array<struct<label: string, start: long, end: long, priority: int>>",
    )


def joined_labels(scanned: DataFrame) -> DataFrame:
    return scanned.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})

import random

import pytest
from pyspark.sql import functions as F

from barwright.llm import licenses
from texts import docs

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z" else " " for c in lowered).split(" ")
    words = [w for w in words if w]
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(4)
    pool = "under the MIT license apache License version 2 cc by nc BY-NC, x é 漢字 \x00 _ - 2.0 cc.by,nc \n\t under-the-mit-license İ K".split(" ")
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(300)] + [(300, None), (301, ""), (301, "CC BY NC BY NC")]
    df = docs(spark, rows).select("*", F.lit(1).alias("labels"), F.lit(2).alias("score"))
    got = licenses.joined_labels(licenses.scan_licenses(df)).collect()
    assert len(got) == len(rows)
    for (doc, text), r in zip(sorted(rows, key=lambda r: (r[0], r[1] or "")), sorted(got, key=lambda r: (r.doc_id, r.n_words))):
        assert doc == r.doc_id
    by = {}
    for doc, text in rows:
        by.setdefault(doc, []).append(brute_base(text))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in by[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2"}),
    ("Licensed under the GNU Lesser General Public License, version 3", {"lgpl-3"}),
    ("released under the GNU General Public License, version 3", {"gpl-3"}),
    ("distributed under the 3-clause BSD license", {"bsd-3"}),
    ("released under simplified BSD", {"bsd-2"}),
    ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa", "cc-by-nc"}),
    ("Licensed under CC BY-SA 4.0.", {"cc-by-sa"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2"}),
    ("the mit students of 2020 had no licence plates", set()),
    ("A miscellaneous text about parrots.", set()),
])
def test_rules(text, labels):
    got = licenses.scan_text(licenses.Scanner(licenses.rules()), text)
    assert set(got[5]) == labels


def test_there_are_hundreds_of_rules_and_every_keyword_gates_rightly():
    rules = licenses.rules()
    assert len(rules) > 200 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    # a rule that matches must have been let through by its keyword
    every = licenses.Scanner(rules)
    open_gates = licenses.Scanner([licenses.Rule(r.priority, r.label, "", r.pattern, r.weight) for r in rules])
    names = " ".join(sorted({r.pattern.pattern for r in rules}))
    words = [w for w in "".join(c if c.isalnum() else " " for c in names).split() if w]
    plain = lambda found: [(start, end, r.pattern.pattern) for start, end, r in found]
    rng = random.Random(3)
    for _ in range(400):
        text = " " + " ".join(rng.choice(words) for _ in range(60)) + " "
        assert plain(every.detections(text)) == plain(open_gates.detections(text))


def test_contained_detections_are_suppressed():
    spans = licenses.scan_text(licenses.Scanner(licenses.rules()), "Licensed under the Apache License, Version 2.0 and the MIT License")[7]
    for label, start, end, _ in spans:
        assert not any((s, e) != (start, end) and s <= start and end <= e for _, s, e, _ in spans)

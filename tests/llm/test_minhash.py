import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import minhash
from barwright.llm.graph import components, merged
from texts import docs, edited, prose, rows_of


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")


def shingles(text):
    words = [w for w in words_of(text) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


def check(spark, rows):
    got = rows_of(minhash.near_duplicates(docs(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute(rows)


def test_copies_near_copies_and_edge_texts(spark):
    rows = [(i, prose(i, 20 + 9 * i)) for i in range(1, 30)]
    rows += [(100 + i, edited(rows[i][1], i, 1 + i // 8)) for i in range(29)] + [(200 + i, rows[i][1].upper()) for i in range(9)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "one two"), (306, "one two three four five"),
             (307, "a " * 30), (308, "a " * 90), (309, "é É"), (310, "É é")]
    check(spark, rows)


def test_copies_that_are_near_their_source_only(spark):
    source = prose(7, 120)
    # each copy is near the source; two copies are not near each other
    check(spark, [(900, source)] + [(i, edited(source, i, 3)) for i in range(60)])


def test_a_passage_that_many_documents_share(spark):
    passage = prose(5, 60)
    rows = [(i, f"{prose(1000 + i, 8 + i % 30)} {passage}") for i in range(150)]
    check(spark, rows + [(500, edited(rows[40][1], 1, 1)), (501, passage)])


def test_a_chain(spark):
    text, rows = prose(3, 100), []
    for i in range(40):
        rows.append((40 - i, text))
        words = text.split(" ")
        words[(i * 7) % 100] = f"step{i}"
        text = " ".join(words)
    check(spark, rows)


def test_null_and_repeated_ids_extra_columns_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    df = docs(spark, rows).select("*", F.lit(1).alias("keys"), F.lit(2).alias("h1"), F.lit(3).alias("component_id"))
    got = rows_of(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_densified_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 20, 200, 3000):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 5 * size, dtype=np.uint64)
            a, b = np.unique(pool[: 4 * size]), np.unique(pool[size:])
            agree.append((minhash.signature(a, 128) == minhash.signature(b, 128)).mean())
        assert abs(np.mean(agree) - 0.6) < 0.06


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    more = [(5000 + i, rng.randrange(300)) for i in range(20)] + [(7000, 7001)]

    def brute_groups(pairs):
        root = {}
        for pair in pairs:
            for x in pair:
                root.setdefault(x, x)
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
        return {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}

    first = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in first.collect()} == brute_groups(edges)
    second = merged(first, spark.createDataFrame(more, "a long, b long"))
    assert {r.id: r.component for r in second.collect()} == brute_groups(edges + more)


def test_rows_of_one_id_with_several_texts_are_judged_apart(spark):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a), (2, edited(a, 5, 2)), (2, b), (3, edited(b, 6, 2)), (4, c), (4, c), (None, c), (None, a + " x"), (None, None), (7, None), (7, "")]
    given = docs(spark, rows).withColumn("key", F.lit("own"))
    left = minhash.drop_near_duplicates(given)
    assert left.columns == given.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sum(1 for _, t in got if t and len(t) > 1) == 3
    assert (1, a) in got and (4, c) in got
    assert sum(1 for _, t in got if t in (b, edited(b, 6, 2))) == 1
    assert sorted(i for i, t in got if t == "") == [7] and (7, None) in got and (None, None) in got

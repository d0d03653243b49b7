import random

import pytest
from pyspark.sql import functions as F

from barwright.llm import chunks
from texts import docs, prose, rows_of


def test_chunks_cover_the_text_and_resist_insertions():
    data = prose(1, 3000).encode()
    ends = chunks.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends)) <= chunks.MOST
    moved = b"something new " + data
    cut = {moved[a:b] for a, b in zip([0, *chunks.cuts(moved)], chunks.cuts(moved))}
    whole = [data[a:b] for a, b in zip([0, *ends], ends)]
    assert sum(c not in cut for c in whole) <= 3


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 10_000, bytes(range(256)) * 9, b"\n" * 50])
def test_any_bytes(data):
    ends = chunks.cuts(data)
    assert ends == sorted(set(ends)) and (ends[-1] == len(data) if data else not ends)


def planted(n, words, seed):
    """Documents of which some pairs share one passage of so many words."""
    rng = random.Random(seed)
    rows, pairs = [], []
    for i in range(n):
        body = prose(seed * 1000 + i, 80).split(" ")
        rows.append([i, body])
    for k in range(n // 4):
        passage = prose(seed * 1000 + 500 + k, words).split(" ")
        for i in (4 * k, 4 * k + 2):
            at = rng.randrange(len(rows[i][1]))
            rows[i][1][at:at] = passage
            pairs.append(i)
    return [(i, " ".join(w)) for i, w in rows], set(pairs)


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    found, clean, missed = 0, 0, 0
    for seed in (1, 2):
        rows, with_passage = planted(200, 51, seed)
        got = {r.doc_id for r in chunks.repeated_passages(docs(spark, rows)).select("doc_id").distinct().collect()}
        found, missed, clean = found + len(got & with_passage), missed + len(with_passage - got), clean + len(got - with_passage)
    assert clean == 0 and missed <= 0.02 * (found + missed)


def test_spans_lie_on_the_passage(spark):
    passage = prose(50, 60)
    rows = [(1, f"{prose(1, 30)} {passage} {prose(2, 30)}"), (2, f"{prose(3, 40)} {passage}"), (3, prose(4, 90)), (4, passage + "!")]
    spans = chunks.repeated_passages(docs(spark, rows))
    texts = dict(rows)
    for r in spans.collect():
        assert texts[r.doc_id].encode()[r.start : r.end].decode() in passage + "!" and r.first_doc == 1
        assert r.n_words >= 30
    assert {r.doc_id for r in spans.collect()} == {1, 2, 4}
    kept = {r.doc_id: r.text for r in chunks.without_passages(docs(spark, rows), spans).collect()}
    assert kept[1] == texts[1] and kept[3] == texts[3] and len(kept[2]) < len(texts[2]) - 200 and kept[2].startswith(prose(3, 40))


def test_a_run_counts_as_a_whole_whatever_its_first_documents(spark):
    passage = prose(60, 60)
    own = chunks.cuts(passage.encode())
    # each lower id holds the passage one chunk further than the one before it
    early = [(i, f"{prose(100 + i, 30)} {passage[:a]}") for i, a in enumerate(own[1:-1])]
    rows = [*early, (90, f"{prose(2, 30)} {passage} {prose(3, 30)}"), (91, f"{prose(4, 30)} {passage}")]
    spans = chunks.repeated_passages(docs(spark, rows)).collect()
    texts = dict(rows)
    for doc in (90, 91):
        mine = sorted((r.start, r.end, r.first_doc) for r in spans if r.doc_id == doc)
        assert len({first for *_, first in mine}) > 3 and min(b - a for a, b, _ in mine) < chunks.MIN_BYTES
        assert all(b == c for (_, b, _), (c, _, _) in zip(mine, mine[1:]))  # the parts lie side by side
        covered = texts[doc].encode()[mine[0][0] : mine[-1][1]].decode()
        assert covered in passage and len(covered) >= 0.75 * len(passage)
    # shared chunks that are short as a whole are still no passage
    assert chunks.repeated_passages(docs(spark, [(1, f"{prose(5, 30)} {prose(6, 5)}"), (2, f"{prose(7, 30)} {prose(6, 5)}")])).count() == 0


def test_edge_rows(spark):
    text = prose(9, 100)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "x " * 5000), (5, text + "\n" + text)]
    df = docs(spark, rows).select("*", F.lit(1).alias("digest"), F.lit(2).alias("row"), F.lit(3).alias("pos"), F.lit(4).alias("ends"))
    got = chunks.repeated_passages(df)
    assert {r[0] for r in rows_of(got, "doc_id")} == {1, 5}
    # what only rows of one document share is no repetition
    assert chunks.repeated_passages(docs(spark, [(1, text), (1, text + " more"), (2, "other")])).count() == 0
    assert chunks.repeated_passages(docs(spark, [])).count() == 0

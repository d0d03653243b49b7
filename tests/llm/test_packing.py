import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barwright.llm import packing
from texts import docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def naive(lengths, capacity):
    open_, used = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(open_, length)
        if at < len(open_):
            room = open_.pop(at)
        else:
            room, used = capacity, used + 1
        if room > length:
            bisect.insort(open_, room - length)
    return used


@pytest.mark.parametrize("capacity", [7, 10, 37, 64, 2048])
def test_runs_equal_one_piece_after_the_other(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, 1 + capacity // 5) for _ in range(rng.randint(1, 300))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        filled, ranks = {}, {}
        for length, rank, many, first, offset in packing.best_fit_runs(histogram, capacity):
            for i in range(many):
                filled.setdefault(first + i, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + i)
        assert len(filled) == naive(lengths, capacity)
        assert all(sorted(v) == list(range(histogram[x])) for x, v in ranks.items())
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_runs_do_not_grow_with_the_corpus():
    small = packing.best_fit_runs({x: 1 + x % 7 for x in range(1, 513)}, 512)
    large = packing.best_fit_runs({x: 10**9 * (1 + x % 7) for x in range(1, 513)}, 512)
    assert len(large) <= 2 * len(small) + 1000


def test_pieces_and_places(spark):
    rows = [(i, prose(i, 5 + 13 * (i % 40))) for i in range(120)] + [(500, None), (501, ""), (502, "x"), (503, "x"), (503, "x"), (None, "y z"),
                                                                      (504, prose(1, 6000)), (505, "<|endoftext|> é\x1cÉ \x85 Σας")]
    df = docs(spark, rows).select("*", F.lit(1).alias("length"), F.lit(2).alias("piece"), F.lit(3).alias("offset"))
    got = packing.pack_documents(df, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, at // 2048, at, len(part), zlib.crc32(part.tobytes())) for at in range(0, len(ids), 2048) for part in [ids[at : at + 2048]]]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == naive([r.length for r in got], 2048)
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0

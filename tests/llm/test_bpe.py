import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barwright.llm import bpe
from texts import docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


def texts(seed, n):
    rng = random.Random(seed)
    pool = ["abcdefgh", "eainst", "'s't'll.,!?", "éñüßçêàΣςİ", "0123٣½ \t\n", "\x1c\x1f\x85\xa0  ", "漢字かな🎉", "ȩ́", "\x00​_", "<|>"]
    for _ in range(n):
        text = "".join(rng.choice(rng.choice(pool)) for _ in range(rng.randrange(60)))
        yield text + rng.choice(["", "<|endoftext|>", "<|startoftext|>x", " <|endoftext|"])


def test_ids_and_text_equal_the_library(encoder, library):
    decoder = bpe.Decoder(encoder.merges)
    for text in texts(1, 1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder, text) == want, text
        assert decoder.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("part", ["a", "ab", "the", "in", "abcdefghij", "é", "eainst"])
def test_long_words_stream_with_bounded_memory(encoder, library, part):
    word = (part * 3000)[:6000]
    assert ids_of(encoder, word) == library.encode(word, add_special_tokens=False).ids
    transducer, held, out = bpe.Transducer(encoder.merges), 0, []
    symbols = word.encode().decode("latin-1").translate(encoder.merges.symbols)
    for symbol in symbols[:-1]:
        out += transducer.feed(symbol)
        held = max(held, len(transducer.text))
    out += transducer.finish(symbols[-1])
    assert held < 20 * encoder.merges.lookahead
    assert [encoder.merges.ids[t] for t in out] == library.encode(word, add_special_tokens=False).ids


def test_incremental_decoding_equals_decoding_at_once(encoder):
    text = "the café, naïve 漢字 🎉 it's"
    ids = ids_of(encoder, text)
    for plain in (True, False):
        one = bpe.Decoder(encoder.merges, plain)
        parts = "".join(one.feed(i) for i in ids) + one.finish()
        assert parts == bpe.Decoder(encoder.merges, plain).decode(ids)
    assert bpe.Decoder(encoder.merges, False).decode(ids).replace(" ", "") == text.replace(" ", "")


def test_rows(spark, library):
    rows = [(1, "Hello, World"), (1, "Hello, World"), (None, "x"), (2, None), (3, ""), (4, prose(1, 30_000))]
    df = docs(spark, rows).select("*", F.lit(1).alias("ids"), F.lit(2).alias("decoded"))
    got = bpe.encode_and_decode(df, PATH)
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got.collect()], key=repr) == sorted(want, key=repr)
    digest = got.filter("doc_id = 2").select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).first()[0]
    assert digest == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_and_decode(docs(spark, []), PATH).count() == 0


def test_all_characters_and_random_marks_equal_the_library(encoder, library):
    """Python and the library may know different versions of Unicode: both encoders have to give the library's ids."""
    from barwright.llm.packing import UnitCache

    cache = UnitCache(PATH)
    rng = random.Random(11)
    marks = [chr(c) for c in (*range(0x300, 0x370), *range(0x89B, 0x8A0), *range(0x1AB0, 0x1AF0), *range(0x1CD0, 0x1CFA), *range(0x20D0, 0x20F1))]
    letters = [*"aeiouAEnsİıſẞΣσς", "\u1c89", "\ua7cb", "\u0558", "\u208f", "가", "ﬁ"]
    found = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x18000), *range(0x1D000, 0x20000), 0xE0001, 0x10FFFF)]
    found += ["".join(rng.choice(letters if rng.random() < 0.4 else marks) for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    found += ["".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(30)) for _ in range(3000)]
    for start in range(0, len(found), 5000):
        part = found[start : start + 5000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [ids_of(encoder, t) for t in part] == want
        assert [np.frombuffer(i, "<u4").tolist() for i in cache.encode(part)] == want


def test_empty_table(spark):
    assert bpe.encode_and_decode(docs(spark, []), PATH).collect() == []

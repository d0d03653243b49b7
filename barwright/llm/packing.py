"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, and pieces of one length are interchangeable. So the packing needs
the histogram of lengths only, at most one row per length, and is decided on the driver: a segment tree over remaining
capacities gives the tightest sequence that is open, in logarithmic time, for a run of equal pieces at once. The result is
that of placing one piece after the other. It comes as runs ("the pieces of this length from rank r on go to
the sequences from s on at offset o"), whose number depends on the capacity and not on the corpus.
Pieces then find their place by their rank among those of their length, which is counted in parts, so no task holds all pieces of a length.

Defined cases
- A null or empty text has the closing id only: one piece of length 1. An empty table gives no rows.
- A text longer than the capacity is cut into full pieces and a rest; other texts are never cut.
- Rows with a null or repeated ``doc_id`` are packed like any others, each row once.
- Other columns take no part, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.bpe import BLANK, CONTRACTIONS, SEPARATORS, SETTLED, byte_symbols
from barwright.llm.common import column
from barwright.session import materialize

CAPACITY = 2048
CLOSING_ID = 0
REMEMBERED, LONGEST = 200_000, 32
PART_ROWS, MOST_PARTS = 1024, 4096


class OpenCapacities:
    """Segment tree over remaining capacities; a leaf counts the open sequences that have just so much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # ranges of sequences: first, how many

    def add(self, left: int, first: int, many: int) -> None:
        if left and many:
            self.groups[left].append((first, many))
            self._count(left, many)

    def _count(self, left: int, by: int) -> None:
        at = left + self.size
        while at:
            self.count[at] += by
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that a sequence has."""
        at = length + self.size
        while not self.count[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            if not self.count[at]:
                at += 1
        return at - self.size

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of one range."""
        first, many = self.groups[left].pop()
        if many > most:
            self.groups[left].append((first + most, many - most))
            many = most
        self._count(left, -many)
        return first, many


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``length, rank, count, sequence, offset``; longest pieces first, each to the tightest open sequence."""
    tree, runs, opened = OpenCapacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            new = room is None
            room = capacity if new else room
            # a sequence that has taken one piece is the tightest for the next, while that one fits
            each = room // length
            full = left // each
            if new:
                first, many = opened, full or 1
                opened += many
            else:
                first, many = tree.take(room, full or 1)
            placed = each if full else left
            for slot in range(placed):
                runs.append((length, rank, many, first, capacity - room + slot * length))
                rank += many
            left -= placed * many
            tree.add(room - placed * length, first, many)
    return runs


class UnitCache:
    """Ids of texts by the tokenizers library, whose model sees each word once.

    The words of the tokenizer's pattern are found in the lowered text and given to the model, whose ids for a word do not depend on
    what stands beside it. A text with a special token, or with characters that Python may know by another version of Unicode, is
    first cut at blanks, and the units that hold them go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsettled = re.compile(f"[^\\x00-{SETTLED}]").search
        self.blank, self.word = regex.compile(f"[{BLANK}]+"), re.compile(settled_pattern())
        self.words: dict[str, bytes] = {}

    def odd(self, text: str) -> bool:
        return any(m in text for m in self.marks) or self.unsettled(text) is not None

    def units(self, text: str) -> list[str]:
        if any(s in text for s in SEPARATORS):
            return [u for u in self.blank.split(text) if u]
        return text.split()

    def parts(self, text: str) -> list[str]:
        """Words in lower case, and odd units as they are."""
        if not self.odd(text):
            return self.word.findall(text.lower())
        out: list[str] = []
        for unit in self.units(text):
            if not self.odd(unit):
                out += self.word.findall(unit.lower())
            else:
                out.append(unit)
        return out

    def ids(self, part: str) -> bytes:
        if self.odd(part):
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if not (part.isascii() and part.isprintable()):
            part = part.encode("utf-8").decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        found = [self.parts(t or "") for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words, ids = self.words, self.ids
        new = list(set().union(*found).difference(words))
        for part in new:
            words[part] = ids(part)
        out = [b"".join([words[w] for w in parts]) for parts in found]
        for part in new:
            if len(part) > LONGEST:  # seldom met again, and of any size
                del words[part]
        return out


def settled_pattern() -> str:
    """The word pattern for characters up to ``SETTLED``, with its classes spelled out."""
    kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(ord(SETTLED) + 1)}
    letters, numbers = ("".join(re.escape(c) for c, kind in kinds.items() if kind == wanted) for wanted in "LN")
    # inside the class of other characters the members stand alone, elsewhere they are a class of their own
    others = f"[^{BLANK}{letters}{numbers}]+"
    return "|".join([*CONTRACTIONS, f"[{letters}]+", f"[{numbers}]", others])


@lru_cache(1)
def unit_cache(path: str) -> UnitCache:
    """One for each Python worker: the tasks it runs share what it has learned."""
    return UnitCache(path)


def cutter(path: str, capacity: int, closing: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
        cache, end = unit_cache(path), np.array([closing], "<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                rows, piece, begin, length, crc = [], [], [], [], []
                for row, ids in enumerate(cache.encode(part.column(1).to_pylist())):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(i)
                        begin.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. pieces: a written table with ``length`` from 1 to capacity."""
    spark = pieces.sparkSession
    histogram = dict(pieces.groupBy("length").agg(F.count("*").alias("n")).collect())  # at most one row per length
    parts = min(MOST_PARTS, max(1, sum(histogram.values()) // PART_ROWS))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding)")
    counts = salted.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(before, F.lit(0)).alias("before")
    )
    own = F.expr("row_number() over (partition by length, part order by doc_id, piece, ids_crc32)")
    ranked = salted.withColumn("own", own).join(counts, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("own") - 1
    )
    runs = spark.createDataFrame(
        best_fit_runs(histogram, capacity), "length long, first_rank long, many long, first_sequence long, offset long"
    )
    placed = ranked.join(runs, "length").filter("rank >= first_rank and rank < first_rank + many")
    return placed.select(
        *pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    closing: int = CLOSING_ID,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row."""
    docs = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    pieces = docs.mapInArrow(
        cutter(path, capacity, closing), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    return pack(materialize(pieces, "pieces"), capacity)

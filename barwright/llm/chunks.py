"""Substring dedup with content-defined chunks.

A gear hash rolls over the bytes of a text; where it falls below a limit, a chunk ends. The hash sees 16 bytes, so
what stands before a passage changes the passage's first cut at most, and an insertion moves no later cut. Chunks are told apart by digest. A chunk
that occurs in several documents is shared; a run of shared chunks is a repeated passage, if it is long enough as a whole. Its chunks
can first occur in different documents: then each part with one first document is a row of its own, however short.

Digests are counted after a combine per task; of a digest only its first document and whether there is a second are kept. The join that
finds shared chunks reads two exchanged sides, so the rows of a frequent passage can be split. Texts are read once and never shuffled.

Defined cases
- A null or empty text has no chunks. Texts of any length are cut whole; a chunk has at most ``MOST`` bytes.
- Rows with a null ``doc_id`` take no part. Rows with the same ``doc_id`` are one document: what only they share is no repetition.
- Text repeated within one document alone is no repetition across documents.
- Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import column
from barwright.session import materialize

LEAST, MEAN, MOST = 8, 24, 1024
MIN_BYTES = 80
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text, its own end included."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    # h[i] = sum of gear[byte i-k] << k: windows of 1, 2, 4, 8, 16 bytes, each from two of the one before
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width) if len(h) > width else 0
    out, last = [], 0
    for end in (np.flatnonzero(h < (1 << 16) // MEAN) + 1).tolist():
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST:
            out.append(end)
            last = end
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, digests, ends, words``: of each chunk its digest, its end, and the words that begin in it."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            digests, ends, words, sizes = [], [], [], [0]
            for text in part.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                if data:
                    own = cuts(data)
                    digests.append(np.fromiter((digest(data[a:b]) for a, b in pairwise((0, *own))), np.uint64, len(own)))
                    ends.append(np.array(own, np.int32))
                    blank = np.frombuffer(data, np.uint8) <= 0x20
                    begins = ~blank
                    begins[1:] &= blank[:-1]
                    words.append(np.add.reduceat(begins.astype(np.int32), np.concatenate([[0], own[:-1]]).astype(np.int64), dtype=np.int32))
                sizes.append(len(ends[-1]) if data else 0)
            offsets = pa.array(np.cumsum(sizes).astype(np.int32))

            def lists(parts: list[np.ndarray], kind) -> pa.Array:
                flat = np.concatenate(parts) if parts else np.empty(0, kind)
                return pa.ListArray.from_arrays(offsets, pa.array(flat.view(kind)))

            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists(digests, np.int64), lists(ends, np.int32), lists(words, np.int32)],
                ["doc_id", "digests", "ends", "words"],
            )


def passages(min_bytes: int):
    """Spans of one document's shared chunks: rows ``doc_id, ends, words, shared`` to ``doc_id, start, end, n_words, first_doc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ends, words, shared in zip(*(batch.column(i).to_pylist() for i in range(4))):
                shared = sorted((s["pos"], s["first"]) for s in shared)
                begins = [0, *ends]
                at = 0
                while at < len(shared):
                    stop = at + 1
                    while stop < len(shared) and shared[stop][0] == shared[stop - 1][0] + 1:
                        stop += 1
                    # the whole run has to be long enough; each part of it goes to its own first document
                    long = ends[shared[stop - 1][0]] - begins[shared[at][0]] >= min_bytes
                    for first_doc, part in groupby(shared[at:stop], lambda s: s[1]) if long else ():
                        places = [pos for pos, _ in part]
                        first, last = places[0], places[-1]
                        rows.append((doc, begins[first], ends[last], sum(words[first : last + 1]), first_doc))
                    at = stop
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "end", "n_words", "first_doc"]
            )

    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``doc_id, start, end, n_words, first_doc``: byte spans whose chunks also occur in another document.

    ``first_doc`` is the smallest ``doc_id`` with these chunks: the one that keeps the passage, itself included.
    """
    docs = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).filter("doc_id is not null")
    cut = materialize(docs.mapInArrow(sketch, "doc_id long, digests array<long>, ends array<int>, words array<int>"), "chunks")
    keyed = cut.withColumn("row", F.xxhash64("digests"))
    rows = keyed.select("doc_id", "row", F.posexplode("digests").alias("pos", "digest"))
    shared = materialize(
        rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last").select("digest", "first"),
        "shared-chunks",
    )
    hits = rows.join(shared, "digest").groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "first")).alias("shared"))
    spans = keyed.select("doc_id", "row", "ends", "words").join(hits, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    return spans.select("doc_id", "ends", "words", "shared").mapInArrow(
        passages(min_bytes), "doc_id long, start long, end long, n_words long, first_doc long"
    )


def without_passages(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of all documents but the first; all columns stay."""
    own = spans.filter("doc_id <> first_doc").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")
    ).withColumnRenamed("doc_id", "_spans_of")
    data = F.encode(F.coalesce(column(text), F.lit("")), "UTF-8")
    # what stands between the spans: from the end of one to the start of the next
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(data).cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"]))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.decode(F.substring(data, a.cast("int") + 1, (b - a).cast("int")), "UTF-8")), "")
    joined = docs.join(own, column(doc_id) == own["_spans_of"], "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), column(c)).otherwise(kept).alias(c) if c == text else column(c) for c in docs.columns])

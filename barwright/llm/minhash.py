"""MinHash near-dedup over word shingles.

One-permutation hashing gives a signature from one pass over a document's shingle hashes: the hash range is cut
into bins and each bin keeps its smallest hash. Empty bins borrow from a bin that they draw at random until it is
filled (optimal densification), so short documents get full signatures. Signatures are cut into bands; documents
that share a band meet in a bucket, where each member gets one edge to the bucket's center and no pairs are made.
Every edge is checked on the full sets.

A center is the member that meets the most others over all of its bands: of a group of edited copies that is the
text nearest to their common source, to which the copies are nearer than to each other. A bucket whose members are
then one component is done: a bucket of copies costs as many comparisons as it has members.

Documents of buckets that are not one component (they share a common passage, or their center was not near to all)
are joined exactly: shingles are ordered from the rarest to the most frequent among these documents, and two sets
that are similar enough share one of their first few, early enough that what follows can still make up the overlap.
Only pairs of different components are looked at; a passage that many documents share is among the last shingles and makes no pairs.

Equal word sequences are one class from the start; only one text of a class is compared.

Defined cases
- A text without words, an empty or null one: size 0, linked with nothing.
- Fewer words than a shingle: the whole sequence is the one shingle.
- A null ``doc_id`` takes no part: its ``component_id`` is null and ``kept`` is true.
- Rows with the same ``doc_id`` and words are one document and get the same answer; ``kept`` is then true for each.
- Words of any length and texts of any length are taken whole.
- Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import column, fresh, mix
from barwright.llm.graph import components, merged
from barwright.session import materialize

BANDS, ROWS = 32, 4
CACHED_WORDS = 100_000
SLICE = 256
DRAWS = 2048


class Shingler:
    """Distinct hashes of the word shingles of texts; remembers the hashes of words it has met."""

    def __init__(self, words: int = 5):
        self.words, self.cache = words, {}

    def split(self, text: str | None) -> list[bytes]:
        # both are ASCII only on bytes: lower() knows A-Z, split() knows \x20 and \x09-\x0D
        return (text or "").encode("utf-8", "surrogatepass").lower().split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Sorted and distinct."""
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        ids = []
        for word in words:
            h = cache.get(word)
            if h is None:
                h = cache[word] = xxhash.xxh3_64_intdigest(word)
            ids.append(h)
        ids = np.array(ids, np.uint64)
        k = min(self.words, len(ids))
        rolled = np.zeros(len(ids) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
        return np.unique(rolled)


@lru_cache(4)
def draws(bins: int) -> np.ndarray:
    """For every bin the bins that it tries in turn when it is empty."""
    cells = np.arange(bins * DRAWS, dtype=np.uint64) + np.uint64(0x1234567)
    return (mix(cells * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64).reshape(bins, DRAWS)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Bin minima of sorted hashes; ``bins`` is a power of two."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    bin_of = (hashes >> shift).astype(np.int64)
    first = np.searchsorted(bin_of, np.arange(bins))
    filled = first < len(hashes)
    filled[filled] = bin_of[first[filled]] == np.flatnonzero(filled)
    out = np.zeros(bins, np.uint64)
    out[filled] = hashes[first[filled]]
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = filled[draws(bins)[empty]]
        at = tries.argmax(axis=1)
        source = draws(bins)[empty, at]
        # no filled bin among the draws (one in millions): the next filled one to the right
        missed = ~tries[np.arange(len(empty)), at]
        if missed.any():
            full = np.flatnonzero(filled)
            source[missed] = full[np.searchsorted(full, empty[missed]) % len(full)]
        out[empty] = out[source]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in sig[: bands * rows].reshape(bands, rows).T:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys.view(np.int64)


def sketcher(words: int, bands: int, rows: int):
    bins = 1 << (bands * rows - 1).bit_length()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                sizes, h1, h2, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    split = shingler.split(text)
                    hashes = shingler.hashes(split)
                    whole = xxhash.xxh3_128_intdigest(b" ".join(split))
                    sizes.append(len(hashes))
                    h1.append((whole >> 64) - (1 << 63))
                    h2.append((whole & (2**64 - 1)) - (1 << 63))
                    keys.append(band_keys(signature(hashes, bins), bands, rows) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "h1", "h2", "keys"],
                )

    return sketch


def overlap(words: int, percent: int):
    """Rows ``a, b`` of the pairs whose sets overlap enough; ``a`` is prepared once while rows come sorted by it."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, mine = Shingler(words), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                keep = []
                for i, (x, _, text_a, text_b) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)))):
                    if x != last:
                        last, mine = x, shingler.hashes(shingler.split(text_a))
                    other = shingler.hashes(shingler.split(text_b))
                    shared = len(mine) + len(other) - len(np.union1d(mine, other))
                    if shared and 100 * shared >= percent * (len(mine) + len(other) - shared):
                        keep.append(i)
                picked = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(picked), part.column(1).take(picked)], ["a", "b"])

    return check


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links, checked on whole texts ``id, text``."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(overlap(words, percent), "a long, b long")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked_classes(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, component`` of the classes that are linked with others. members: ``key, n, id`` of shared buckets of n."""
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = materialize(members.select("key", "id").join(weight, "id"), "members")
    # of the members with the greatest weight the smallest id
    centers = materialize(
        members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("c"))
        .select("key", (-F.col("c.id")).alias("center")),
        "centers",
    )
    texts = materialize(
        # dealt by id at every size: the list of ids grows with the documents
        docs.join(members.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("id"), "text"),
        "texts",
    )
    seen = materialize(
        members.join(centers, "key").filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b"))
        .distinct(),
        "pairs",
    )
    links = materialize(verified(seen, texts, words, percent), "links")
    groups = components(links)
    labelled = members.select("key", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    rest = materialize(labelled.join(mixed.select("key"), "key", "left_semi").select("id", "component").distinct(), "rest")
    pairs = prefix_pairs(rest.join(texts, "id"), words, percent).join(seen.select(*ordered("a", "b")), ["a", "b"], "left_anti")
    more = materialize(verified(materialize(pairs, "pairs"), texts, words, percent), "links")
    return merged(groups, more)


def set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingler.hashes(shingler.split(t)).view(np.int64) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "component", "items"]
                )

    return run


def prefix_pairs(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that can be similar enough. docs: ``id, component, text``."""
    sets = materialize(
        docs.select("id", "component", "text").mapInArrow(set_rows(words), "id long, component long, items array<long>"), "sets"
    )
    items = sets.select("id", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    # an item of one document alone comes first in the order and meets nothing
    often = materialize(items.groupBy("item").agg(F.count("*").alias("docs")).filter("docs > 1"), "items")
    place = F.col("n") - F.expr("count(*) over (partition by id)") + F.expr("row_number() over (partition by id order by docs, item)")
    # the larger set is looked up by its first n - ceil(n p / 100) + 1 items, the smaller one lies under its first
    # n - ceil(2 n p / (100 + p)) + 1, p the percentage: whole numbers only
    larger = materialize(
        items.join(often, "item").withColumn("place", place).filter(f"place <= n - (n * {percent} + 99) div 100 + 1")
        .select("item", "id", "component", "n", "place"),
        "prefixes",
    )
    smaller = larger.filter(f"place <= n - (2 * n * {percent} + {99 + percent}) div {100 + percent} + 1")
    larger = larger.select("item", *(F.col(c).alias(f"{c}_b") for c in ("id", "component", "n", "place")))
    # what stands before the first common item is in one set only: the rest must do for the overlap
    near = smaller.join(larger, "item").filter(
        f"(n < n_b or n = n_b and id < id_b) and component <> component_b and 100 * n >= {percent} * n_b "
        f"and {100 + percent} * (1 + least(n - place, n_b - place_b)) >= {percent} * (n + n_b)"
    ).select(*ordered("id", "id_b"))
    return near.distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    At 32 bands of 4 rows a pair at similarity 0.75 shares no band with a probability of 5e-6.
    """
    docs = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    sketch = materialize(
        docs.mapInArrow(
            sketcher(words, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"
        ),
        "sketch",
    )
    rows_with_words = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(rows_with_words.groupBy("h1", "h2").agg(F.min("doc_id").alias("id")), "classes")
    # one row of each class
    first = rows_with_words.join(
        classes.withColumnRenamed("id", "doc_id"), ["h1", "h2", "doc_id"], "left_semi"
    ).dropDuplicates(["h1", "h2"])
    keyed = materialize(first.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")), "bands")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    groups = linked_classes(keyed.join(shared, "key"), docs, words, percent)
    answer = materialize(
        classes.join(groups, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component_id")),
        "answer",
    )
    out = sketch.select("doc_id", "n_shingles", "h1", "h2").join(answer, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each group stays, the one with the smallest id. All columns.

    Rows are told apart by id and text, not by id alone. The rows of an id with several texts, and those without an id, are compared
    under keys of their own (above all ids, from a hash of id and text), so that a text is not dropped for another that bears its id. Of
    rows that repeat both id and text one is left.
    """
    key, other = fresh(docs.columns, "key", "first_text")
    own = F.xxhash64(column(doc_id), column(text), F.length(column(text)))
    texts = docs.select(column(doc_id).cast("long").alias("id"), own.alias("text")).distinct()
    clashes = materialize(texts.groupBy("id").agg(F.min("text").alias(other), F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", other), "clashes")
    ids = column(doc_id).cast("long")
    keyed = docs.join(clashes.withColumnRenamed("id", key), ids == F.col(key), "left")
    apart = ids.isNull() | (F.col(other).isNotNull() & (F.col(other) != own))
    keyed = keyed.withColumn(key, F.when(apart, F.lit(1 << 62) + F.pmod(own, F.lit(1 << 62))).otherwise(ids)).drop(other)
    judged = near_duplicates(keyed.select(F.col(key).alias("doc_id"), column(text).alias("text")), **settings)
    judged = materialize(judged.select("doc_id", "kept"), "judged")
    dropped = judged.filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    # texts are dealt by key once: what repeats meets there, tasks combine it before, and the rows that go are found in place
    once = keyed.dropDuplicates([key])
    return once.join(dropped, key, "left_anti").select(*[column(c) for c in docs.columns])

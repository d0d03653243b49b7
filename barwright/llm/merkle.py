"""Merkle manifest of a table: a root digest over all rows, and proofs that check single rows against it.

A row's leaf is the sha256 of its fields. The leaves of a source, in the order of ``doc_id``, form a tree: every ``FAN``
consecutive nodes become the digest of their digests until one is left, the source's subroot. The subroots, in the
order of their sources, form the top tree in the same way; its last node is the root.

The manifest is content-addressed. A record is found by a digest and holds the nodes below it, ``HEIGHT`` levels at a
time (729 nodes at the lowest of them), so a tree of n leaves has n / 729 records and is built in a few passes whose
size falls by that factor. A proof descends: a request starts at the root with its leaf's rank, whose digits choose the
child at each level; the children that are not chosen are the siblings. The descent collects them from the top, and the
path is reversed at the end, since folding starts at the leaf. Requests that share a path share the rows of the descent: it
goes on with one row for each record that any of them needs, and meets the single requests at the lowest records only.

Ranks are counted in parts: rows are dealt by range, numbered inside their partition, and shifted by the rows of the
partitions before. No window and no task sees a whole source.

Defined cases
- A null field counts as ``-``, an empty text as ``0:``. A null source is a tree of its own, the first one.
- Rows with a null ``doc_id`` come first in their source; rows with one id are ordered by their leaf. Equal rows each have a
  place and a proof of their own.
- A source with one row has its leaf as subroot; a table with one source has that subroot as root.
- An empty table has no root and no proofs.
- Other columns take no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.timegrid import int_div
from barwright.llm.common import bind, column, fresh
from barwright.session import materialize

FAN, HEIGHT = 3, 6
SPAN = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields, each with its length, so that different rows never read alike."""
    texts = [field.cast("string") for field in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def tree_name(source: Column) -> Column:
    """Sources as names of trees that are never null: in order, the null source first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with their ``rank`` in their tree, from 0, and the tree's ``size``."""
    # equal rows may lie on both sides of a bound: the last column deals them out
    dealt = rows.withColumn("spread", F.rand(7))
    keys = ["tree", *order, "spread"]
    placed = dealt.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).drop("spread")
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), label)
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy("tree", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = "sum(n) over (partition by tree order by part rows between unbounded preceding and 1 preceding)"
    shifts = counts.select(
        "tree", "part", (F.expr(f"coalesce({before}, 0)") - F.col("first")).alias("shift"),
        F.expr("sum(n) over (partition by tree)").alias("size"),
    )
    shifts = materialize(shifts, f"{label}-shifts")
    return placed.withColumn("part", F.shiftright("place", 33)).join(shifts, ["tree", "part"]).withColumn(
        "rank", F.col("place") + F.col("shift")
    ).drop("part", "place", "shift")


def nth(nodes: Column, at: Column) -> Column:
    """A node by its place, empty beyond the last one. By place, since a slice copies the whole list."""
    return F.coalesce(F.get(nodes, at), F.lit(""))


def levels_above(base: Column, height: Column) -> Column:
    """The nodes of a record by level, from its lowest level up to its single top."""
    def parents(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1)
        return F.transform(runs, lambda i: digest(*[nth(level, i * FAN + k) for k in range(FAN)]))

    grow = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(grow, F.array(base), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))))


def records_of(nodes: DataFrame) -> DataFrame:
    """Records over ``nodes`` (``tree, size, rank, digest``): ``tree, size, rank, digest, height, levels``."""
    powers = F.array(*[F.lit(FAN**k) for k in range(HEIGHT)])
    grouped = nodes.groupBy("tree", "size", int_div(F.col("rank"), F.lit(SPAN)).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest"))).getField("digest").alias("base")
    )
    # a tree with few nodes ends below the full height; one node needs no level at all
    height = F.size(F.filter(powers, lambda p: p < F.col("size")))
    built = grouped.withColumn("height", height).withColumn("levels", levels_above(F.col("base"), F.col("height")))
    return built.select(
        "tree", F.ceil(F.col("size") / SPAN).alias("size"), F.col("part").alias("rank"),
        F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), "height",
        F.slice("levels", F.lit(1), F.col("height")).alias("levels"),
    )


@dataclass
class Trees:
    """Written records of several trees by pass, lowest first, and the top of each tree."""

    passes: list[DataFrame]
    tops: DataFrame  # tree, rank (0), depth (its highest pass), digest


def build(nodes: DataFrame, label: str) -> Trees:
    """All records over written ``nodes``. The number of passes is the logarithm of the largest tree."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    passes: list[DataFrame] = []
    while not passes or largest > 1:
        nodes = materialize(records_of(nodes), f"{label}-{len(passes)}")
        passes.append(nodes)
        nodes, largest = nodes.select("tree", "size", "rank", "digest").filter("size > 1"), -(-largest // SPAN)
    tops = None
    for depth, records in enumerate(passes):
        own = records.filter("size = 1").select("tree", "rank", F.lit(depth).alias("depth"), "digest")
        tops = own if tops is None else tops.unionByName(own)
    return Trees(passes, tops)


def siblings(levels: Column, height: Column, child: Column) -> Column:
    """Steps from a record's top to one of its lowest nodes: at each level the nodes beside the chosen one."""
    def step(level: Column) -> Column:
        at = int_div(child, F.get(F.array(*[F.lit(FAN**k) for k in range(HEIGHT)]), level)).cast("int")
        row, digit = F.get(levels, level), at % FAN
        beside = [(k, nth(row, at - digit + k)) for k in range(FAN)]
        return F.struct(
            F.concat(*[F.when(digit > k, node).otherwise("") for k, node in beside[:-1]]).alias("left"),
            F.concat(*[F.when(digit < k, node).otherwise("") for k, node in beside[1:]]).alias("right"),
        )

    down = F.when(height > 0, F.sequence(height - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.transform(down, step)


def by_digest(records: DataFrame) -> DataFrame:
    """The store as requests see it: each digest once, with what lies below it."""
    return records.groupBy("digest").agg(F.first("height").alias("height"), F.first("levels").alias("levels"))


def descend(trees: Trees, start: DataFrame, wanted: DataFrame) -> DataFrame:
    """From ``start`` (``tree, digest`` and the path so far) to the lowest records that ``wanted`` (``tree, rank`` of leaves) needs.

    Returns ``start``'s columns with ``rank`` (of the record among the lowest ones), ``height`` and ``levels``.
    """
    carried = [name for name in start.columns if name not in ("tree", "digest", "path")]
    needed = wanted.select("tree", int_div(F.col("rank"), F.lit(SPAN)).alias("rank")).distinct()
    tops = start.join(trees.tops, ["tree", "digest"])
    front = None
    for depth in range(len(trees.passes) - 1, -1, -1):
        here = tops.filter(F.col("depth") == depth).select("tree", "digest", *carried, "path", "rank")
        front = here if front is None else front.unionByName(here)
        opened = front.join(by_digest(trees.passes[depth]), "digest")
        if not depth:
            return opened
        children = F.transform(
            F.get("levels", F.lit(0)),
            lambda child, at: F.struct(
                (F.col("rank") * SPAN + at).alias("rank"), child.alias("digest"),
                F.concat("path", siblings(F.col("levels"), F.col("height"), at)).alias("path"),
            ),
        )
        front = opened.select("tree", *carried, F.explode(children).alias("child")).select("tree", *carried, "child.*")
        asked = needed.select("tree", int_div(F.col("rank"), F.lit(SPAN ** (depth - 1))).alias("rank")).distinct()
        front = front.join(asked, ["tree", "rank"], "left_semi").select(*here.columns)


@dataclass
class Manifest:
    """The written state of a table: its leaves with their places, the records of all trees, and the root."""

    leaves: DataFrame  # tree, rank, size, doc_id, digest, and what the caller keeps beside them
    sources: DataFrame  # tree, rank of each source
    trees: Trees
    top: Trees


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, beside: dict[str, Column] | None = None) -> Manifest:
    """Builds the manifest of ``docs``. fields: the id, the source, then the rest; ``beside``: columns to keep by each leaf."""
    rows = docs.select(
        tree_name(column(fields[1])).alias("tree"), column(fields[0]).alias("doc_id"),
        leaf_digest(*[column(f) for f in fields]).alias("digest"),
        *[value.alias(name) for name, value in (beside or {}).items()],
    )
    # written first: dealing by range reads its input twice, and texts are read once
    leaves = materialize(ranked(materialize(rows, "digests"), ["doc_id", "digest"], "leaves"), "ranked-leaves")
    trees = build(leaves.select("tree", "size", "rank", "digest"), "records")
    named = trees.tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    sources = materialize(ranked(named, ["name"], "sources"), "ranked-sources")
    return Manifest(leaves, sources, trees, build(sources.select("tree", "size", "rank", "digest"), "top-records"))


def prove(made: Manifest, requests: DataFrame) -> DataFrame:
    """Checks ``requests`` (``tree, rank`` of leaves, ``claimed`` digest, other columns) against the manifest.

    Adds ``subroot, root, proof_sha256`` (digest of all siblings), ``folded_root`` and ``verified``.
    """
    root = made.top.tops.select("tree", "digest", F.col("digest").alias("root"), F.array().cast(STEPS).alias("path"))
    trees = requests.select("tree").distinct()
    asked = made.sources.join(trees.select(F.col("tree").alias("name")), "name", "left_semi").select("tree", "rank", "name", "digest")
    above = descend(made.top, root, asked).withColumn("part", F.col("rank")).drop("tree", "digest", "rank")
    tops = asked.withColumn("part", int_div(F.col("rank"), F.lit(SPAN))).join(above, "part").select(
        F.col("name").alias("tree"), "digest", F.col("digest").alias("subroot"), "root",
        F.concat("path", siblings(F.col("levels"), F.col("height"), F.col("rank") % SPAN)).alias("path"),
    )
    lowest = descend(made.trees, materialize(tops, "subroots"), requests.select("tree", "rank"))
    lowest = lowest.withColumnRenamed("rank", "part").drop("digest")
    met = requests.withColumn("part", int_div(F.col("rank"), F.lit(SPAN))).join(lowest, ["tree", "part"])
    down = F.concat("path", siblings(F.col("levels"), F.col("height"), F.col("rank") % SPAN))

    def folded(path: Column) -> Column:
        return F.struct(
            F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
            F.aggregate(path, F.col("claimed"), lambda node, s: digest(s["left"], node, s["right"])).alias("folded_root"),
        )

    checked = met.withColumn("checked", bind(F.reverse(down), folded))
    return checked.select(*requests.columns, "subroot", "root", "checked.*").withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def verify_texts(docs: DataFrame, found: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Checks every row of ``docs`` with the text ``found`` in place of its own against the manifest of ``docs``."""
    fields = tuple({"doc_id": doc_id, "text": text}.get(f, f) for f in FIELDS)
    (other,) = fresh(docs.columns, "found")
    docs = docs.withColumn(other, found)
    given = leaf_digest(*[column(other if f == text else f) for f in fields])
    changed = F.when(~column(other).eqNullSafe(column(text)), given)
    made = manifest(docs, fields, {"changed": changed})
    requests = made.leaves.select("tree", "rank", "doc_id", F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("claimed"))
    return prove(made, requests).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )

"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of the edges ``a, b``: component is the smallest id that can be reached.

    Each pass hands every node the smallest label among its neighbours and then replaces a label by its own
    label, so long chains halve. Labels are written after each pass. Both sides of each join are exchanged for it
    alone, so a hub's rows can be split over tasks.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
            "id", F.least("id", "m").alias("component")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = materialize(step.join(roots, "component").select("id", F.col("root").alias("component"), "old"), "labels")
        labels = jumped.select("id", "component")
        if jumped.filter("component <> old").isEmpty():
            return labels


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links ``a, b``: solved on the graph of the components that the links touch."""
    if links.isEmpty():
        return groups
    for end in ("a", "b"):
        links = links.join(groups.select(F.col("id").alias(end), F.col("component").alias("c")), end, "left").withColumn(
            end, F.coalesce("c", end)
        ).drop("c")
    joined = components(materialize(links.distinct(), "contracted")).select(F.col("id").alias("component"), F.col("component").alias("root"))
    known = groups.join(joined, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    # nodes that had no link so far are components of their own
    new = joined.join(groups.select(F.col("component")).distinct(), "component", "left_anti")
    return materialize(known.unionAll(new.select(F.col("component").alias("id"), F.col("root").alias("component"))), "labels")

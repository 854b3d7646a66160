"""Connected components over a table of links, by contraction. No link or label ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) for every node of ``links``; the id is the smallest node of its component.

    Every round lets each node point to its neighbour of least random priority, follows the pointers twice and contracts
    the links, which shrinks them by a constant share whatever the shape of the graph. Hubs are safe: the minimum is
    pre-aggregated on the map side and AQE may split the joins. Self-links and repeats are allowed, nulls ignored.
    """
    edges = materialise(
        links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    original = edges
    maps: list[DataFrame] = []
    salt = 1
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("p"), F.col(c).alias("id"))  # noqa: B023, E731
        parent = materialise(
            both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
            .select("node", F.when(F.col("m") < rank("node"), F.col("m.id")).otherwise(F.col("node")).alias("to")),
            "parent",
        )
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        jumped = materialise(parent.join(up, "to").select("node", F.col("to2").alias("to")), "jump")
        at = lambda c: jumped.select(F.col("node").alias(c), F.col("to").alias(c + "2"))  # noqa: B023, E731
        smaller = materialise(
            edges.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            "links",
        )
        release(parent)
        maps.append(jumped)
        if edges is not original:
            release(edges)
        edges = smaller
        salt += 1
    nodes = original.select(F.col("a").alias("node")).union(original.select("b")).distinct()
    if not maps:
        return nodes.select("node", F.col("node").alias("component_id"))
    labels = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), F.col("to").alias("next"))
        labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    labels = materialise(labels, "labels")
    release(*maps, original)
    least = labels.groupBy("root").agg(F.min("node").alias("component_id"))
    return labels.join(least, "root").select("node", "component_id")

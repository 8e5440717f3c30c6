"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregate and a join on the node, so a node with very many links is pre-aggregated
map-side and its join partition can be split (the other side has one row per node). The number of
rounds grows with the logarithm of the longest chain. Every round is written to the shared scratch
folder: lineage stays short and lost executors cost only their tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazeflow.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(digest, 20)), F.bit_xor(digest)).first())


def contracted(links: DataFrame, rounds: int) -> DataFrame:
    """(node, root): a node reachable from each node, the least that a fixed number of steps finds.

    Nodes with one root are connected; connected nodes may still have different roots. Whether a link
    ends in null, repeats or leads to its own node doesn't matter, as in `components`.
    """
    edges = links.select("a", "b").filter("a <> b")
    for _ in range(rounds):
        starred = _large_star(edges).filter("a <> b").distinct()
        edges = materialize(_small_star(starred).filter("a <> b").distinct(), "links")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
    return both.groupBy("node").agg(F.min("root").alias("root"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the least node reachable from it.

    Nodes without a link to another node are absent. Links with a null end are ignored; repeated
    links, links given in both directions and an empty table are fine.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    before = _state(edges)
    while before[0]:
        starred = _large_star(edges).filter("a <> b").distinct()
        edges = materialize(_small_star(starred).filter("a <> b").distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

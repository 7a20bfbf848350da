"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroloom.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node that links reach.

    Large-star and small-star steps in turn until nothing changes. The smallest neighbour of a node comes from a
    partial aggregation and is joined back, so a hub of any degree is never gathered. Each round is written to the
    shared folder, and the round before it deleted.

    Rows that repeat a link count once, links of a node with itself and links with a null don't count; a node that
    occurs in no other link has no row. An empty table gives an empty result; other columns are never read.
    """
    edges = written(oriented(links.select("a", "b")), "edges")
    held = fingerprint(edges)
    while held[0]:
        before, edges = edges, written(oriented(small_star(large_star(edges))), "edges")
        discard(before)
        now = fingerprint(edges)
        if now == held:
            break
        held = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(roots)


def oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node a to the smaller b."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
    return row.n, row.s


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of those."""
    down = oriented(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))

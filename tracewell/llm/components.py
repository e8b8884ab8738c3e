"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two grouped minima and two joins; no list of neighbours is built, so a node with very many edges
is pre-aggregated and its join can be split. The minima of few edges are broadcast, which leaves a step three
shuffles. Each step is written to the shared folder, which cuts the lineage and survives lost executors. The number
of steps grows with the logarithm of the longest path; a table of stars takes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import BROADCAST_BYTES, stored

# Bytes of one (node, minimum) in a broadcast, with what its hash table adds.
ROW_BYTES = 64


def _open_nodes(edges: DataFrame) -> tuple[int, int]:
    """(rows, nodes that keep the edges from being stars: with two edges down, or edges both up and down)."""
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("lo", F.lit(None), F.lit(1)))
    nodes = ends.groupBy("node").agg(
        F.count("down").alias("rows"), F.min("down").alias("least"), F.max("down").alias("most"), F.max("up").alias("up")
    )
    is_open = (F.col("least") < F.col("most")) | (F.col("least").isNotNull() & (F.col("up") == 1))
    rows, found = nodes.agg(F.sum("rows"), F.count_if(is_open)).first()
    return int(rows or 0), int(found)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge (a, b) touches and that is not its own component.

    The component is the smallest node that can be reached. Nodes without a row are their own component;
    null ends and loops count for nothing; an empty table gives an empty result.
    """
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = stored(now.where("a is not null and b is not null and hi <> lo").distinct(), "edges")
    while True:
        rows, left = _open_nodes(now)
        if not left:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        small = F.broadcast if rows * ROW_BYTES <= BROADCAST_BYTES else lambda df: df
        # Large star: an edge's upper node goes to the least neighbour of its lower one.
        above = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = now.join(small(above), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        # Small star: all lower neighbours of a node, and itself, go to the least of them.
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small(lower), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        now = stored(moved.union(lower.select("hi", "m")).distinct(), "edges")

"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is one node of its component, the same for all its nodes.

    Each round maps every node to the least of itself and its neighbours in the order of a hash, follows that map once
    more, and contracts the graph along it. In a random order a constant share of a component's nodes is nobody's least
    neighbour, chains included, so the expected number of rounds is logarithmic, on ever smaller tables; a node with very
    many links costs one row for each task, as its minimum is combined on the map side. Every round's tables are
    checkpointed, so lost executors cost one round. Empty links give an empty result.
    """
    edges = checkpointed(links.select("a", "b").filter("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        near = checkpointed(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("root")))
        step = checkpointed(_follow(near, near))
        roots = step if roots is None else checkpointed(_follow(roots, step))
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = checkpointed(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots


def _follow(roots: DataFrame, step: DataFrame) -> DataFrame:
    onward = step.select(F.col("node").alias("root"), F.col("root").alias("onward"))
    return roots.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))

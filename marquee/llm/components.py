"""Connected components of a large graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import cut, lookup


def state_of(links: DataFrame) -> tuple:
    """The number of links and sums of their hashes, which differ if the links do."""
    low, high = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(F.xxhash64("u", "v"), 33)
    return tuple(links.agg(F.count("*"), F.sum(low), F.sum(high)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node that can be reached.

    Each round joins every node's smallest neighbour to its other neighbours (the large star), then to its smaller
    ones only (the small star); rounds grow as the logarithm of the longest path. A hub's neighbours aren't gathered:
    the smallest comes from a combining aggregate and is joined back with hot nodes apart. Every round is cut, so a
    lost executor repeats one round at most. Loops and repeated edges are allowed; nodes must not be null.
    """
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    nodes = cut(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    before = state_of(links)
    while before[0]:
        both = cut(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("w")), "least")
        large = cut(lookup(both, least, "u", "w").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large-star")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")), "least")
        small = lookup(large, least, "u", "w").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(small.select("e.u", "e.v").filter("u != v").distinct(), "small-star")
        links, last = after, before
        before = state_of(links)
        if before == last:
            break
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

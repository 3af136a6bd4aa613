"""Connected components of links, by alternating large-star and small-star rounds.

Links stay in the shared folder; only the counts of changed links come to the driver.  Each round
sends a node's links to its least neighbour, after folding equal links before the shuffle.  Nodes with
over a thousandth of all links look their least neighbour up in a broadcast, so no task gathers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import HOT, join_by_class, staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) names; root is the least of its component."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "links-least")
        # Large star: a node's greater neighbours link to its least one.
        hot = F.col("n") * HOT > 2 * edges.count()
        large = join_by_class(both.where("v > u"), least, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "links-large")
        # Small star: a node and its lesser neighbours link to the least of them.
        low = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "links-low")
        small = join_by_class(large, low, ["u"], F.col("n") * HOT > large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links-small")
        # Done when every node has one link, and to a root.
        loose = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = loose or after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        edges = after
        if not chained:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

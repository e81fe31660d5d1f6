"""Connected components of a graph of any size, on DataFrames.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Nothing but one count is sent to the
driver in each round, and each round's edges are written to the shared folder.
A node with very many links is no single task's work: its least neighbour is
found by a partial aggregate, and the join that hands it out is one whose large
partitions adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Each linked node with the smallest node that it reaches: (node, root).

    ``edges`` has the columns a and b of one ordered type. Nodes without a link
    to another node don't occur in the result. No edges: an empty result.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = materialise(small, "edges")
        # every node has one link, to a node that has none: nothing changes any more
        stars = new.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        roots = stars.select("b").distinct()
        if not new.limit(1).count() or not stars.where("n > 1").limit(1).count() and not stars.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").limit(1).count():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new

"""Connected components of a graph of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.checkpoints import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable over edges (a, b). Labels fall to the least neighbour's and jump to their own label's, so rounds are few; a checkpoint a round."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        further = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = cut(moved.join(further, "comp").select("node", "old", F.least("comp", "far").alias("comp")))
        labels = moved.select("node", "comp")
        if not moved.filter("comp <> old").limit(1).count():
            return labels

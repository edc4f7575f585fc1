"""Connected components over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.storage import discard, written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), as (node, comp): comp is the smallest node reachable.

    Every round takes for each node the smallest label among its own and its neighbours', then
    follows the label's own label once, so a path of length n takes O(log n) rounds. Labels and edges
    stay distributed tables; the driver sees whether a round changed anything.
    """
    once = written(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = once.union(once.select("b", "a"))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = written(spark, first.select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        near = labels.join(seen, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        moved = near.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "old")
        before, moved = labels, written(spark, moved, "labels")
        labels = moved.select("node", "comp")
        done = moved.where("comp <> old").isEmpty()
        discard(spark, before)
        if done:
            discard(spark, once)
            return labels

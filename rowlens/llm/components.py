"""Connected components of a graph given by its edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of ``edges`` (a, b: long).

    Each round takes the smallest label among a node's neighbours and then that
    label's own label. Labels only fall and rounds go on until none does, so the
    result is exact; each round is a written table, which a lost executor cannot
    take away. Minima are combined before the shuffle; a node with very many
    edges meets a single label row in the join, which adaptive execution splits.
    """
    both = written(edges.select("a", "b").unionAll(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("moved", F.lit(True)), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = least.join(jump, "to", "left").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("was")).alias("moved"))
        before, labels = labels, written(after, "labels")
        drop_written(before)
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "label")

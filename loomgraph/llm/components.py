"""Connected components by joins: smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b: long): label is the smallest node that
    can be reached. Each round takes the smallest label among the neighbours, then the
    label's own label, and is a written table; the driver sees a count of changes. A
    node with very many edges is one row on the labels' side, so its rows can be split."""
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        now = written(step.join(jump, "label").select("node", "_old", F.least("label", "_up").alias("label")), "labels")
        changed = now.where("label <> _old").limit(1).count()
        labels = now.drop("_old")
        if not changed:
            return labels

"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, component): the least node that each node of an edge reaches.

    Each round takes the least label among neighbours and then the label's own label, and is written to the shared
    folder, so that a lost executor costs a round at most. Star-like groups end in two or three rounds. Labels are
    combined on the map side, so a hub's edges are not gathered. No edges give no rows.
    """
    both = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(stepped.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "cc-labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")

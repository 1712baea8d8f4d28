"""Connected components of links by hooking and pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import discard, has_rows, written


def components(links: DataFrame) -> DataFrame:
    """node, label for each end of the links (a, b): label is the smallest node of its component.

    Each round hooks every label to the least label beside it and then jumps along those hooks to their roots, in steps
    that double. A root that stays is the least of its neighbours and has taken at least one of them, so every two rounds at
    most half of the labels of a component are left. Only links between different labels go on. Nodes without links
    have no row.
    """
    live = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    live = written(live, "label-links")
    labels = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while has_rows(live):
        up = written(live.groupBy(F.col("a").alias("label")).agg(F.least(F.first("a"), F.min("b")).alias("up")).withColumn("moved", F.lit(True)), "hooks")
        while has_rows(up.where("moved")):
            far = up.select(F.col("label").alias("up"), F.col("up").alias("far"))
            new = written(up.join(far, "up").select("label", F.col("far").alias("up"), (F.col("far") < F.col("up")).alias("moved")), "hooks")
            discard(up)
            up = new
        root = up.select("label", "up")
        moved = written(labels.join(root, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        end = lambda x: root.select(F.col("label").alias(x), F.col("up").alias(f"up_{x}"))
        ends = live.join(end("a"), "a").join(end("b"), "b").where("up_a <> up_b")
        ends = written(ends.select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct(), "label-links")
        discard(labels, live, up)
        labels, live = moved, ends
    return labels

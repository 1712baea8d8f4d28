"""What classes, interfaces, enums and traits have from others above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.model import Graph
from depgraph.tables import discard, has_rows, stored

KINDS = ("declaration-extends", "declaration-implements", "declaration-trait-use")


def ancestors(graph: Graph, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """id, ancestor, stated, inherited: all that each symbol extends, implements or uses, directly or not.

    stated: an edge says so. inherited: something else that the symbol extends, implements or uses has it. Each round joins what
    was found last with all that was found, so rounds grow with the logarithm of the longest chain. A symbol on a cycle is its own ancestor.
    """
    up = stored(graph.edges.where(F.col("kind").isin(*kinds)).select(F.col("src").alias("id"), F.col("dst").alias("ancestor")).distinct(), "parents")
    known = new = up
    while has_rows(new):
        # chains of any length up to the double: a new one after any, or any after a new one
        step = lambda a, b: a.select("id", F.col("ancestor").alias("mid")).join(b.select(F.col("id").alias("mid"), "ancestor"), "mid").select("id", "ancestor")
        found = step(new, known).unionByName(step(known, new)).distinct()
        new = stored(found.join(known, ["id", "ancestor"], "left_anti"), "ancestors")
        whole = stored(known.unionByName(new), "ancestors")
        if known is not up:
            discard(known)
        known = whole
    through = up.select("id", F.col("ancestor").alias("mid")).join(known.select(F.col("id").alias("mid"), "ancestor"), "mid").where("mid <> ancestor").select("id", "ancestor").distinct().withColumn("inherited", F.lit(True))
    stated = up.withColumn("stated", F.lit(True))
    both = known.join(stated, ["id", "ancestor"], "left").join(through, ["id", "ancestor"], "left")
    return both.select("id", "ancestor", F.coalesce("stated", F.lit(False)).alias("stated"), F.coalesce("inherited", F.lit(False)).alias("inherited"))


def direct(graph: Graph, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """id, ancestor: all less what is inherited, as reflection tells what a symbol has by itself."""
    return ancestors(graph, kinds).where("NOT inherited").select("id", "ancestor")

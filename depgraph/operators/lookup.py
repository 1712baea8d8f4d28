"""Point lookups and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions import is_reverse
from depgraph.model import Graph
from depgraph.tables import numbered

DIRECTIONS = ("uses", "used-by")


class NotFound(LookupError):
    """No node has this id."""


def node(graph: Graph, id: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == id)


def target(graph: Graph, id: str) -> DataFrame:
    """The node with exactly this id; an error if there is none."""
    found = node(graph, id).limit(1)
    if not found.take(1):
        raise NotFound(f"Target not found: {id}")
    return found


def edge(graph: Graph, src: str, dst: str, kind: str | None = None) -> DataFrame:
    """The first edge from src to dst, of one kind if it is given."""
    found = graph.edges.where((F.col("src") == src) & (F.col("dst") == dst))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    return found.orderBy("seq", "kind").limit(1)


def out_edges(graph: Graph, src: str) -> DataFrame:
    """All edges from a node, forward and reverse, in order."""
    return graph.edges.where(F.col("src") == src).orderBy("seq", "kind", "dst")


def in_edges(graph: Graph, dst: str) -> DataFrame:
    """All edges to a node, in order; a stored graph reads one bucket of those that lie by their targets."""
    return getattr(graph, "incoming", graph.edges).where(F.col("dst") == dst).orderBy("seq", "kind", "src")


def nodes(graph: Graph) -> DataFrame:
    """All nodes in the order in which they came, with their place from 1."""
    return numbered(graph.nodes, "seq", "id")


def traversable(edges: DataFrame, direction: str) -> DataFrame:
    """Forward edges for ``uses``, reverse edges for ``used-by``."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    reverse = is_reverse(F.col("kind"))
    return edges.where(reverse if direction == "used-by" else ~reverse)

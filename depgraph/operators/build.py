"""Graph construction: de-duplication, placeholders, inverse edges, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.functions import inverse_kind
from depgraph.model import Graph
from depgraph.tables import discard, has_rows, recorded
from depgraph.tables import settled as stored


class NodeExists(ValueError):
    """A node with this id is there already and isn't a placeholder."""


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the first concrete one in the order of seq, or the first placeholder if there is none."""
    whole = F.struct(*nodes.columns)
    order = F.struct((F.col("kind") == "unknown").cast("int"), "seq", "kind")
    return nodes.groupBy("id").agg(F.min_by(whole, order).alias("first")).select("first.*")


def strict_nodes(nodes: DataFrame) -> DataFrame:
    """Like ``first_nodes``, but two concrete rows of one id are an error."""
    twice = nodes.where("kind <> 'unknown'").groupBy("id").count().where("count > 1").select("id").take(1)
    if twice:
        raise NodeExists(f"Node already exists: {twice[0][0]}")
    return first_nodes(nodes)


def first_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, kind, dst): the first in the order of seq, with its own file."""
    return edges.groupBy("src", "kind", "dst").agg(*_first(edges.columns)).select(edges.columns)


def _first(columns: list[str]) -> list[Column]:
    """The rest of the first edge by its columns, so that what no one asks for is neither shuffled nor compared."""
    order = F.struct("seq", F.coalesce("file.line", F.lit(0)))
    rest = [c for c in columns if c not in ("pair", "src", "kind", "dst", "reverse", "seq")]
    return [F.min("seq").alias("seq"), *([F.min("reverse").alias("reverse")] if "reverse" in columns else []), *(F.min_by(c, order).alias(c) for c in rest)]


#: Places of placeholders: behind those of all other nodes, in the order of the edges that name them first.
_BEHIND = 1 << 61


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An unresolved node of kind unknown for each end of an edge that has no node, in the order of the first edge of each,
    sources before targets."""
    end = lambda c, side: edges.select(F.col(c).alias("id"), (F.col("seq") * 2 + (_BEHIND + side)).alias("seq"))
    ends = end("src", 0).union(end("dst", 1)).groupBy("id").agg(F.min("seq").alias("seq"))
    missing = ends.join(nodes.select("id"), "id", "left_anti")
    typed = {f.name: f.dataType for f in nodes.schema}
    values = {"id": F.col("id"), "kind": F.lit("unknown"), "resolved": F.lit(False), "seq": F.col("seq")}
    return missing.select(*(values.get(c, F.lit(None)).cast(typed[c]).alias(c) for c in nodes.columns))


def inverted(edges: DataFrame) -> DataFrame:
    """The reverse edge of each forward edge, in the order of the forward ones; several kinds between two nodes that
    have the same inverse give one edge. Reverse edges have no inverse and are an error."""
    if has_rows(edges.where("reverse")):
        raise ValueError("reverse edges can't be inverted")
    swapped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "kind": inverse_kind(F.col("kind")), "reverse": F.lit(True)})
    return first_edges(swapped)


def _pair() -> Column:
    """A number that both edges between two nodes have, whichever way they go."""
    return F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))


def paired_ways(edges: DataFrame) -> DataFrame:
    """The edges of ``both_ways(first_edges(edges))`` and their pair, by which they lie: items are shuffled once, and neither
    inverse edges nor what compares both ways shuffles them again."""
    dealt = edges.repartition(_pair()).withColumn("pair", _pair())  # made again, not shuffled
    columns = [c for c in edges.columns if c not in ("src", "kind", "dst", "reverse", "seq")]
    rest = [F.col(c) for c in columns]
    plain = F.struct("src", "kind", "dst", F.lit(False).alias("reverse"), (F.col("seq") * 2).alias("seq"), *rest)
    back = F.struct(F.col("dst").alias("src"), inverse_kind(F.col("kind")).alias("kind"), F.col("src").alias("dst"), F.lit(True).alias("reverse"), (F.col("seq") * 2 + 1).alias("seq"), *rest)
    ways = dealt.select("pair", F.explode(F.array(plain, back)).alias("way")).select("pair", "way.*")
    return ways.groupBy("pair", "src", "kind", "dst", "reverse").agg(*_first(["seq", *columns])).select("pair", *edges.columns)


def both_ways(forward: DataFrame) -> DataFrame:
    """Forward edges, once each, at even places and their inverses at the odd places that follow."""
    return paired_ways(forward).drop("pair")


def assemble(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> Graph:
    """A graph from items: nodes (first or strict), forward edges once each, their inverses, and placeholders."""
    known = strict_nodes(nodes) if strict else first_nodes(nodes)
    paired = paired_ways(edges)
    return Graph(known.unionByName(placeholders(known, edges)), paired.drop("pair"), paired)


def forward_edges(graph: Graph) -> DataFrame:
    """The edges as they were added."""
    return graph.edges.where("NOT reverse").withColumn("seq", F.expr("seq div 2"))


def kept(graph: Graph) -> Graph:
    """The graph with nodes and edges written, unless they are tables already."""
    table = lambda df, name: df if hasattr(df, "stored_at") else stored(df, name)
    return Graph(table(graph.nodes, "nodes"), table(graph.edges, "edges"))


def _renumbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in the same order, at the least places that tasks can give without knowing of each other."""
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "renumbered")


def add_nodes(graph: Graph, nodes: DataFrame) -> Graph:
    """Add nodes behind those that are there; one that was a placeholder takes its place. Concrete nodes that are there already are an
    error, by whatever they would be replaced."""
    taken = graph.nodes.where("kind <> 'unknown'").select("id")
    clash = nodes.join(taken, "id", "left_semi").select("id").take(1)
    if clash:
        raise NodeExists(f"Node already exists: {clash[0][0]}")
    there, new = _renumbered(graph.nodes, "seq", "id"), _renumbered(strict_nodes(nodes), "seq", "id")
    top = there.agg(F.max("seq")).first()[0]
    base = 0 if top is None else top + 1
    old = there.select("id", F.col("seq").alias("old"))
    placed = new.join(old, "id", "left").withColumn("seq", F.coalesce("old", F.col("seq") + base)).drop("old").select(there.columns)
    return Graph(there.join(new.select("id"), "id", "left_anti").select(there.columns).unionByName(placed), graph.edges)


#: Places from here on are numbered anew when edges are added, so that no number of merges runs out of places.
_FAR = 1 << 60


def add_edges(graph: Graph, edges: DataFrame) -> Graph:
    """Add forward edges after those that are there, with inverses and placeholders."""
    there = forward_edges(graph)
    last, top = there.agg(F.max("seq")).first()[0], edges.agg(F.max("seq")).first()[0]
    if (last or 0) + (top or 0) + 1 >= _FAR:
        order = ("seq", "src", "kind", "dst")
        there, edges = _renumbered(there, *order), _renumbered(edges, *order)
        last = there.agg(F.max("seq")).first()[0]
    base = 0 if last is None else last + 1
    edges = edges.withColumn("seq", F.col("seq") + base)
    return Graph(graph.nodes.unionByName(placeholders(graph.nodes, edges)), both_ways(there.unionByName(edges)))


def merge(graph: Graph, other: Graph) -> Graph:
    """Both graphs as one, written; a node of ``other`` whose id is concrete in ``graph`` is an error. Inputs stay as they are."""
    with recorded() as made:
        graph, other = kept(graph), kept(other)
        merged = kept(add_edges(kept(add_nodes(graph, other.nodes)), forward_edges(other)))
    discard(*(t for t in made if t is not merged.nodes and t is not merged.edges))
    return merged


def merge_conflicts(graph: Graph, other: Graph) -> DataFrame:
    """id, kind, other_kind of the nodes for which ``merge`` is an error."""
    mine = graph.nodes.where("kind <> 'unknown'").select("id", "kind")
    return mine.join(other.nodes.select("id", F.col("kind").alias("other_kind")), "id")

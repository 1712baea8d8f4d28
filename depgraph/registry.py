"""Analysers, collectors and reporters of a user's own, by name beside those that are here.

An analyser makes a graph of a path. A collector makes items of tokens that stand in their classes and functions, as one more set of
DataFrame operations over them; its items are numbered behind those of the same place that the extraction finds. A reporter makes lines of a graph.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.model import Graph
from depgraph.operators.lookup import target, traversable
from depgraph.operators.report import report


@runtime_checkable
class Analyzer(Protocol):
    def __call__(self, spark: SparkSession, path: str, **options) -> Graph:
        """The graph of what lies at the path."""


@runtime_checkable
class Collector(Protocol):
    def __call__(self, tokens: DataFrame) -> DataFrame:
        """tokens: path, pos, line, tok, p1, p2, n1 to n4 (neighbours), ns, class, name (of the function around), source.
        Edge items: path, pos, line, src, kind, dst."""


@runtime_checkable
class Reporter(Protocol):
    def __call__(self, graph: Graph, root: str, direction: str = "uses", level: int | None = None) -> DataFrame:
        """ord (orders the lines), line."""


class Registry(dict[str, Callable]):
    """name -> function of a protocol. ``register`` may decorate; a name can't be taken twice."""

    def __init__(self, protocol: type):
        super().__init__()
        self.protocol = protocol

    def register(self, name: str):
        def add(function: Callable) -> Callable:
            if name in self:
                raise ValueError(f"{name} is registered already")
            if not isinstance(function, self.protocol):
                raise TypeError(f"{name} can't be called")
            self[name] = function
            return function

        return add

    def find(self, name: str) -> Callable:
        if name not in self:
            raise LookupError(f"{name} is none of {', '.join(sorted(self))}")
        return self[name]


ANALYZERS, COLLECTORS, REPORTERS = Registry(Analyzer), Registry(Collector), Registry(Reporter)


@ANALYZERS.register("php")
def php(spark: SparkSession, path: str, includes: tuple[str, ...] = (), excludes: tuple[str, ...] = (), collectors: tuple[str, ...] = ()) -> Graph:
    """Files of PHP text below the path; collectors: names of registered ones that add edges."""
    from depgraph.sources.files import scan
    from depgraph.sources.php import graph_of

    return graph_of(scan(spark, [path], includes, excludes), [COLLECTORS.find(c) for c in collectors])


@ANALYZERS.register("debug")
def debug(spark: SparkSession, path: str, depth: int = 5, seed: int | None = None) -> Graph:
    """A synthetic graph; the path is not looked at."""
    import random

    from depgraph.sources.synth import synthetic_graph

    return synthetic_graph(spark.range(1).selectExpr(f"{random.getrandbits(62) if seed is None else seed} AS seed"), depth)


@ANALYZERS.register("stored")
def stored(spark: SparkSession, path: str) -> Graph:
    """A graph written before."""
    from depgraph.sources.stored import open_graph

    return open_graph(spark, path)


@REPORTERS.register("tree")
def tree(graph: Graph, root: str, direction: str = "uses", level: int | None = None) -> DataFrame:
    return report(graph, root, direction, level)


@REPORTERS.register("dot")
def dot(graph: Graph, root: str, direction: str = "uses", level: int | None = None) -> DataFrame:
    """The part of the graph that the root reaches, as a drawing in the DOT language: a line for each node and each link, once,
    with the kinds of its edges. Lines come from Spark as they are; nothing is laid out here."""
    from depgraph.operators.traverse import reach

    found = reach(graph, target(graph, root), direction, level).select("id", "depth")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    nodes = found.join(graph.nodes.select("id", "kind"), "id").select(F.concat(F.lit("1"), "id").alias("ord"), F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [tooltip="), quoted(F.col("kind")), F.lit("];")).alias("line"))
    inside = found.join(graph.nodes.where("kind NOT IN ('builtin', 'unknown')").select("id"), "id", "left_semi")
    inside = inside if level is None else inside.where(F.col("depth") < level)
    links = traversable(graph.edges, direction).join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    kinds = links.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    lines = kinds.select(F.concat(F.lit("2"), "src", F.lit("\t"), "dst").alias("ord"), F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.col("kinds")), F.lit("];")).alias("line"))
    ends = graph.nodes.sparkSession.createDataFrame([("0", "digraph {"), ("3", "}")], "ord string, line string")
    return ends.unionByName(nodes).unionByName(lines).orderBy("ord")

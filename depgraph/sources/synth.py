"""A generator of graphs of any size, level by level, from seeds in a table: the same seeds give the same graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.model import EDGES, NODES, Graph
from depgraph.operators.build import assemble
from depgraph.tables import stored

# What each kind of node has, how often at least and at most; at most 1 means half of the time,
# unless it is at least 1. "type" is any kind that a type may name.
GRAMMAR = (
    ("class", "declaration-method", "method", 0, 5),
    ("class", "declaration-property", "property", 0, 5),
    ("class", "declaration-constant", "constant", 0, 5),
    ("class", "declaration-implements", "interface", 0, 5),
    ("class", "declaration-trait-use", "trait", 0, 5),
    ("class", "declaration-extends", "class", 0, 1),
    ("interface", "declaration-method", "method", 0, 5),
    ("interface", "declaration-constant", "constant", 0, 5),
    ("interface", "declaration-extends", "interface", 0, 1),
    ("trait", "declaration-method", "method", 0, 5),
    ("trait", "declaration-property", "property", 0, 5),
    ("method", "declaration-type-return", "type", 1, 1),
    ("method", "declaration-type-parameter", "type", 0, 5),
    ("method", "method-call", "method", 0, 1),
    ("method", "static-call", "method", 0, 1),
    ("method", "function-call", "function", 0, 1),
    ("method", "property-access", "property", 0, 1),
    ("method", "static-property-access", "property", 0, 1),
    ("method", "const-fetch", "constant", 0, 1),
    ("method", "instantiation", "class", 0, 1),
    ("function", "declaration-type-return", "type", 1, 1),
    ("function", "declaration-type-parameter", "type", 0, 5),
    ("function", "function-call", "function", 0, 1),
    ("property", "declaration-type-property", "type", 1, 1),
    ("enum", "declaration-enum-case", "enum_case", 0, 5),
)
ROOTS, TYPES = ("class", "interface", "trait", "function"), ("builtin", "class", "enum", "interface", "trait")
_SYLLABLES = ("Al", "Be", "Cor", "Da", "El", "Fi", "Gra", "Ho", "In", "Jo", "Ka", "Lu", "Mo", "Ne", "Or", "Pa")
_MEMBERS = ("method", "property", "constant", "enum_case")


def _pick(h: Column, salt: int, of: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(len(of))) + 1).cast("int"))


def _word(h: Column, salt: int) -> Column:
    return F.concat(*(_pick(h, salt + i, _SYLLABLES) for i in range(2)))


def node_id(h: Column, kind: Column) -> Column:
    """A name of the kind's form: namespaces and a short name, and for members an owner of its own."""
    spaces = F.when(F.pmod(h, F.lit(2)) == 0, _word(h, 10)).otherwise(F.concat(_word(h, 10), F.lit("\\"), _word(h, 20)))
    suffix = F.concat_ws("", *(F.when(kind == k, F.lit(s)) for k, s in (("class", "Class"), ("interface", "Interface"), ("trait", "Trait"), ("enum", "Enum"), ("function", "Function"), ("builtin", "Builtin"), ("method", "Method"), ("property", "Property"), ("constant", "_CONST"), ("enum_case", "_CASE"))))
    short = F.concat(_word(h, 30), F.lower(F.hex(F.pmod(h, F.lit(1 << 32)))), suffix)
    return F.when(kind.isin(*_MEMBERS), F.concat(spaces, F.lit("\\"), _word(h, 40), F.lit("Class::"), short)).otherwise(F.concat(spaces, F.lit("\\"), short))


def synthetic_items(seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Node and edge items grown from each seed (column seed: long) down to ``depth`` levels; level 0 is the root only.

    Each level is one join of the last with the grammar, which has a fixed number of rows.
    """
    spark = seeds.sparkSession
    rules = spark.createDataFrame([(i, *rule) for i, rule in enumerate(GRAMMAR)], "rule int, parent string, edge string, child string, least int, most int")
    seed = F.col("seed").cast("long")
    level = stored(seeds.where("seed IS NOT NULL").select(F.xxhash64(seed).alias("h"), _pick(F.xxhash64(seed), 1, ROOTS).alias("kind")), "synth")
    file = F.struct(F.lit("synthetic").alias("path"), (F.pmod("h", F.lit(100)) + 1).cast("int").alias("line"), F.lit(1).alias("column"), F.lit("synthetic").alias("name"))
    node = lambda df, n: df.select(node_id(F.col("h"), F.col("kind")).alias("id"), "kind", F.lit(True).alias("resolved"), file.alias("file"), (F.lit(n << 40) + F.pmod("h", F.lit(1 << 40))).cast("long").alias("seq"))
    nodes, edges = node(level, 0), None
    for n in range(1, depth + 1):
        grown = level.join(F.broadcast(rules), F.col("kind") == F.col("parent"))
        chance = F.pmod(F.xxhash64("h", "rule"), F.col("most") - F.col("least") + 1)
        each = grown.withColumn("times", (F.col("least") + chance).cast("int")).where("times > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times"))))
        made = each.select(F.col("h").alias("from_h"), F.col("kind").alias("from_kind"), "edge", "child", F.xxhash64("h", "rule", "i").alias("h"))
        made = stored(made.withColumn("kind", F.when(F.col("child") == "type", _pick(F.col("h"), 2, TYPES)).otherwise(F.col("child"))), "synth")
        ends = made.select(node_id(F.col("from_h"), F.col("from_kind")).alias("src"), F.col("edge").alias("kind"), node_id(F.col("h"), F.col("kind")).alias("dst"), F.lit(False).alias("reverse"), file.alias("file"), (F.lit(n << 40) + F.pmod("h", F.lit(1 << 40))).cast("long").alias("seq"))
        edges = ends if edges is None else edges.unionByName(ends)
        level = made.select("h", "kind")
        nodes = nodes.unionByName(node(level, n))
    edges = spark.createDataFrame([], EDGES) if edges is None else edges.to(EDGES)
    return nodes.to(NODES), edges


def synthetic_graph(seeds: DataFrame, depth: int) -> Graph:
    return assemble(*synthetic_items(seeds, depth))

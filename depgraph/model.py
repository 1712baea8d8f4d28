"""The data model: node and edge kinds, their endpoint types, inverses, and the schemas of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The kinds and endpoint types that results are stated in.
NODE_KINDS = ("class", "constant", "enum_case", "enum", "function", "interface", "method", "property", "trait", "builtin", "unknown")

_CALLERS = ("function", "method")
_TYPES = ("builtin", "class", "enum", "interface", "trait")
#: edge kind -> category, kinds of its source, kinds of its target (None: any)
EDGE_KINDS: dict[str, tuple[str, tuple[str, ...] | None, tuple[str, ...] | None]] = {
    "function-call": ("usage", _CALLERS, ("function",)),
    "method-call": ("usage", _CALLERS, ("method",)),
    "static-call": ("usage", _CALLERS, ("method",)),
    "instantiation": ("usage", _CALLERS, ("class",)),
    "property-access": ("usage", _CALLERS, ("property",)),
    "static-property-access": ("usage", _CALLERS, ("property",)),
    "const-fetch": ("usage", _CALLERS, ("constant", "enum_case")),
    "declaration-trait-use": ("declaration", ("class", "enum", "trait"), ("trait",)),
    "declaration-extends": ("declaration", ("class", "interface"), ("class", "interface")),
    "declaration-implements": ("declaration", ("class", "enum"), ("interface",)),
    "declaration-method": ("declaration", ("class", "enum", "interface", "trait"), ("method",)),
    "declaration-property": ("declaration", ("class", "trait"), ("property",)),
    "declaration-constant": ("declaration", ("class", "enum", "interface"), ("constant",)),
    "declaration-enum-case": ("declaration", ("enum",), ("enum_case",)),
    "declaration-type-parameter": ("declaration", _CALLERS, _TYPES),
    "declaration-type-return": ("declaration", _CALLERS, _TYPES),
    "declaration-type-property": ("declaration", ("property",), _TYPES),
    "attribute": ("usage", None, ("class",)),
    "instanceof": ("usage", _CALLERS, ("class", "enum", "interface")),
    "catch": ("usage", _CALLERS, ("class", "interface")),
    "used-by": ("reverse", None, None),
    "declared-in": ("reverse", None, None),
}
INVERSE = {"usage": "used-by", "declaration": "declared-in"}
REVERSE_KINDS = ("used-by", "declared-in")
#: Nodes of these kinds are never expanded.
TERMINAL_KINDS = ("builtin", "unknown")
BUILTIN_NAMES = ("self", "static", "parent", "int", "string", "float", "bool", "array", "iterable", "callable", "void", "object", "mixed", "null", "false", "true", "never")

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("name", T.StringType())])
NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("resolved", T.BooleanType()), T.StructField("file", FILE), T.StructField("seq", T.LongType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("reverse", T.BooleanType()), T.StructField("file", FILE), T.StructField("seq", T.LongType())])


def inverse_of(kind: str) -> str:
    """The reverse kind of a forward kind; reverse kinds have none."""
    category = EDGE_KINDS[kind][0]
    if category not in INVERSE:
        raise ValueError(f"{kind} is a reverse edge and can't be inverted")
    return INVERSE[category]


def edge_kinds(spark: SparkSession) -> DataFrame:
    """kind, category, inverse_kind: 22 rows."""
    return spark.createDataFrame([(k, c, INVERSE.get(c)) for k, (c, _, _) in EDGE_KINDS.items()], "kind string, category string, inverse_kind string")


def endpoint_types(spark: SparkSession) -> DataFrame:
    """kind, src_kind, dst_kind: every allowed combination."""
    rows = [(k, s, d) for k, (_, ss, ds) in EDGE_KINDS.items() for s in ss or NODE_KINDS for d in ds or NODE_KINDS if k != "declaration-extends" or s == d]
    return spark.createDataFrame(rows, "kind string, src_kind string, dst_kind string")


class Graph:
    """Nodes and edges as DataFrames (schemas NODES and EDGES); every operator gives new ones."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, paired: DataFrame | None = None):
        """paired: the edges with the number of their pair of nodes (column pair), if they lie by it."""
        self.nodes, self.edges, self.paired = nodes, edges, paired

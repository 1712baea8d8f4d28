"""Graphs derived from the star-schema and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgraph.model import Graph
from depgraph.operators.build import assemble


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(name: str, line: Column) -> Column:
    return F.struct(F.lit(f"{name}.parquet").alias("path"), line.cast("int").alias("line"), F.lit(1).alias("column"), F.lit(f"{name}.parquet").alias("name"))


def _id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), *parts)


#: Places of edges: the rank of their kind first, then a number of their target.
RANK = 10_000_000_000


def _node(df: DataFrame, name: str, id: Column, kind: str, number: Column, rank: int) -> DataFrame:
    return df.select(id.alias("id"), F.lit(kind).alias("kind"), F.lit(True).alias("resolved"), _file(name, F.lit(1)).alias("file"), (F.lit(rank * RANK) + number).cast("long").alias("seq"))


def _edge(df: DataFrame, name: str, rank: int, src: Column, kind: str, dst: Column, number: Column, line: Column | None = None) -> DataFrame:
    return df.select(src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"), F.lit(False).alias("reverse"), _file(name, F.lit(1) if line is None else line).alias("file"), (F.lit(rank * RANK) + number).cast("long").alias("seq"))


def star_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The node and edge items that the star-schema tables stand for, with repeated edges."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    c = F.col
    order = _id("Sales\\Customer", c("o_custkey"), F.lit("::order"), c("o_orderkey"))
    part, size = _id("Catalog\\Part", c("p_partkey")), _id("Catalog\\Part", c("p_partkey"), F.lit("::size"))
    types = t["part"].select("p_type").distinct()
    nodes = [
        _node(t["region"], "region", _id("Geo\\Region", c("r_regionkey")), "interface", c("r_regionkey"), 0),
        _node(t["nation"], "nation", _id("Geo\\Nation", c("n_nationkey")), "class", c("n_nationkey"), 1),
        _node(t["customer"], "customer", _id("Sales\\Customer", c("c_custkey")), "class", c("c_custkey"), 2),
        _node(t["supplier"], "supplier", _id("Catalog\\Supplier", c("s_suppkey")), "class", c("s_suppkey"), 3),
        _node(t["part"], "part", part, "class", c("p_partkey"), 4),
        _node(t["part"], "part", size, "property", c("p_partkey"), 5),
        _node(types, "part", _id("Catalog\\", c("p_type")), "enum", F.lit(0), 6),
        _node(t["orders"], "orders", order, "method", c("o_orderkey"), 7),
    ]
    used = t["lineitem"].join(t["orders"], c("l_orderkey") == c("o_orderkey"))
    edges = [
        _edge(t["nation"], "nation", 0, _id("Geo\\Nation", c("n_nationkey")), "declaration-implements", _id("Geo\\Region", c("n_regionkey")), c("n_regionkey")),
        _edge(t["customer"], "customer", 1, _id("Sales\\Customer", c("c_custkey")), "declaration-extends", _id("Geo\\Nation", c("c_nationkey")), c("c_nationkey")),
        _edge(t["supplier"], "supplier", 1, _id("Catalog\\Supplier", c("s_suppkey")), "declaration-extends", _id("Geo\\Nation", c("s_nationkey")), c("s_nationkey")),
        _edge(t["orders"], "orders", 2, _id("Sales\\Customer", c("o_custkey")), "declaration-method", order, c("o_orderkey")),
        _edge(t["part"], "part", 3, part, "declaration-property", size, c("p_partkey")),
        _edge(t["part"], "part", 4, size, "declaration-type-property", _id("Catalog\\", c("p_type")), F.lit(0)),
        _edge(t["part"], "part", 5, part, "attribute", _id("Catalog\\", F.replace(c("p_brand"), F.lit("#"), F.lit(""))), F.lit(0)),
    ]
    # both edges of a line come from one join
    ways = [F.struct(F.lit(kind).alias("kind"), dst.alias("dst"), (F.lit(rank * RANK) + number).cast("long").alias("seq")) for rank, kind, dst, number in (
        (6, "instantiation", _id("Catalog\\Part", c("l_partkey")), c("l_partkey")),
        (7, "instanceof", _id("Catalog\\Supplier", c("l_suppkey")), c("l_suppkey")),
    )]
    lines = used.select(order.alias("src"), "l_linenumber", F.explode(F.array(*ways)).alias("way"))
    edges.append(lines.select("src", "way.kind", "way.dst", F.lit(False).alias("reverse"), _file("lineitem", c("l_linenumber")).alias("file"), "way.seq"))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Geography, sales and the catalogue as one graph without cycles; brands are used but declared nowhere."""
    return assemble(*star_items(spark, sf_dir))


def flow_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    nodes = events.select("event_type").where("event_type IS NOT NULL").distinct()
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select("event_type", following.alias("following")).where("event_type IS NOT NULL AND following IS NOT NULL").distinct()
    return (
        _node(nodes, "events", _id("Flow\\", F.col("event_type")), "function", F.lit(0), 0),
        _edge(pairs, "events", 0, _id("Flow\\", F.col("event_type")), "function-call", _id("Flow\\", F.col("following")), F.lit(0)),
    )


def flow_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A function for each type of event, calling the type that the same user's next event has: full of cycles."""
    return assemble(*flow_items(spark, sf_dir))


# The same graphs in DuckDB SQL: CTEs named forward, nodes, edges.
_FORWARD = rf"""items AS (
SELECT 'Geo\Nation' || n_nationkey AS src, 'declaration-implements' AS kind, 'Geo\Region' || n_regionkey AS dst, 1 AS line, CAST(n_regionkey AS BIGINT) AS seq FROM nation
UNION ALL SELECT 'Sales\Customer' || c_custkey, 'declaration-extends', 'Geo\Nation' || c_nationkey, 1, {RANK} + c_nationkey FROM customer
UNION ALL SELECT 'Catalog\Supplier' || s_suppkey, 'declaration-extends', 'Geo\Nation' || s_nationkey, 1, {RANK} + s_nationkey FROM supplier
UNION ALL SELECT 'Sales\Customer' || o_custkey, 'declaration-method', 'Sales\Customer' || o_custkey || '::order' || o_orderkey, 1, {2 * RANK} + o_orderkey FROM orders
UNION ALL SELECT 'Catalog\Part' || p_partkey, 'declaration-property', 'Catalog\Part' || p_partkey || '::size', 1, {3 * RANK} + p_partkey FROM part
UNION ALL SELECT 'Catalog\Part' || p_partkey || '::size', 'declaration-type-property', 'Catalog\' || p_type, 1, {4 * RANK} FROM part
UNION ALL SELECT 'Catalog\Part' || p_partkey, 'attribute', 'Catalog\' || replace(p_brand, '#', ''), 1, {5 * RANK} FROM part
UNION ALL SELECT 'Sales\Customer' || o_custkey || '::order' || o_orderkey, 'instantiation', 'Catalog\Part' || l_partkey, l_linenumber, {6 * RANK} + l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'Sales\Customer' || o_custkey || '::order' || o_orderkey, 'instanceof', 'Catalog\Supplier' || l_suppkey, l_linenumber, {7 * RANK} + l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_DECLARED = r"""declared AS (
SELECT 'Geo\Region' || r_regionkey AS id, 'interface' AS kind FROM region
UNION ALL SELECT 'Geo\Nation' || n_nationkey, 'class' FROM nation UNION ALL SELECT 'Sales\Customer' || c_custkey, 'class' FROM customer
UNION ALL SELECT 'Catalog\Supplier' || s_suppkey, 'class' FROM supplier UNION ALL SELECT 'Catalog\Part' || p_partkey, 'class' FROM part
UNION ALL SELECT 'Catalog\Part' || p_partkey || '::size', 'property' FROM part UNION ALL SELECT DISTINCT 'Catalog\' || p_type, 'enum' FROM part
UNION ALL SELECT 'Sales\Customer' || o_custkey || '::order' || o_orderkey, 'method' FROM orders)"""
_FLOW = r"""items AS (SELECT DISTINCT 'Flow\' || event_type AS src, 'function-call' AS kind, 'Flow\' || following AS dst, 1 AS line, CAST(0 AS BIGINT) AS seq
FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE event_type IS NOT NULL AND following IS NOT NULL),
declared AS (SELECT DISTINCT 'Flow\' || event_type AS id, 'function' AS kind FROM events WHERE event_type IS NOT NULL)"""
_REST = """forward AS (SELECT src, kind, dst, min(line) AS line, 2 * min(seq) AS seq FROM items GROUP BY ALL),
inverse AS (SELECT dst AS src, CASE WHEN kind LIKE 'declaration-%' THEN 'declared-in' ELSE 'used-by' END AS kind, src AS dst, seq + 1 AS seq FROM forward),
edges AS (SELECT src, kind, dst, seq, false AS reverse FROM forward UNION ALL SELECT src, kind, dst, min(seq), true FROM inverse GROUP BY src, kind, dst),
nodes AS (SELECT id, kind, true AS resolved FROM declared UNION ALL
SELECT DISTINCT id, 'unknown', false FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) ANTI JOIN declared USING (id))"""
STAR_SQL = f"{_FORWARD}, {_DECLARED}, {_REST}"
FLOW_SQL = f"{_FLOW}, {_REST}"

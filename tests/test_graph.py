"""Hand-built graphs with known results."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depgraph import functions as G
from depgraph.model import EDGE_KINDS, NODES, edge_kinds, inverse_of
from depgraph.operators import build, lookup, report, traverse, validate
from depgraph.tables import stored

EDGE = "src string, kind string, dst string, reverse boolean, file struct<path: string, line: int, column: int, name: string>, seq long"


def made(spark, pairs, kind="function-call", nodes=None, node_kind="function"):
    """A graph in namespace App from "AB" style pairs; ``nodes``: the declared ones, by default all."""
    names = sorted({x for p in pairs for x in p}) if nodes is None else nodes
    ns = spark.createDataFrame([(f"App\\{x}", node_kind, True, None, i) for i, x in enumerate(names)], NODES)
    es = spark.createDataFrame([(f"App\\{a}", kind, f"App\\{b}", False, ("f", i + 1, 1, "f"), i) for i, (a, b) in enumerate(pairs)], EDGE)
    return build.assemble(ns, es)


def lines(graph, root="A", **options):
    return [r.line.replace("App\\", "") for r in report.report(graph, f"App\\{root}", **options).collect()]


CASES = {
    "chain": (["AB"], ["A", "└── B"]),
    "cycle": (["AB", "BC", "CA"], ["A", "└── B", "    └── C", "        └── A (recursive)"]),
    "diamond": (["AB", "AC", "BD", "CD"], ["A", "├── B", "│   └── D", "└── C", "    └── D (*)"]),
    "shared": (["AB", "AC", "BD", "CD", "DE"], ["A", "├── B", "│   └── D", "│       └── E", "└── C", "    └── D (*)"]),
}


@pytest.mark.parametrize("name", CASES)
def test_trees(spark, name):
    pairs, expected = CASES[name]
    graph = made(spark, pairs)
    assert lines(graph) == expected
    if name == "cycle":
        with pytest.raises(ValueError, match="cycle"):
            traverse.tree(graph, "App\\A")
    else:
        assert lines(graph, cyclic=False) == expected


def test_levels_and_direction(spark):
    graph = made(spark, ["AB", "BC", "CA"])
    assert lines(graph, level=0) == ["A"]
    assert lines(graph, level=1) == ["A", "└── B"]
    assert lines(graph, direction="used-by") == ["A", "└── C", "    └── B", "        └── A (recursive)"]
    with pytest.raises(ValueError):
        lines(graph, level=-1)
    with pytest.raises(lookup.NotFound):
        lines(graph, root="Z")


def test_level_marks_what_it_cuts_as_expanded(spark):
    # B is printed at the level first, so its later, shallower place shows (*) and its child never appears
    assert lines(made(spark, ["AC", "CB", "AB", "BD"]), level=2) == ["A", "├── C", "│   └── B", "└── B (*)"]


def test_walk_of_more_than_a_million_links():
    n, names = 1_000_001, ["root", "id", "at", "last", "dst", "kind", "dst_kind"]
    cut = [range(i, min(i + 10_000, n + 1)) for i in range(1, n + 1, 10_000)]
    batches = (pa.RecordBatch.from_pydict(dict(zip(names, (["R"] * len(r), ["R"] * len(r), list(r), [x == n for x in r], [f"N{x}" for x in r], ["function"] * len(r), ["function"] * len(r)), strict=True))) for r in cut)
    assert sum(b.num_rows for b in traverse._walks_of(None)(batches)) == n + 1


@pytest.mark.parametrize("level", [None, 0, 1, 3])
def test_walk_in_batches(monkeypatch, level):
    """Several roots, their links in small batches, against a plain recursion over cyclic graphs."""
    monkeypatch.setattr(traverse, "_READ", 2)
    monkeypatch.setattr(traverse, "_ROWS", 5)
    rng, rows, expected = random.Random(8), [], []
    for root in "abcde":
        below = {x: rng.sample("abcdefgh", rng.randrange(5)) for x in "abcdefgh"}
        rows += [dict(root=root, id=x, kind="function", dst=y, dst_kind="function", at=i + 1, last=i + 1 == len(below[x])) for x in below for i, y in enumerate(below[x])]
        rows += [dict(root=root, id=x, kind="function", dst=None, dst_kind=None, at=None, last=None) for x in below if not below[x]]
        expanded = set()

        def visit(x, parent, path, above):
            again = "recursive" if x in above else "*" if x in expanded else None
            expected.append((root, [s[0] for s in path], x, parent, again))
            if not again:
                expanded.add(x)
                for i, y in enumerate(below[x] if level is None or len(path) < level else []):
                    visit(y, x, [*path, (i + 1,)], above | {x})

        visit(root, None, [], set())
    schema = pa.schema([(c, pa.bool_() if c == "last" else pa.int32() if c == "at" else pa.string()) for c in rows[0]])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 7], schema) for i in range(0, len(rows), 7)]
    got = [r for b in traverse._walks_of(level)(iter(batches)) for r in b.to_pylist()]
    assert [(r["root"], [s["at"] for s in r["path"]], r["id"], r["parent"], r["marker"]) for r in got] == expected
    assert list(traverse._walks_of(level)(iter([]))) == []


def test_unresolved_nodes_are_not_expanded(spark):
    graph = made(spark, ["AB", "BC"], nodes=["A", "C"])
    assert lines(graph) == ["A", "└── B (unresolved)"]
    assert lines(graph, root="B", direction="used-by") == ["B"]
    assert {r.id for r in graph.nodes.where("NOT resolved").collect()} == {"App\\B"}


def test_plain_walk_expands_again(spark):
    graph = made(spark, ["AB", "AC", "BD", "CD"])
    got = [r.id[-1] for r in traverse.walks(graph, "App\\A").orderBy("places").collect()]
    assert got == ["A", "B", "D", "C", "D"]


def test_plain_walk_has_no_limit_of_its_own(spark):
    graph = made(spark, ["AB", "BC", "CD", "DE", "EF", "FG", "GH", "HI", "IJ", "JK", "KL", "LA"])
    got = [(r.depth, r.id[-1], r.recursive) for r in traverse.walks(graph, "App\\A").orderBy("depth").collect()]
    assert got == [*((i, x, False) for i, x in enumerate("ABCDEFGHIJKL")), (12, "A", True)]


def test_build(spark):
    graph = made(spark, ["AB", "AB"])
    assert graph.edges.where("NOT reverse").count() == 1
    assert graph.edges.where("NOT reverse").first().file.line == 1
    assert lookup.edge(graph, "App\\B", "App\\A").first().kind == "used-by"
    assert lookup.edge(graph, "App\\B", "App\\A", "declared-in").count() == 0
    assert [r.kind for r in lookup.out_edges(graph, "App\\A").collect()] == ["function-call"]
    two = graph.edges.where("NOT reverse").withColumn("kind", F.lit("instanceof"))
    both = build.add_edges(graph, two)
    assert both.edges.count() == 3  # two kinds forward, one inverse
    with pytest.raises(ValueError):
        build.inverted(graph.edges)


def test_merge(spark):
    a, b = made(spark, ["AB"], nodes=["A"]), made(spark, ["BC"], nodes=["B", "C"])
    merged = build.merge(a, b)
    assert {(r.id[-1], r.kind) for r in merged.nodes.collect()} == {("A", "function"), ("B", "function"), ("C", "function")}
    assert lines(merged) == ["A", "└── B", "    └── C"]
    assert a.nodes.where("kind = 'unknown'").count() == 1
    with pytest.raises(build.NodeExists):
        build.merge(merged, b)
    with pytest.raises(build.NodeExists):  # concrete, then a placeholder of the same id
        build.merge(b, a)
    with pytest.raises(build.NodeExists):
        build.strict_nodes(b.nodes.unionByName(b.nodes))


def test_merges_do_not_run_out_of_places(spark):
    """Graphs whose places are as large as those of extracted text, merged one after the other, keep their order."""
    merged = None
    for i, (a, b) in enumerate(("AB", "CD", "EF", "GH")):
        ns = spark.createDataFrame([(f"App\\{x}", "function", True, None, k) for k, x in enumerate((a, b))], NODES)
        es = spark.createDataFrame([(f"App\\{x}", "function-call", f"App\\{y}", False, ("f", 1, 1, "f"), (1 << 61) - 9 + k) for k, (x, y) in enumerate(((a, b), (b, a)))], EDGE)
        one = build.assemble(ns, es)
        merged = one if merged is None else build.merge(merged, one)
    assert "".join(r.src[-1] for r in merged.edges.where("NOT reverse").orderBy("seq").collect()) == "ABCDEFGH"
    assert merged.edges.count() == 16 and merged.edges.where("seq < 0").count() == 0


def test_reach(spark):
    graph = made(spark, ["AB", "BC", "CA", "CD"])
    roots = lookup.node(graph, "App\\A")
    got = {(r.id[-1], r.depth) for r in traverse.reach(graph, roots).collect()}
    assert got == {("A", 0), ("B", 1), ("C", 2), ("D", 3)}
    assert traverse.reach(graph, roots, level=1).count() == 2
    assert {r.id[-1] for r in traverse.reach(graph, roots, stop=F.col("id") == "App\\B").collect()} == {"A", "B"}
    assert traverse.reach(graph, lookup.node(graph, "App\\None")).count() == 0


def test_invariants(spark):
    graph = made(spark, ["AB", "BC", "CA", "CD"])
    for broken in (validate.one_way, validate.without_inverse, validate.dangling, validate.repeated_nodes, validate.repeated_edges, validate.mistyped, validate.asymmetric):
        assert broken(graph).count() == 0, broken.__name__
    assert validate.unreached_back(graph, graph.nodes.select("id")).count() == 0
    assert validate.mistyped(made(spark, ["AB"], kind="declaration-extends")).count() == 1


def test_empty_graph(spark):
    graph = build.assemble(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGE))
    assert graph.nodes.count() == graph.edges.count() == 0


def test_kinds(spark):
    assert edge_kinds(spark).count() == len(EDGE_KINDS) == 22
    assert inverse_of("catch") == "used-by" and inverse_of("declaration-extends") == "declared-in"
    with pytest.raises(ValueError):
        inverse_of("used-by")


def test_identifiers(spark):
    rows = [("Ns\\Sub\\Name::member",), ("Name",), ("Ns\\f",)]
    id = F.col("id")
    got = spark.createDataFrame(rows, "id string").select(G.namespace(id), G.short_name(id), G.owner(id), G.member(id)).collect()
    assert [tuple(r) for r in got] == [("Ns\\Sub", "Name", "Ns\\Sub\\Name", "member"), ("", "Name", None, None), ("Ns", "f", None, None)]
    names = spark.createDataFrame([("a1",), ("1a",), ("é_",), ("a b",), ("a\\b",)], "n string")
    assert [tuple(r) for r in names.select(G.is_identifier(F.col("n")), G.is_namespace(F.col("n"))).collect()] == [(True, True), (False, False), (True, True), (False, False), (False, True)]
    assert spark.range(1).select(G.is_builtin(F.lit("SELF")), G.is_builtin(F.lit("selfish"))).first() == (True, False)


def brute_tree(below, root, level=None, stop=()):
    """(path, id, marker) of the depth-first walk; below: ordered children of each node."""
    out, expanded = [], set()

    def visit(x, path, above):
        marker = "recursive" if x in above else "*" if x in expanded else None
        out.append((tuple(path), x, marker))
        if marker or x in stop:
            return
        expanded.add(x)
        for i, y in enumerate(below.get(x, []) if level is None or len(path) < level else []):
            visit(y, [*path, i + 1], above | {x})

    visit(root, [], frozenset())
    return out


def random_graphs():
    rng = random.Random(21)
    for size, links in ((6, 2), (9, 3), (12, 2), (14, 1.3)):
        names = "ABCDEFGHIJKLMN"[:size]
        pairs = [a + b for a in names for b in rng.sample(names, size) if rng.random() < links / size]
        yield names, pairs
    # two cycles in a row, entered at different places, and a loop on one node
    yield "ABCDEFGH", ["AC", "AB", "BC", "CD", "DB", "BE", "CG", "EF", "FG", "GE", "FF", "GH", "HH", "DA"]
    yield "ABCDEFGH", ["AC", "AB", "BC", "CD", "DB", "BE", "CG", "EF", "FG", "GE", "FF", "GH", "HH"]


def test_trees_of_any_graph(spark):
    """Trees below every node, whole and to levels, with and without stopped nodes, against a plain recursion."""
    names, pairs = [], []
    for i, (own, links) in enumerate(random_graphs()):
        names += [f"{x}{i}" for x in own]
        pairs += [(f"{a}{i}", f"{b}{i}") for a, b in links]
    graph = made(spark, pairs, nodes=names)
    graph = type(graph)(stored(graph.nodes, "n"), stored(graph.edges, "e"))
    below = {}
    for a, b in pairs:
        below.setdefault(a, []).append(b)
    halt = [n for n in names if n[0] in "BF"]
    stop = F.substring_index("id", "\\", -1).isin(*halt)
    for level, stopped in ((None, ()), (3, ()), (None, halt)):
        got = {}
        for r in traverse.tree_of_any(graph, graph.nodes, "uses", level, stop if stopped else None).collect():
            got.setdefault(r.root[4:], []).append((tuple(s["at"] for s in r.path), r.id[4:], r.marker))
        for root in names:
            assert sorted(got[root], key=str) == sorted(brute_tree(below, root, level, stopped), key=str), (level, root)


def test_cyclic_components(spark):
    links = ["AB", "BC", "CA", "CD", "DE", "ED", "EF", "FG", "GH", "HH", "XY", "YX", "XA", "ZX"]
    got = traverse.cyclic_components(spark.createDataFrame([tuple(x) for x in links], "src string, dst string"))
    assert {r.id: r.component for r in got.collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "X": "X", "Y": "X"}
    assert traverse.cyclic_components(spark.createDataFrame([("A", "B"), ("B", "B")], "src string, dst string")).count() == 0


def test_no_task_holds_a_root(spark):
    """Only links within components that hold a cycle are walked in Python; levels take none at all."""
    graph = made(spark, ["AB", "BC", "CB", "AD", "DE"])
    plan = traverse.tree_of_any(graph, graph.nodes, "uses", 3)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    walked = []
    real = traverse._walks_of
    try:
        traverse._walks_of = lambda level: walked.append(level) or real(level)
        traverse.tree_of_any(made(spark, ["AB", "AC", "BD", "CD"]), made(spark, ["AB"]).nodes, "uses").count()
        assert walked == []
    finally:
        traverse._walks_of = real


def test_stopped_nodes(spark):
    """A stopped node is visited each time, but what lies below it is not, unless another way leads there."""
    graph = made(spark, ["AB", "AC", "BD", "CB", "CD", "DE"])
    stop = F.col("id") == "App\\B"
    want = ["A", "├── B", "└── C", "    ├── B", "    └── D", "        └── E"]
    assert lines(graph, stop=stop) == lines(graph, stop=stop, cyclic=False) == want
    assert [r.id[-1] for r in traverse.walks(graph, "App\\A", stop=stop).orderBy("places").collect()] == list("ABCBDE")
    assert lines(graph, root="B", stop=stop) == ["B"]
    # as users of D are counted, but not what uses the stopped one
    assert [r.id[-1] for r in traverse.walks(graph, "App\\D", "used-by", stop=stop).orderBy("places").collect()] == list("DBCA")


def test_order_of_nodes(spark):
    """Placeholders follow in the order of edges, keep their places when declared, and hand them on through merges."""
    order = lambda g: "".join(r.id[-1] for r in lookup.nodes(g).orderBy("place").collect())
    first = made(spark, ["AZ", "AC", "YB"], nodes=["B", "A"])
    assert order(first) == "BAZCY"
    second = made(spark, ["CX", "CW", "QA"], nodes=["D", "C"])
    free = type(second)(second.nodes.where("kind <> 'unknown'"), second.edges)
    both = build.merge(first, free)
    assert order(both) == "BAZCYDXWQ"
    third = made(spark, ["XV"], nodes=["E", "X", "Z"])
    again = build.merge(both, type(third)(third.nodes.where("kind <> 'unknown'"), third.edges))
    assert order(again) == "BAZCYDXWQEV"
    assert {r.id[-1] for r in again.nodes.where("kind = 'unknown'").collect()} == set("YWQV")
    assert order(build.add_nodes(first, made(spark, [], nodes=["C", "F"]).nodes)) == "BAZCYF"


def test_hierarchy(spark):
    """All ancestors against plain recursion; what is direct is all less what others bring."""
    from depgraph.operators import hierarchy

    rng = random.Random(4)
    pairs = sorted({a + b for a, b in (sorted(rng.sample("ABCDEFGHIJ", 2)) for _ in range(18))}) + ["KL", "LM", "MK"]
    graph = made(spark, pairs, kind="declaration-extends", node_kind="class")
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)

    def above(x, seen=()):
        return set().union(*({y} | above(y, (*seen, x)) for y in up.get(x, ()) if y not in seen)) if x in up else set()

    def all_above(x):
        out, todo = set(), list(up.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in out:
                out.add(y)
                todo += up.get(y, ())
        return out

    got = {(r.id[-1], r.ancestor[-1]): (r.stated, r.inherited) for r in hierarchy.ancestors(graph).collect()}
    want = {(x, y): (y in up[x], any(y in all_above(z) for z in up[x] if z != y)) for x in up for y in all_above(x)}
    assert got == want
    assert {(r.id[-1], r.ancestor[-1]) for r in hierarchy.direct(graph).collect()} == {k for k, v in want.items() if not v[1]}


def test_stored_graph(spark, tmp_path):
    """A lookup reads one bucket, a step of a traversal shuffles no edges, and another session opens the same files."""
    from depgraph.sources.stored import open_graph, save_graph

    path = f"file://{tmp_path}/it's"
    graph = made(spark, [a + b for a in "ABCDEFGH" for b in "ABCDEFGH" if a < b])
    held = save_graph(graph, path, 4)
    plan = lambda df: df._jdf.queryExecution().toString()
    # only so does the plan name the buckets that it reads
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    for df in (lookup.out_edges(held, "App\\C"), lookup.in_edges(held, "App\\C"), lookup.node(held, "App\\C")):
        assert "SelectedBucketsCount: 1 out of 4" in plan(df)
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    key = lambda df: sorted(map(tuple, df.select("src", "kind", "dst", "seq").collect()))
    assert key(held.edges) == key(graph.edges) == key(held.incoming) and held.nodes.count() == 8
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        front = spark.createDataFrame([("App\\A",)], "id string").join(traverse.ways(held, "uses"), F.col("id") == F.col("src"))
        physical = plan(front).split("== Physical Plan ==")[1]
        assert physical.count("Exchange") == 1 and "Exchange" not in physical[physical.index("FileScan") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    other = open_graph(spark.newSession(), path)
    assert sorted(r.id for r in traverse.reach(other, lookup.node(other, "App\\G")).collect()) == ["App\\G", "App\\H"]
    with pytest.raises(Exception, match="(?i)exist"):
        save_graph(graph, path, 4)


def test_visit_counts(spark):
    """Visits from every node of graphs with cycles, as the plain walk makes them one by one."""
    pairs = [(f"{a}{i}", f"{b}{i}") for i, (_, own) in enumerate(list(random_graphs())[4:]) for a, b in own]
    graph = made(spark, pairs)
    below = {}
    for a, b in pairs:
        below.setdefault(a, []).append(b)

    def visits(x, above=frozenset()):
        return 1 if x in above else 1 + sum(visits(y, above | {x}) for y in below.get(x, ()))

    got = {r.id[4:]: int(r.visits) for r in traverse.visit_counts(graph).collect()}
    assert got == {x: visits(x) for x in {x for p in pairs for x in p}}


def test_pairs_lie_together(spark):
    """Items are shuffled once for edges of both ways, and comparing both ways shuffles nothing but counts."""
    from depgraph.model import Graph

    rows = [("A", "instantiation", "B", 3), ("A", "instanceof", "B", 1), ("A", "instanceof", "B", 0), ("B", "attribute", "B", 2)]
    edges = spark.createDataFrame([(a, kind, b, False, None, seq) for a, kind, b, seq in rows], EDGE)
    graph = build.assemble(spark.createDataFrame([(x, "class", True, None, 0) for x in "AB"], NODES), edges)
    got = {(r.src, r.kind, r.dst, r.reverse, r.seq) for r in graph.edges.collect()}
    assert got == {("A", "instantiation", "B", False, 6), ("A", "instanceof", "B", False, 0), ("B", "attribute", "B", False, 4), ("B", "used-by", "A", True, 1), ("B", "used-by", "B", True, 5)}
    for check in (validate.one_way, validate.without_inverse, validate.asymmetric):
        assert check(graph).count() == 0
        assert check(graph)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # on graphs that don't keep pairs, edges whose way back is missing or of another kind are found
    cut = Graph(graph.nodes, graph.edges.where("NOT (reverse AND src = 'B' AND dst = 'A')"))
    assert {(r.src, r.kind) for r in validate.one_way(cut).collect()} == {("A", "instantiation"), ("A", "instanceof")} == {(r.src, r.kind) for r in validate.without_inverse(cut).collect()}
    assert {(r.src, r.dst) for r in validate.asymmetric(cut).collect()} == {("A", "B")}


def test_loops_leave_their_results_only(spark):
    """Links, and what is known of nodes, are discarded once nothing reads them."""
    from depgraph.tables import recorded

    graph = made(spark, ["AB", "BC", "AC"])
    for run in (lambda: traverse.reach(graph, graph.nodes, "uses"), lambda: traverse.visit_counts(graph), lambda: traverse.tree_of_any(graph, graph.nodes)):
        with recorded() as tables:
            found = run()
        left = {t.stored_at.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in tables if os.path.exists(t.stored_at.removeprefix("file://"))}
        assert not left & {"ways", "known", "counted", "links"}
        assert found.count()


def test_merge_leaves_its_result_only(spark):
    from depgraph.tables import recorded

    with recorded() as tables:
        graph = build.merge(made(spark, ["AB"]), made(spark, ["CD"]))
    assert sum(os.path.exists(t.stored_at.removeprefix("file://")) for t in tables) == 2
    assert graph.nodes.count() == 4 and graph.edges.count() == 4


def test_edge_without_both_ends_dangles_once(spark):
    from depgraph.model import Graph

    graph = made(spark, ["AB", "BC"])
    assert validate.dangling(graph).count() == 0
    assert validate.dangling(Graph(graph.nodes.where("id = 'App\\\\C'"), graph.edges)).count() == 4
    assert validate.dangling(Graph(graph.nodes.where("id <> 'App\\\\C'"), graph.edges)).count() == 2


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from depgraph.tables import settled

    files = lambda: {f for f in (x.getName() for x in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))) if f.startswith("shuffle_")}
    before = files()
    assert settled(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "swept").count() == 7
    end = time.time() + 10
    while (more := {f for f in files() - before if f.endswith(".data")}) and time.time() < end:
        time.sleep(0.5)
    # counting the table makes one of its own
    assert len(more) <= 1

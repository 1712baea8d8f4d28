"""Traversal: reachability by a frontier loop, ordered depth-first occurrences, components on cycles, path enumeration, visit counts."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgraph.model import TERMINAL_KINDS, Graph
from depgraph.operators.lookup import traversable
from depgraph.tables import discard, has_rows
from depgraph.tables import settled as stored


def ways(graph: Graph, direction: str, *columns: str) -> DataFrame:
    """Columns (src, dst, seq, kind by default) of the edges of a direction, written unless the graph's edges are a written table already."""
    edges = traversable(graph.edges, direction).select(*(columns or ("src", "dst", "seq", "kind")))
    return edges if hasattr(graph.edges, "stored_at") else stored(edges, "ways")


def reach(graph: Graph, roots: DataFrame, direction: str = "uses", level: int | None = None, stop: Column | None = None, through_terminals: bool = False) -> DataFrame:
    """root, id, depth of all that each root reaches, itself at depth 0, at the least depth.

    roots: column id. level: the greatest depth, or none. stop: condition on the nodes' columns; where it holds a
    node is reached but not expanded. Each level is one join of the frontier with the links and one with what was
    reached, written as a table, so nothing is gathered in one place and lost executors cost one level.
    """
    edges = ways(graph, direction, "src", "dst")
    reached = _reached(graph, edges, roots, level, stop, through_terminals)
    discard(edges)
    return reached


def _reached(graph: Graph, edges: DataFrame, roots: DataFrame, level: int | None, stop: Column | None = None, through_terminals: bool = False) -> DataFrame:
    """``reach`` along ``edges`` (src, dst). Only the frontier is tested for nodes that aren't expanded, so edges are
    neither grouped nor shuffled where the frontier is small enough for Spark to send it to them."""
    open_nodes = F.lit(True) if stop is None else ~F.coalesce(stop, F.lit(False))
    if not through_terminals:
        open_nodes &= ~F.col("kind").isin(*TERMINAL_KINDS)
    known = stored(graph.nodes.select("id", open_nodes.alias("open")), "known")
    start = roots.select("id").distinct().join(known, "id", "left_semi")
    reached = frontier = stored(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")), "reached")
    depth = 0
    while level is None or depth < level:
        depth += 1
        open_frontier = frontier.join(known.where("open"), "id", "left_semi")
        new = open_frontier.join(edges, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        frontier = stored(new.join(reached, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not has_rows(frontier):
            break
        reached = reached.unionByName(frontier)
    discard(known)
    return reached


def children(edges: DataFrame) -> DataFrame:
    """src, dst, at (from 1), last: each node's links, a pair of nodes once, in the order of its first edge."""
    order = Window.partitionBy("src").orderBy("place", "dst")
    pairs = edges.groupBy("src", "dst").agg(F.min(F.struct("seq", "kind")).alias("place"))
    return pairs.select("src", "dst", F.row_number().over(order).alias("at"), F.lead("dst").over(order).isNull().alias("last"))


#: path: for each step from the root the number of the child and whether it is the last one; arrays order by it.
OCCURRENCES = "root string, path array<struct<at: int, last: boolean>>, depth int, id string, parent string, kind string, marker string"
_STEP = "struct<at: int, last: boolean>"


def tree(graph: Graph, root: str, direction: str = "uses", stop: Column | None = None) -> DataFrame:
    """The occurrences (OCCURRENCES) of the whole tree below ``root`` of a graph without cycles.

    A node is expanded where it occurs first in depth-first order, which is its least path, shorter prefixes first.
    Least paths are found by relaxing links level by level; each expanded node then lists all its children, with a
    marker where one was expanded before. A child that is its own ancestor, or more rounds than nodes, show a cycle
    below the root: that is an error, see ``tree_of_any``. stop: as there.
    """
    edges, kinds = ways(graph, direction), _kinds(graph, stop)
    roots = kinds.where(F.col("id") == root)
    inside = stored(_reached(graph, edges, roots, None, stop).select("id"), "below")
    steps = _steps(edges, inside, kinds)
    discard(edges)
    best = stored(roots.select(F.lit(root).alias("root"), "id", F.expr(f"cast(array() as array<{_STEP}>)").alias("path")), "paths")
    frontier, rounds = best, 0
    size = inside.count()
    while has_rows(frontier):
        rounds += 1
        if rounds > size + 1:
            raise ValueError("there is a cycle below the root")
        found = _extended(frontier, steps).groupBy("root", "id").agg(F.min("path").alias("path"))
        merged = found.withColumnRenamed("path", "new").join(best, ["root", "id"], "left")
        frontier = stored(merged.where("path IS NULL OR new < path").select("root", "id", F.col("new").alias("path")), "paths")
        if has_rows(frontier):
            best = stored(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "paths")
    lines = _lines(best, steps, kinds)
    if has_rows(lines.where("marker = 'recursive'")):
        raise ValueError("there is a cycle below the root")
    return lines


def _kinds(graph: Graph, stop: Column | None) -> DataFrame:
    """id, kind, open (may be expanded), halted (by ``stop``) of all nodes, written."""
    halted = F.lit(False) if stop is None else F.coalesce(stop, F.lit(False))
    return stored(graph.nodes.select("id", "kind", (~F.col("kind").isin(*TERMINAL_KINDS) & ~halted).alias("open"), halted.alias("halted")), "kinds")


def _steps(edges: DataFrame, inside: DataFrame, kinds: DataFrame) -> DataFrame:
    """The ordered links out of those of the nodes ``inside`` that may be expanded."""
    own = inside.select("id").distinct().join(kinds.where("open"), "id", "left_semi").withColumnRenamed("id", "src")
    return stored(children(edges.join(own, "src", "left_semi")), "children")


def _extended(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """root, id, path, parent of what the last nodes of paths link to."""
    longer = F.concat("path", F.array(F.struct("at", "last"))).alias("path")
    return paths.join(steps, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), longer, F.col("src").alias("parent"), F.col("path").alias("above"))


def _lines(best: DataFrame, steps: DataFrame, kinds: DataFrame, level: int | None = None) -> DataFrame:
    """OCCURRENCES, from the path (root, id, path) on which each node occurs first: there it lists its children.

    A child whose own first path leads to its parent is an ancestor; one with another first path was expanded before.
    """
    deeper = best if level is None else best.where(F.size("path") < level)
    first = best.select("root", "id", F.col("path").alias("own"))
    start = best.where("size(path) = 0").select("root", "id", "path", F.lit(None).cast("string").alias("parent"), F.lit(None).cast(f"array<{_STEP}>").alias("above"))
    every = _extended(deeper, steps).unionByName(start).join(first, ["root", "id"]).join(kinds, "id")
    marker = (
        F.when(F.size("path") == 0, F.lit(None).cast("string"))
        .when(F.expr("size(own) <= size(above) AND slice(above, 1, size(own)) = own AND open"), "recursive")
        .when(F.expr("own <> path AND open"), "*")
        .when(F.col("kind") == "builtin", "builtin")
        .when(F.col("kind") == "unknown", "unresolved")
    )
    return every.select("root", "path", F.size("path").alias("depth"), "id", "parent", "kind", marker.alias("marker"))


def tree_of_any(graph: Graph, roots: DataFrame, direction: str = "uses", level: int | None = None, stop: Column | None = None) -> DataFrame:
    """The occurrences (OCCURRENCES) of the tree below each root (column id), for any graph and any level.

    stop: condition on the nodes' columns; a node that meets it occurs wherever a link leads to it, but is neither expanded
    nor counted as expanded. With a level see ``_first_to_level``, without one ``_first_of_any``.
    """
    edges, kinds = ways(graph, direction), _kinds(graph, stop)
    reached = _reached(graph, edges, roots, level, stop).select("root", "id", "depth")
    # a node whose least depth is the level is never followed
    steps = _steps(edges, reached if level is None else reached.where(F.col("depth") < level), kinds)
    discard(edges)
    start = stored(reached.where("depth = 0").select("root", "id", F.expr(f"cast(array() as array<{_STEP}>)").alias("path")), "paths")
    best = _first_of_any(start, steps, reached) if level is None else _first_to_level(start, steps, level)
    return _lines(best, steps, kinds, level)


def _first_to_level(start: DataFrame, steps: DataFrame, level: int) -> DataFrame:
    """root, id, path: the first occurrence of each node in depth-first order, down to ``level``.

    The first path of a node is the least of the first paths of its parents, each with one more step, of those parents
    that first occur above the level; a parent whose first path became longer than that gives nothing, though a later and
    shorter one would. So each round makes all paths anew from those of the round before, and a result that stays is the only one
    there is: where all nodes up to some place in depth-first order have their paths, the next one gets its own, as
    a wrong path leads through a later node and comes after it.
    """
    now = start
    while True:
        found = _extended(now.where(F.size("path") < level), steps).select("root", "id", "path").unionByName(start)
        new = stored(found.groupBy("root", "id").agg(F.min("path").alias("path")), "paths")
        if not has_rows(new.join(now, ["root", "id", "path"], "left_anti")) and not has_rows(now.join(new, ["root", "id"], "left_anti")):
            return new
        if now is not start:
            discard(now)
        now = new


def cyclic_components(links: DataFrame) -> DataFrame:
    """id, component of the nodes that lie on cycles of the links (src, dst) through other nodes.

    Nodes without links in or out are trimmed away; over what is left, each node takes the least id that leads to it, and the nodes of
    that colour which lead back to it are one component. What has none goes on to the next round.
    """
    live = stored(links.where("src <> dst").select("src", "dst").distinct(), "cycle-links")
    whole = live.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    while has_rows(live):
        for _ in range(4):
            both = live.select(F.col("src").alias("id")).intersect(live.select("dst"))
            ends = lambda x: both.select(F.col("id").alias(x))  # noqa: E731, B023
            cut = stored(live.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi"), "cycle-links")
            same = cut.count() == live.count()
            discard(live)
            live = cut
            if same:
                break
        colours = front = stored(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("colour", F.col("id")), "colours")
        while has_rows(front):
            taken = front.join(live, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
            better = stored(taken.join(colours, "id").where("new < colour").select("id", F.col("new").alias("colour")), "colours")
            colours = stored(colours.join(better, "id", "left_anti").unionByName(better), "colours")
            front = better
        back = live.join(colours.select(F.col("id").alias("src"), "colour"), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other")
        back = stored(back.select("src", "dst"), "colour-links")
        found = front = stored(colours.where("id = colour").select("id", F.col("colour").alias("component")), "components")
        while has_rows(front):
            new = front.join(back, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "component").distinct()
            front = stored(new.join(found, "id", "left_anti"), "components")
            found = found.unionByName(front)
        found = stored(found, "components")
        whole = whole.unionByName(found)
        gone = lambda x: found.select(F.col("id").alias(x))  # noqa: E731, B023
        rest = stored(live.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti"), "cycle-links")
        discard(live, back)
        live = rest
    single = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(whole.join(single, "component", "left_semi").select("id", "component"), "components")


def _first_of_any(start: DataFrame, steps: DataFrame, reached: DataFrame) -> DataFrame:
    """root, id, path: the first occurrence of each node in depth-first order.

    Once the walk enters a component of nodes that lead to one another it doesn't leave it for good before all of them were
    visited, and what it visits outside never leads back. So the first path into a component is the least of the first paths of the nodes that
    link into it, with that step, and the order inside depends only on where it was entered and the links inside. Components
    are finished once all that link into them are, a round of joins for each; only one that holds a cycle is walked, by its own links.
    """
    member = cyclic_components(steps)
    named = steps.join(member.select(F.col("id").alias("src"), F.col("component").alias("of_src")), "src", "left").join(member.select(F.col("id").alias("dst"), F.col("component").alias("of_dst")), "dst", "left")
    named = stored(named.withColumns({"of_src": F.coalesce("of_src", "src"), "of_dst": F.coalesce("of_dst", "dst")}), "named-links")
    across, within = named.where("of_src <> of_dst"), named.where("of_src = of_dst AND src <> dst")
    any_cycle = has_rows(member)
    need = reached.join(across, F.col("id") == F.col("src")).groupBy("root", F.col("of_dst").alias("component")).agg(F.count(F.lit(1)).alias("need"))
    waiting = stored(need.select("root", "component", "need", F.lit(0).cast("long").alias("have"), F.lit(None).cast(f"array<{_STEP}>").alias("path"), F.lit(None).cast("string").alias("id")), "waiting")
    front = stored(_inner(start, member, within), "paths") if any_cycle else start
    best = front
    while has_rows(front):
        came = front.join(across, F.col("id") == F.col("src")).select("root", F.col("of_dst").alias("component"), F.lit(0).cast("long").alias("need"), F.lit(1).cast("long").alias("have"), F.concat("path", F.array(F.struct("at", "last"))).alias("path"), F.col("dst").alias("id"))
        now = waiting.unionByName(came).groupBy("root", "component").agg(F.max("need").alias("need"), F.sum("have").alias("have"), F.min_by(F.struct("path", "id"), "path").alias("p"))
        now = stored(now.select("root", "component", "need", "have", "p.path", "p.id"), "waiting")
        entered = now.where("have = need").select("root", "id", "path")
        front = stored(_inner(entered, member, within) if any_cycle else entered, "paths")
        best = best.unionByName(front)
        waiting = now.where("have < need")
    return stored(best, "paths")


def _inner(entered: DataFrame, member: DataFrame, within: DataFrame) -> DataFrame:
    """root, id, path of all nodes of the components entered at (root, id, path); nodes outside cycles stand for themselves."""
    entered = stored(entered, "entered")
    inside = entered.select("id").distinct().join(member, "id")
    links = inside.select(F.col("id").alias("root"), F.col("component").alias("of_src")).join(within, "of_src")
    kind = F.lit("component")
    links = links.select("root", F.col("src").alias("id"), kind.alias("kind"), "dst", kind.alias("dst_kind"), "at", "last")
    walked = links.repartition("root").sortWithinPartitions("root", "id", "at").mapInArrow(_walks_of(None), OCCURRENCES).where("marker IS NULL")
    walked = walked.select(F.col("root").alias("entry"), F.col("id").alias("inner"), F.col("path").alias("more"))
    both = entered.join(walked, F.col("id") == F.col("entry"), "left")
    return both.select("root", F.coalesce("inner", "id").alias("id"), F.when(F.col("inner").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"))


_WALKED = pa.schema(
    [("root", pa.string()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("last", pa.bool_())]))), ("depth", pa.int32())]
    + [(name, pa.string()) for name in ("id", "parent", "kind", "marker")]
)
#: Links of a node that a walk reads at once, and occurrences and steps of their paths that it returns at once.
_READ, _ROWS, _STEPS = 1_000, 5_000, 200_000


def _walks_of(level: int | None):
    """Walks over the links of one component each, in tasks; ``level`` as in ``tree_of_any``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """batches: links sorted by root. Each root's links go to a database of their own and are walked when the next root begins."""
        root, db = None, None
        for batch in batches:
            roots = batch.column("root").to_pylist()
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("id", "at", "last", "dst", "kind", "dst_kind")), strict=True))
            start = 0
            for end in [i for i in range(1, len(roots)) if roots[i] != roots[i - 1]] + [len(roots)]:
                if start < end:
                    if db is None or roots[start] != root:
                        if db is not None:
                            yield from _sliced(_walked(db, root, level))
                            db.close()
                        root, db = roots[start], _database()
                    db.executemany("INSERT INTO links VALUES (?, ?, ?, ?, ?, ?)", rows[start:end])
                start = end
        if db is not None:
            yield from _sliced(_walked(db, root, level))
            db.close()

    return run


def _database() -> sqlite3.Connection:
    """A private database, in memory while it is small and else in a temporary file that ends with it."""
    db = sqlite3.connect("", isolation_level=None)
    db.execute("PRAGMA journal_mode = OFF")
    db.execute("CREATE TABLE links (id TEXT, at INT, last INT, dst TEXT, kind TEXT, dst_kind TEXT)")
    db.execute("CREATE TABLE expanded (id TEXT PRIMARY KEY) WITHOUT ROWID")
    db.execute("BEGIN")
    return db


def _sliced(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, steps = [], 0
    for row in rows:
        held.append(row)
        steps += len(row[1])
        if len(held) >= _ROWS or steps >= _STEPS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _WALKED, strict=True)], schema=_WALKED)
            held, steps = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _WALKED, strict=True)], schema=_WALKED)


def _walked(db: sqlite3.Connection, root: str, level: int | None) -> Iterator[tuple]:
    """Depth-first over one root's links; a stack of the open nodes only, so long chains and wide nodes are fine."""
    db.execute("CREATE INDEX ordered ON links (id, at)")

    def below(id: str) -> Iterator[tuple]:
        at = 0
        while found := db.execute("SELECT at, last, dst, dst_kind FROM links WHERE id = ? AND at > ? ORDER BY at LIMIT ?", (id, at, _READ)).fetchall():
            yield from found
            at = found[-1][0]

    def expands(id: str, depth: int) -> bool:
        """Mark the node as expanded; whether its links are to be followed."""
        db.execute("INSERT INTO expanded VALUES (?)", (id,))
        return level is None or depth < level

    kind = db.execute("SELECT kind FROM links WHERE id = ? LIMIT 1", (root,)).fetchone()[0]
    yield root, [], 0, root, None, kind, None
    above, path, stack = set(), [], []
    if kind not in TERMINAL_KINDS and expands(root, 0):
        above.add(root)
        stack.append((root, below(root)))
    while stack:
        parent, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            above.discard(parent)
            if path:
                path.pop()
            continue
        at, last, id, kind = step
        path.append({"at": at, "last": bool(last)})
        again = db.execute("SELECT 1 FROM expanded WHERE id = ?", (id,)).fetchone() is not None
        marker = "recursive" if id in above else "*" if again else {"builtin": "builtin", "unknown": "unresolved"}.get(kind)
        yield root, list(path), len(path), id, parent, kind, marker
        if id not in above and not again and kind not in TERMINAL_KINDS and expands(id, len(path)):
            above.add(id)
            stack.append((id, below(id)))
        else:
            path.pop()


def walks(graph: Graph, root: str, direction: str = "uses", level: int | None = None, stop: Column | None = None) -> DataFrame:
    """path (ids from the root, as an array), depth, id, recursive: every visit of the plain traversal, which cuts
    cycles but expands nodes again wherever they occur, up to ``level`` steps or without a limit. stop: as in ``tree_of_any``."""
    edges = ways(graph, direction)
    if stop is not None:
        edges = edges.join(graph.nodes.where(F.coalesce(stop, F.lit(False))).select(F.col("id").alias("src")), "src", "left_anti")
    steps = stored(children(edges), "children")
    frontier = graph.nodes.where(F.col("id") == root).select(F.array("id").alias("path"), F.expr("cast(array() as array<int>)").alias("places"), "id", F.lit(False).alias("recursive"))
    every = frontier = stored(frontier, "walks")
    depth = 0
    while level is None or depth < level:
        depth += 1
        on = frontier.where("NOT recursive").join(steps, F.col("id") == F.col("src"))
        frontier = on.select(F.concat("path", F.array("dst")).alias("path"), F.concat("places", F.array("at")).alias("places"), F.col("dst").alias("id"), F.array_contains("path", F.col("dst")).alias("recursive"))
        frontier = stored(frontier, "walks")
        if not has_rows(frontier):
            break
        every = every.unionByName(frontier)
    return every.select("path", "places", (F.size("path") - 1).alias("depth"), "id", "recursive")


#: Visits are counted up to this many.
MANY = 10**30


def visit_counts(graph: Graph, direction: str = "uses") -> DataFrame:
    """id, visits: how many visits the plain traversal from each node makes (see ``walks``), for all nodes at once.

    A node without cycles below it is visited once, and all below each of its children as often as from there; so counts are
    added up along the links, from the ends back, a round of joins for each step, and nothing is walked twice. Within a component
    that holds a cycle the paths that meet no node twice are walked, by joins, and each is multiplied by what lies outside. Counts
    above MANY are MANY.
    """
    edges = ways(graph, direction, "src", "dst")
    links = stored(edges.distinct(), "links")
    discard(edges)
    member = cyclic_components(links)
    of = lambda x: member.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    named = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    named = stored(named.withColumns({"of_src": F.coalesce("of_src", "src"), "of_dst": F.coalesce("of_dst", "dst")}), "named-links")
    discard(links)
    across, within = named.where("of_src <> of_dst"), named.where("of_src = of_dst")
    nodes = stored(graph.nodes.select("id").join(member, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "members")
    inner = _inner_walks(within)
    count = lambda c: F.least(F.lit(str(MANY)).cast("decimal(38, 0)"), c.cast("decimal(38, 0)"))
    need = nodes.join(across.groupBy(F.col("of_src").alias("component")).agg(F.count(F.lit(1)).alias("need")), "component", "left").select("id", "component", F.coalesce("need", F.lit(0)).alias("need"))
    waiting = stored(need.select("id", "component", "need", F.lit(0).cast("long").alias("have"), count(F.lit(0)).alias("below")), "waiting")
    done = None
    while has_rows(waiting):
        have = waiting.groupBy("component").agg(F.sum("have").alias("all"))
        state = stored(waiting.join(have, "component"), "counted")
        discard(waiting)
        ready = state.where("all = need")
        times = ready.join(inner, "id", "left").select("id", F.coalesce("inner", "id").alias("inner"), F.coalesce("n", count(F.lit(1))).alias("n"), F.coalesce("closed", F.lit(0)).alias("closed"))
        outside = ready.select(F.col("id").alias("inner"), (F.col("below") + 1).alias("each"))
        product = F.coalesce(F.try_multiply(F.col("n").cast("decimal(38, 0)"), F.col("each").cast("decimal(38, 0)")), F.lit(str(MANY)).cast("decimal(38, 0)"))
        now = times.join(outside, "inner").groupBy("id").agg(F.coalesce(F.try_sum(count(product) + F.col("closed")), F.lit(str(MANY)).cast("decimal(38, 0)")).alias("visits"))
        now = stored(now.select("id", count(F.col("visits")).alias("visits")), "visits")
        if not has_rows(now):
            raise AssertionError("links lead in a circle between components")
        done = now if done is None else done.unionByName(now)
        came = now.join(across, F.col("id") == F.col("dst")).groupBy("src").agg(F.count(F.lit(1)).alias("more"), count(F.try_sum("visits")).alias("gained")).withColumnRenamed("src", "id")
        left = state.where("all < need").join(came, "id", "left")
        waiting = stored(left.select("id", "component", "need", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have"), count(F.col("below") + F.coalesce("gained", count(F.lit(0)))).alias("below")), "waiting")
        discard(state)
    discard(waiting, named, nodes)
    return graph.nodes.select("id", F.lit(None).cast("decimal(38, 0)").alias("visits")).limit(0) if done is None else done


def _inner_walks(within: DataFrame) -> DataFrame:
    """id, inner, n, closed: on how many paths inside their component, which meet no node twice, each node leads to each other
    one (itself once), and of these how often a link closes a circle there."""
    front = stored(within.select("src").distinct().select(F.col("src").alias("id"), F.array("src").alias("path")), "inner-walks")
    every = None
    while has_rows(front):
        on = front.join(within, F.element_at("path", -1) == F.col("src")).select("id", "path", "dst", F.array_contains("path", F.col("dst")).alias("closed"))
        on = stored(on, "inner-walks")
        ends = front.select("id", F.element_at("path", -1).alias("inner"), F.lit(1).alias("n"), F.lit(0).alias("closed")).unionByName(on.where("closed").select("id", F.element_at("path", -1).alias("inner"), F.lit(0).alias("n"), F.lit(1).alias("closed")))
        every = ends if every is None else every.unionByName(ends)
        front = on.where("NOT closed").select("id", F.concat("path", F.array("dst")).alias("path"))
    if every is None:
        every = within.select(F.col("src").alias("id"), F.col("dst").alias("inner"), F.lit(1).alias("n"), F.lit(0).alias("closed")).limit(0)
    return stored(every.groupBy("id", "inner").agg(F.sum("n").cast("decimal(38, 0)").alias("n"), F.sum("closed").alias("closed")), "inner-walks")

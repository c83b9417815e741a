"""Lineage and trees over edge tables ``(src, dst)``.

Closures walk level by level: each level is one join of the frontier with the edges and one
anti join with what was seen, written to the shared folder. Only the emptiness of a level
reaches the driver. A node enters once, so cycles end and paths never multiply.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators.forests import CHUNK, KINDS, contract
from weftline.operators.lookup import lookup
from weftline.session import settle, settle_measured
from weftline.specs import ordering


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    pair = edges.select("src", "dst")
    return pair.unionByName(reverse(edges))


def neighbours(edges: DataFrame, node: object) -> tuple[DataFrame, DataFrame]:
    """Direct upstream and downstream nodes of a node, and the edges between the nodes returned."""
    up = edges.where(F.col("dst") == F.lit(node)).select(F.col("src").alias("node"), F.lit("upstream").alias("side"))
    down = edges.where(F.col("src") == F.lit(node)).select(F.col("dst").alias("node"), F.lit("downstream").alias("side"))
    nodes = up.unionByName(down).distinct()
    returned = nodes.select("node").unionByName(
        edges.sparkSession.range(1).select(F.lit(node).cast(edges.schema["src"].dataType).alias("node"))
    ).distinct()
    inner = edges
    for end in ("src", "dst"):
        inner = lookup(inner, returned.withColumnRenamed("node", "__node"), [(end, "__node")], "left_semi")
    return nodes, inner.select(*edges.columns)


def _level(df: DataFrame) -> tuple[DataFrame, bool]:
    """A level written down, and whether it holds any node; counted while it is written."""
    level, seen = settle_measured(df, "level", rows=F.count(F.lit(1)))
    return level, seen["rows"] == 0


# Levels that are read one by one before they are written together.
TOGETHER = 8


class _Reached:
    """The levels found so far. Eight of one size become one, so a deep walk reads few files at each level."""

    def __init__(self, first: DataFrame) -> None:
        self.parts: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, level: DataFrame) -> None:
        self.parts.append((0, level))
        while len(self.parts) >= TOGETHER and len({size for size, _ in self.parts[-TOGETHER:]}) == 1:
            size = self.parts[-1][0]
            merged = reduce(DataFrame.unionByName, [p for _, p in self.parts[-TOGETHER:]])
            self.parts[-TOGETHER:] = [(size + 1, settle(merged, "levels"))]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p for _, p in self.parts])


def _levels(start: DataFrame, edges: DataFrame, most: int | None) -> DataFrame:
    """All nodes reached from ``start`` with their distance; ``start`` has distance 0."""
    links = settle(edges.select("src", "dst").distinct(), "edges")
    frontier = settle(start.select("node", F.lit(0).alias("distance")).distinct(), "level")
    reached = _Reached(frontier)
    distance = 0
    while most is None or distance < most:
        distance += 1
        step = (
            links.join(frontier.select(F.col("node").alias("src")), "src")
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(reached.all().select("node"), "node", "left_anti")
        )
        frontier, empty = _level(step.withColumn("distance", F.lit(distance)))
        if empty:
            break
        reached.add(frontier)
    return reached.all()


def _single(edges: DataFrame, node: object) -> DataFrame:
    kind = edges.schema["src"].dataType
    return edges.sparkSession.range(1).select(F.lit(node).cast(kind).alias("node"))


def downstream(edges: DataFrame, node: object, hops: int | None = None) -> DataFrame:
    """Every node that depends on ``node``, with its distance in edges."""
    return _levels(_single(edges, node), edges, hops).where(F.col("distance") > 0)


def upstream(edges: DataFrame, node: object, hops: int | None = None) -> DataFrame:
    return downstream(reverse(edges), node, hops)


def impact(edges: DataFrame, node: object) -> DataFrame:
    """What a change of ``node`` reaches: dependants per distance."""
    return downstream(edges, node).orderBy("distance", "node")


def neighbourhood(edges: DataFrame, node: object, hops: int) -> DataFrame:
    """Nodes within ``hops`` edges in either direction, the node itself at distance 0."""
    if hops < 0:
        raise Refused("hops cannot be negative")
    return _levels(_single(edges, node), both_ways(edges), hops)


def path(edges: DataFrame, start: object, end: object) -> DataFrame:
    """The shortest path as (position, node); among equals the smallest list of nodes. Empty when none.

    Levels are walked back from the end until the start is met; each node keeps its smallest next node, which begins
    the smallest list from there. The path is read off these by doubling: each round joins the part of the path found
    so far with jumps of its own length.
    """
    links = settle(edges.select("src", "dst").distinct(), "edges")
    goal = _single(edges, end)
    frontier = settle(goal.withColumn("next", F.lit(None).cast(goal.schema["node"].dataType)), "level")
    reached, left, met = _Reached(frontier), 0, start == end
    while not met:
        left += 1
        step = (
            links.join(frontier.select(F.col("node").alias("dst")), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("dst").alias("next"))
            .join(reached.all().select("node"), "node", "left_anti")
        )
        hits = F.count_if(F.col("node") == F.lit(start))
        frontier, seen = settle_measured(step, "level", rows=F.count(F.lit(1)), hits=hits)
        if seen["rows"] == 0:
            return _single(edges, None).select(F.lit(0).alias("position"), "node").where(F.lit(False))
        reached.add(frontier)
        met = seen["hits"] > 0
    walked = settle(_single(edges, start).select(F.lit(0).alias("position"), "node"), "path")
    jumps, length = settle(reached.all().where(F.col("next").isNotNull()).select("node", "next"), "jumps"), 1
    while length <= left:
        more = walked.join(jumps, "node").select((F.col("position") + length).alias("position"), F.col("next").alias("node"))
        walked = settle(walked.unionByName(more), "path")
        further = jumps.select(F.col("node").alias("next"), F.col("next").alias("__beyond"))
        length *= 2
        if length <= left:
            jumps = settle(jumps.join(further, "next").select("node", F.col("__beyond").alias("next")), "jumps")
    return walked


def groups(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Weakly connected groups: every node with the smallest node of its group.

    Each task first contracts its edges to stars, ``chunk`` edges at a time, so that only what lies between tasks is left to
    do. A node that hangs in one star alone has the group of that star's root, so it is put aside with its root, and only
    what the stars share goes on to the next round. Where that is a chunk at most, one task does it; where a round puts
    little aside, two star contractions come first, each a minimum per node and a join. At the end the nodes put aside
    get the groups of their roots, round by round. Loops on one node keep it as its own group.
    """
    linked = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where(F.col("a") != F.col("b"))
    # Nodes of loops and beside a NULL have no pair; alone they are their own group.
    apart = edges.where(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))
    lone = apart.select(F.col("src").alias("a")).unionByName(apart.select(F.col("dst").alias("a")))
    pairs, before = _contracted(linked, chunk)
    first, tops, rest = _put_aside(pairs, lone)
    pairs, rows = _contracted(rest, chunk)
    later: list[DataFrame] = []
    while rows > chunk or (rows and not isinstance(pairs.schema["a"].dataType, KINDS)):
        if 2 * rows > before:
            pairs, rows = _contracted(_small_star(_large_star(pairs)), chunk)
        before = rows
        hung, _, rest = _put_aside(pairs)
        later.append(hung)
        pairs, rows = _contracted(rest, chunk)
    # A chunk at most: one task holds it.
    labels = contract(pairs.coalesce(1), chunk + 1).select(F.col("a").alias("node"), F.col("b").alias("group_id"))
    for hung in reversed(later):
        labels = settle(labels.unionByName(_led(hung, labels)), "labels")
    known = labels.select(F.col("node").alias("__known"))
    # The root of a star was put aside later or is the smallest node of its group.
    smallest = lookup(tops, known, [("node", "__known")], "left_anti").select("node", F.col("node").alias("group_id"))
    return _led(first, labels).unionByName(labels).unionByName(smallest)


def _contracted(pairs: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """Stars of what each task holds, written down, and their number; larger nodes first."""
    stars = contract(pairs, chunk).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, seen = settle_measured(stars, "pairs", rows=F.count(F.lit(1)))
    return stars, seen["rows"]


def _put_aside(pairs: DataFrame, lone: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that hang under one root only and have nothing below them, with that root; nodes that hang under none; and the
    pairs of all other nodes."""
    above = F.lit(None).cast(pairs.schema["a"].dataType)
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"), F.lit(False).alias("below"))
    ends = ends.unionByName(pairs.select(F.col("b").alias("node"), above.alias("root"), F.lit(True).alias("below")).distinct())
    if lone is not None:
        ends = ends.unionByName(lone.select(F.col("a").alias("node"), above.alias("root"), F.lit(False).alias("below")))
    nodes = ends.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("last"), F.bool_or("below").alias("below"))
    alone = (F.col("root") == F.col("last")) & ~F.col("below")
    nodes = settle(nodes.select("node", "root", alone.alias("alone")), "nodes")
    shared = nodes.where(~F.col("alone")).select(F.col("node").alias("__node"))
    rest = lookup(pairs, shared, [("a", "__node")], "left_semi")
    return nodes.where("alone").select("node", "root"), nodes.where(F.col("root").isNull()).select("node"), rest


def _led(hung: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes put aside with the groups of their roots; a root that has none is the smallest node of its group."""
    above = labels.select(F.col("node").alias("__above"), F.col("group_id").alias("__group"))
    return lookup(hung, above, [("root", "__above")]).select("node", F.coalesce("__group", "root").alias("group_id"))


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each pair once, larger node first."""
    return (
        pairs.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node of its neighbourhood."""
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = sides.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"))
    lowest = lowest.select("__a", F.least("__a", "m").alias("m"))
    linked = lookup(sides, lowest, [("a", "__a")], "inner").where(F.col("b") > F.col("a"))
    return _oriented(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    lowest = pairs.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"))
    linked = lookup(pairs, lowest, [("a", "__a")], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(linked.unionByName(lowest.select(F.col("__a").alias("a"), F.col("m").alias("b"))))


def tree_children(nodes: DataFrame, parent: object | None, name: str = "name", key: str = "id") -> DataFrame:
    """Children of a node by name; the roots when no parent is given."""
    wanted = F.col("parent_id").isNull() if parent is None else F.col("parent_id") == F.lit(parent)
    return nodes.where(wanted).orderBy(*[o.column() for o in ordering(name, key)])


def tree_paths(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """Label path and depth of every node reachable from a root.

    Every node points at its parent, and each round it points where its target points, so a tree of depth d takes the
    logarithm of d rounds. The first rounds carry ids alone and leave out what never reaches a root: nodes below an unknown
    parent, and cycles, which no more rounds than the logarithm of the number of nodes tell. The paths are then put
    together in the same way.

    An id that is held twice is refused: it could close a cycle below a root, and its path would be ambiguous.
    """
    rows, seen = settle_measured(nodes.select("id", "parent_id", "name"), "tree", n=F.count(F.lit(1)))
    repeated = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if repeated is not None:
        raise Refused(f"node {repeated['id']!r} is held {repeated['n']} times")
    steps = rows.select("id", F.col("parent_id").alias("above"), F.lit(0).alias("depth"))
    reached = _jumped(steps, seen["n"], lambda low, high: {"depth": low["depth"] + high["depth"] + 1})
    rooted = rows.join(reached.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_semi")
    parts = rooted.select("id", F.col("parent_id").alias("above"), F.col("name").alias("path"))
    paths = _jumped(parts, seen["n"], lambda low, high: {"path": F.concat(high["path"], F.lit(separator), low["path"])})
    found = paths.join(reached.select(F.col("id").alias("__id"), "depth"), F.col("id") == F.col("__id")).select("id", "path", "depth")
    # Rows without an id have nothing below them, but a place below their parent, or are roots.
    nameless = rows.where(F.col("id").isNull()).drop("id")
    above = found.select(F.col("id").alias("__id"), F.col("path").alias("__above"), F.col("depth").alias("__depth"))
    hung = nameless.join(above, F.col("parent_id") == F.col("__id")).select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        F.concat("__above", F.lit(separator), "name").alias("path"),
        (F.col("__depth") + 1).alias("depth"),
    )
    roots = nameless.where(F.col("parent_id").isNull()).select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.col("name").alias("path"), F.lit(0).alias("depth")
    )
    return found.unionByName(hung).unionByName(roots)


def _jumped(rows: DataFrame, count: int, merged: Callable[[dict, dict], dict[str, Column]]) -> DataFrame:
    """Rows ``(id, above, ...)`` followed upwards until ``above`` is NULL; ``merged`` joins a row's columns with those of the
    row above it. Rows that never get there are left out. ``count`` bounds the number of rows."""
    now = rows.where(F.col("id").isNotNull())
    most = max(1, count).bit_length() + 1
    for _ in range(most):
        now, seen = settle_measured(now, "jumps", open=F.count_if(F.col("above").isNotNull()))
        if not seen["open"]:
            return now
        low, high = now.where(F.col("above").isNotNull()).alias("low"), now.alias("high")
        met = low.join(high, F.col("low.above") == F.col("high.id"))
        sides = {c: F.col(f"low.{c}") for c in now.columns}, {c: F.col(f"high.{c}") for c in now.columns}
        columns = {"id": sides[0]["id"], "above": sides[1]["above"], **merged(*sides)}
        now = now.where(F.col("above").isNull()).unionByName(met.select(*[c.alias(n) for n, c in columns.items()]))
    return now.where(F.col("above").isNull())

"""Data flows as composed frames. A flow is declared, checked, then run by one write."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.functions.transforms import FLOW_BANDS, LOWEST_BAND, chain, classify_bands, safe_ratio, sum_null_as_zero
from weftline.operators.paging import page
from weftline.operators.windows import latest_per_key
from weftline.session import settle_measured
from weftline.specs import Step

Transform = Callable[..., DataFrame]


def batch_copy(source: DataFrame, mappings: Sequence[tuple[str, str, Sequence[Step]]]) -> DataFrame:
    """Source to target fields, each through its transform chain."""
    return source.select(*[chain(F.col(a), steps).alias(b) for a, b, steps in mappings])


# -- parameters -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Parameter:
    name: str
    data_type: T.DataType
    default: object = None


def bind_parameters(declared: Sequence[Parameter], given: Mapping[str, object]) -> dict[str, Column]:
    """Typed run parameters, defaults filled in; a name that is not declared is refused."""
    known = {p.name for p in declared}
    unknown = sorted(set(given) - known)
    if unknown:
        raise Refused(f"undeclared run parameters {unknown}")
    return {p.name: F.lit(given.get(p.name, p.default)).cast(p.data_type) for p in declared}


# -- graphs ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A node: its name, what it does with its inputs, and the names of its inputs in order."""

    name: str
    apply: Transform
    inputs: Sequence[str] = ()


@dataclass
class Graph:
    nodes: Sequence[Node]
    edges: list[tuple[str, str]] = field(init=False)

    def __post_init__(self) -> None:
        names = [n.name for n in self.nodes]
        if len(set(names)) != len(names):
            raise Refused("two nodes share a name")
        for node in self.nodes:
            for source in node.inputs:
                if source not in names:
                    raise Refused(f"node {node.name!r} reads unknown node {source!r}")
        self.edges = [(s, n.name) for n in self.nodes for s in n.inputs]

    def ordered(self) -> list[Node]:
        """Every node after its inputs; a cycle is refused."""
        done: dict[str, Node] = {}
        waiting = list(self.nodes)
        while waiting:
            ready = [n for n in waiting if all(i in done for i in n.inputs)]
            if not ready:
                raise Refused(f"the graph has a cycle through {sorted(n.name for n in waiting)}")
            done.update({n.name: n for n in ready})
            waiting = [n for n in waiting if n.name not in done]
        return list(done.values())

    def run(self, watch: Callable[[str, str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
        """The lazy frame of every node; ``watch`` may wrap the frame on each edge."""
        frames: dict[str, DataFrame] = {}
        for node in self.ordered():
            inputs = [frames[s] if watch is None else watch(s, node.name, frames[s]) for s in node.inputs]
            frames[node.name] = node.apply(*inputs)
        return frames

    def describe(self) -> dict[str, list[tuple[str, str]]]:
        """Fields at every node. Building the frames also validates the graph; nothing runs."""
        return {
            name: [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]
            for name, frame in self.run().items()
        }

    def sinks(self) -> list[str]:
        feeding = {s for s, _ in self.edges}
        return [n.name for n in self.nodes if n.name not in feeding]


def edge_counts(graph: Graph, sink: str, write: Callable[[DataFrame], None]) -> dict[tuple[str, str], int]:
    """Run one sink and count the records on each edge that feeds it. For trial runs.

    Every node that the sink needs is written to the shared folder once and counted on the way, so a count is that
    of the node's whole output, whatever part of it the next node pulls, and an empty one is 0.
    """
    needed, queue = set(), [sink]
    while queue:
        target = queue.pop()
        for edge in graph.edges:
            if edge[1] == target and edge not in needed:
                needed.add(edge)
                queue.append(edge[0])
    outputs: dict[str, tuple[DataFrame, int]] = {}
    counts: dict[tuple[str, str], int] = {}

    def watch(source: str, target: str, frame: DataFrame) -> DataFrame:
        if (source, target) not in needed:
            return frame
        if source not in outputs:
            settled, seen = settle_measured(frame, "edge", records=F.count(F.lit(1)))
            outputs[source] = settled, seen["records"]
        counts[source, target] = outputs[source][1]
        return outputs[source][0]

    write(graph.run(watch)[sink])
    return counts


def edge_sample(graph: Graph, source: str, key: Sequence[str], n: int) -> DataFrame:
    """A bounded sample of what leaves a node, by key so that a rerun sees the same rows."""
    if n <= 0:
        raise Refused("a sample needs a positive size")
    return page(graph.run()[source], 0, n, key=key)


# -- the demonstration flow -----------------------------------------------------------------


def player_lines(
    lines: DataFrame, min_games: int, position: str | None = None
) -> DataFrame:
    """Players of enough games, and of one position when given, with total, rate and band."""
    picked = F.col("games") >= min_games
    if position:
        picked = picked & (F.lower("position") == position.lower())
    total = sum_null_as_zero(F.col("passing"), F.col("rushing"), F.col("receiving"))
    return (
        lines.where(picked)
        .withColumn("total", total)
        .withColumns(
            {
                "rating": safe_ratio(F.col("total"), F.col("games")),
                "classification": classify_bands(F.col("total"), FLOW_BANDS, LOWEST_BAND),
            }
        )
    )


def player_counts(lines: DataFrame, min_games: int, position: str | None = None) -> DataFrame:
    """Extracted, transformed and failed records of the flow, in one pass."""
    kept = F.coalesce(F.col("games") >= min_games, F.lit(False))
    if position:
        kept = kept & F.coalesce(F.lower("position") == position.lower(), F.lit(False))
    return lines.agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(kept).alias("transformed"),
        F.count_if(~kept).alias("failed"),
    )


# -- runs -----------------------------------------------------------------------------------


def flow_status(runs: DataFrame, flow: str = "flow", started: str = "started_at", run: str = "run_id") -> DataFrame:
    """The latest run of every flow."""
    return latest_per_key(runs, [flow], [started, run])


def flow_history(runs: DataFrame, flow: str, name: str, started: str = "started_at", run: str = "run_id") -> DataFrame:
    """The runs of one flow, newest first."""
    return runs.where(F.col(flow) == name).orderBy(F.col(started).desc(), F.col(run).desc())

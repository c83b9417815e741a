"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.lookup import lookup
from weftline.session import settle_measured

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge ``(a, b)`` of longs; the root is the component's smallest node.

    Each round hangs every node under the least node around it, first its larger neighbours, then the smaller ones.
    A round is written to the shared folder and read back, so a lost executor costs one round at most. Neighbourhoods
    are never collected: a round takes minima, combined before the shuffle, and joins them back by ``lookup``, which
    leaves a hub's edges to be split as a skewed join. Loops are ignored; repeated edges count once; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    before = None
    for _ in range(MAX_ROUNDS):
        now, seen = settle_measured(
            _small_star(_large_star(now)),
            "components",
            n=F.count(F.lit(1)),
            mark=F.bit_xor(F.xxhash64("a", "b")),
        )
        if seen == before:
            roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        before = seen
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m")).select("hub", F.least("hub", "m").alias("m"))
    return lookup(both, least, [("a", "hub")], "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger node to the smaller."""
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
    down = lookup(edges, least, [("a", "hub")], "inner").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("hub", "m")).distinct()

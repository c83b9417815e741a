"""The trie of conversations' prefixes, with totals of every subtree.

A node is named by its depth and by sums of hashes of its turns and their places, so that all prefixes of a conversation
are named by one running sum. Subtree totals go up by time-forward processing: nodes are sorted in reverse level
order, and a node's totals travel to its parent through a priority queue, first within shards, each a subtree of
bounded weight, then through the nodes above all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.queues import SpillingQueue
from weftline.operators.lookup import lookup
from weftline.operators.windows import WindowColumn, running
from weftline.session import settle, settle_measured
from weftline.specs import Ordering

#: Sums that name a node, of numbers below 2^38: their running sums stay exact for 2^25 turns, beyond which Spark fails.
LANES = ("lane_0", "lane_1", "lane_2", "lane_3")
NODE = ("depth", "a", "b")
#: Turns below the root of a shard: a share of all turns, within bounds.
SHARE, LEAST, MOST = 2000, 256, 200_000
#: Conversation ids that one block of an end list holds.
BLOCK = 8192
EMPTY = hashlib.sha256(b"").hexdigest()
TOTALS = "n_children long, n_leaves long, saved_tokens long"


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, place, content, n_bytes`` from ``conv_id, turn, role, text``; places count from 1.

    Turns go by ``turn``, null first; equal turns by role, then by a digest of the text. A null role or text is empty. Rows
    without a conversation belong to none and are left out. A conversation of very many turns is numbered in chunks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length keeps role and text apart.
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        content.alias("content"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [Ordering("turn"), Ordering("role"), Ordering("content")]
    numbered = running(settle(slim, "turns"), ["conv_id"], order, [WindowColumn("place", "row_number")])
    return numbered.select("conv_id", F.col("place").cast("long").alias("place"), "content", "n_bytes")


def _borrowed(conv: Column) -> Column:
    """How many turns a conversation takes over: by its id's checksum, 8 at most."""
    return (F.crc32(conv.cast("string").cast("binary")) % 9).cast("long")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns where a conversation c begins with those of conversation c - c % 5 and goes on with its own.

    It takes the first h turns, fewer if there are fewer, in place of its own first h.
    """
    c = F.col("conv_id")
    lengths = turns.groupBy("conv_id").agg(F.least(F.max("place"), F.lit(8)).alias("held"))
    heirs = convs.where(F.pmod(c, F.lit(5)) != 0).withColumn("base", c - F.pmod(c, F.lit(5)))
    lengths = lengths.withColumnRenamed("conv_id", "base")
    short = heirs.join(lengths, "base", "left").select(
        c.alias("heir"), F.greatest(F.lit(0), _borrowed(c) - F.coalesce("held", F.lit(0))).alias("missing")
    )
    first = turns.where((F.pmod(c, F.lit(5)) == 0) & (F.col("place") <= 8))
    # At most eight turns for each of four heirs.
    taken = first.withColumn("heir", F.explode(F.array(*[c + k for k in range(1, 5)])))
    taken = taken.where(F.col("place") <= _borrowed(F.col("heir"))).drop("conv_id").withColumnRenamed("heir", "conv_id")
    taken = taken.join(convs, "conv_id", "left_semi").select("conv_id", "place", "content", "n_bytes")
    whole = turns.where(F.pmod(c, F.lit(5)) == 0)
    own = turns.where((F.pmod(c, F.lit(5)) != 0) & (F.col("place") > _borrowed(c)))
    moved = lookup(own, short.where("missing > 0"), [("conv_id", "heir")])
    moved = moved.withColumn("place", F.col("place") - F.coalesce("missing", F.lit(0))).drop("missing")
    return whole.unionByName(taken).unionByName(moved)


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, parent_a, parent_b, n_bytes``: the node of every prefix of at least one turn."""
    hashes = {
        lane: F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col("place"), F.col("content")), 26) for i, lane in enumerate(LANES)
    }
    sums = [WindowColumn(f"s_{lane}", "sum", lane) for lane in LANES]
    named = running(turns.withColumns(hashes), ["conv_id"], [Ordering("place")], sums)

    def names(depth: Column, *lanes: Column) -> list[Column]:
        return [F.xxhash64(F.lit(seed), depth, *lanes) for seed in (1, 2)]

    depth = F.col("place")
    a, b = names(depth, *[F.col(f"s_{lane}") for lane in LANES])
    up_a, up_b = names(depth - 1, *[F.col(f"s_{lane}") - F.col(lane) for lane in LANES])
    return named.select(
        "conv_id", depth.alias("depth"), a.alias("a"), b.alias("b"), up_a.alias("parent_a"), up_b.alias("parent_b"), "n_bytes"
    )


def _root_name() -> dict[str, Column]:
    zeros = [F.lit(0).cast("long")] * (1 + len(LANES))
    return {"depth": zeros[0], "a": F.xxhash64(F.lit(1), *zeros), "b": F.xxhash64(F.lit(2), *zeros)}


def _root(convs: DataFrame) -> DataFrame:
    return convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[column.alias(name) for name, column in _root_name().items()],
        "conv_id",
        "n_convs",
        F.lit(None).cast("long").alias("parent_a"),
        F.lit(None).cast("long").alias("parent_b"),
        F.lit(0).cast("long").alias("n_bytes"),
    )


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come shard by shard in reverse level order, one queue for each shard."""
    shard, queue = None, SpillingQueue()
    for batch in batches:
        children, leaves, saved = [], [], []
        names = ("shard_a", "shard_b", *NODE, "parent_a", "parent_b", "n_convs", "n_bytes", "from_children", "from_leaves", "from_saved")
        for sa, sb, depth, a, b, pa_, pb, n, size, c, l, s in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if (sa, sb) != shard:
                shard, queue = (sa, sb), SpillingQueue()
            while (first := queue.peek()) is not None and first[:3] == (-depth, a, b):
                _, _, _, below, worth = queue.pop()
                c, l, s = c + 1, l + below, s + worth
            l, s = l if c else 1, s + (n - 1) * size
            children.append(c)
            leaves.append(l)
            saved.append(s)
            if depth:
                queue.push((1 - depth, pa_, pb, l, s))
        kept = [*NODE, "parent_a", "parent_b", "conv_id", "n_convs"]
        totals = [pa.array(x, pa.int64()) for x in (children, leaves, saved)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in kept), *totals], names=[*kept, "n_children", "n_leaves", "saved_tokens"]
        )


def _processed(dealt: DataFrame) -> DataFrame:
    order = ["shard_a", "shard_b", F.col("depth").desc(), "a", "b"]
    kept = [*NODE, "parent_a", "parent_b", "conv_id", "n_convs"]
    return dealt.sortWithinPartitions(*order).mapInArrow(_forward, ", ".join(f"{c} long" for c in kept) + ", " + TOTALS)


def prefix_trie(walked: DataFrame, convs: DataFrame, most: int | None = None) -> DataFrame:
    """Per node: ``depth, a, b, parent_a, parent_b, conv_id, n_convs, n_children, n_leaves, saved_tokens``.

    ``walked`` are the prefixes by :func:`paths`, ``convs`` all conversations, also those without a turn. ``conv_id``
    is a node's smallest member. ``most`` bounds the turns at and below the root of a shard: nodes above that weight, and
    the trie's root, belong to no shard. They are few, a conversation's turns over ``most`` at most, and take the
    totals of shard roots summed by parent. No conversations give no rows.
    """
    lengths = walked.groupBy("conv_id").agg(F.max("depth").alias("last")).withColumnRenamed("conv_id", "whose")
    weighed = lookup(walked, lengths, [("conv_id", "whose")], "inner")
    nodes, seen = settle_measured(
        weighed.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("parent_a").alias("parent_a"),
            F.max("parent_b").alias("parent_b"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("last") - F.col("depth") + 1).alias("weight"),
        ),
        "trie-nodes",
        turns=F.sum("n_convs"),
    )
    most = most or min(MOST, max(LEAST, (seen["turns"] or 0) // SHARE))
    heavy = nodes.where(F.col("weight") > most)
    light = nodes.where(F.col("weight") <= most)
    # A conversation's path leaves the heavy nodes once, and all members of a light node leave them at the same place.
    below = walked.join(heavy.select(*NODE), list(NODE), "left_anti")
    leaving = below.groupBy("conv_id").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    leaving = leaving.select(F.col("conv_id").alias("whose"), F.col("top.a").alias("shard_a"), F.col("top.b").alias("shard_b"))
    nothing = {x: F.lit(0).cast("long") for x in ("from_children", "from_leaves", "from_saved")}
    sharded = lookup(light, leaving, [("conv_id", "whose")], "inner").withColumns(nothing)
    done = settle(_processed(sharded.repartition("shard_a", "shard_b")), "trie-shards")
    above = heavy.drop("weight").unionByName(_root(convs))
    # What shard roots say, summed by the node above them; other messages stayed inside.
    owners = above.select(*[F.col(c).alias(f"up_{c}") for c in NODE])
    said = done.withColumn("up", F.col("depth") - 1)
    said = lookup(said, owners, [("up", "up_depth"), ("parent_a", "up_a"), ("parent_b", "up_b")], "inner")
    told = said.groupBy(F.col("up").alias("t_depth"), F.col("parent_a").alias("t_a"), F.col("parent_b").alias("t_b")).agg(
        F.count(F.lit(1)).alias("from_children"), F.sum("n_leaves").alias("from_leaves"), F.sum("saved_tokens").alias("from_saved")
    )
    fed = above.join(told, [above[c] == told[f"t_{c}"] for c in NODE], "left").drop(*[f"t_{c}" for c in NODE])
    fed = fed.fillna(0, ["from_children", "from_leaves", "from_saved"])
    fed = fed.withColumns({"shard_a": F.lit(0).cast("long"), "shard_b": F.lit(0).cast("long")})
    return done.unionByName(_processed(fed.repartition(1)))


def endings(walked: DataFrame, convs: DataFrame) -> DataFrame:
    """``depth, a, b, conv_id``: the node at which each conversation ends; the root for one without turns."""
    last = walked.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("node")).select("conv_id", "node.*")
    none = convs.join(last.select("conv_id"), "conv_id", "left_anti").withColumns(_root_name())
    return last.select(*NODE, "conv_id").unionByName(none.select(*NODE, "conv_id"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one node, comma-joined, at most BLOCK in a row."""
    node, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*NODE, "first", "ids"])
        out.clear()
        return made

    for batch in batches:
        for depth, a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if (depth, a, b) != node or len(ids) == BLOCK:
                flush()
                node = (depth, a, b)
            ids.append(conv)
        yield batch_of()
    flush()
    yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's blocks, which come in order; one block is held at a time."""
    node, state, out = None, None, []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(),) * 3 + (pa.string(),)
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*NODE, "ends_sha256"])
        out.clear()
        return made

    for batch in batches:
        for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if (depth, a, b) != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield batch_of()
    if state is not None:
        out.append((*node, state.hexdigest()))
    yield batch_of()


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` for every node at which a conversation ends: the digest of their ids, ascending.

    A digest is taken in order, but a node's ids never meet as rows: ranges of them become blocks in parallel, and one
    task reads a node's blocks one after the other.
    """
    count = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(ends, "trie-ends").repartitionByRange(count, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    blocks = ranged.mapInArrow(_blocks, "depth long, a long, b long, first long, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        _hashed, "depth long, a long, b long, ends_sha256 string"
    )


def trie_report(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, parents named by their smallest member."""
    convs = settle(rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), "convs")
    turns = settle(turns_of(rows), "places")
    walked = settle(paths(settle(rebuilt(turns, convs), "rebuilt")), "paths")
    nodes = settle(prefix_trie(walked, convs), "trie")
    ends = ends_digests(endings(walked, convs))
    parents = nodes.select(
        (F.col("depth") + 1).alias("p_depth"), F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("conv_id").alias("parent_conv_id")
    )
    placed = lookup(nodes, parents, [("depth", "p_depth"), ("parent_a", "p_a"), ("parent_b", "p_b")])
    return placed.join(ends, list(NODE), "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )

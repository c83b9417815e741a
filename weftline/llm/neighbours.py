"""Approximate nearest neighbours over learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into parts of equal size that keep neighbours
together. A small classifier learns to tell a vector's part. It places every vector of the table in its most probable
part and sends a query to as many parts as the sample needed for the wanted recall; there all vectors are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.cells import block_of, ranked, search_cells, usable
from weftline.session import settle

#: The documented bound of the sample that the index is fitted on, and the parts it is cut into at most.
SAMPLE, PARTS = 4096, 16
GRAPH_NEIGHBOURS, SWEEPS, EPOCHS, HIDDEN = 12, 8, 25, 128
#: Rows of a cell.
BLOCK, QUERIES = 8192, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows by inner product, in blocks."""
    k = min(k, len(x) - 1)
    found = np.empty((len(x), k), np.int64)
    for start in range(0, len(x), 512):
        scores = x[start : start + 512] @ x.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -np.inf
        found[start : start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """A part for each node, none above a twentieth over the mean, that cuts few edges.

    Nodes first fill parts around distant centres, then move to where most of their neighbours are, the surest first, as
    long as there is room.
    """
    rng = np.random.default_rng(seed)
    room = math.ceil(1.05 * len(x) / parts)
    centres = x[rng.choice(len(x), parts, replace=False)]
    part = np.zeros(len(x), np.int64)
    for _ in range(SWEEPS):
        part = _filled(x @ centres.T, room)
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    for _ in range(SWEEPS):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=len(x) * parts).reshape(len(x), parts)
        part = _filled(votes + 0.5 * (part[:, None] == np.arange(parts)), room)
    return part


def _filled(wish: np.ndarray, room: int) -> np.ndarray:
    """The most wished part with room, nodes with the clearest wish first."""
    ordered = np.sort(wish, axis=1)
    margin = ordered[:, -1] - (ordered[:, -2] if wish.shape[1] > 1 else 0)
    choice, free = np.argsort(-wish, axis=1, kind="stable"), np.full(wish.shape[1], room)
    part = np.zeros(len(wish), np.int64)
    for node in np.argsort(-margin, kind="stable").tolist():
        part[node] = next(p for p in choice[node].tolist() if free[p])
        free[part[node]] -= 1
    return part


@dataclass(frozen=True)
class Router:
    """One hidden layer: the probability of each part."""

    first: np.ndarray
    second: np.ndarray
    probes: int

    def odds(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        hidden = np.maximum(np.hstack([x, np.ones((len(x), 1))]) @ self.first, 0)
        return np.hstack([hidden, np.ones((len(x), 1))]) @ self.second


def _train(x: np.ndarray, wanted: np.ndarray, seed: int) -> Router:
    """Cross entropy against the shares of a node's neighbourhood, by Adam."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])
    weights = [rng.normal(0, 1.5 / math.sqrt(x.shape[1] / 8), (x.shape[1], HIDDEN)), rng.normal(0, 0.1, (HIDDEN + 1, wanted.shape[1]))]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            hidden = np.maximum(x[batch] @ weights[0], 0)
            wide = np.hstack([hidden, np.ones((len(batch), 1))])
            odds = wide @ weights[1]
            share = np.exp(odds - odds.max(axis=1, keepdims=True))
            error = (share / share.sum(axis=1, keepdims=True) - wanted[batch]) / len(batch)
            slopes = [x[batch].T @ ((error @ weights[1][:-1].T) * (hidden > 0)), wide.T @ error]
            step += 1
            for i, slope in enumerate(slopes):
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                weights[i] = weights[i] - 0.004 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Router(weights[0], weights[1], wanted.shape[1])


def fit(x: np.ndarray, k: int, recall: float, seed: int = 7) -> Router:
    """Graph, parts, classifier, and the number of parts to ask for the wanted recall within the sample.

    The recall is taken on a fifth of the sample that the classifier does not see. Fewer than 128 vectors are one part.
    """
    parts = min(PARTS, len(x) // 64)
    if parts < 2:
        return Router(np.zeros((x.shape[1] + 1, 1)), np.zeros((2, 1)), 1)
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    part = balanced_parts(x, graph, parts, seed)
    wanted = 0.5 * (part[:, None] == np.arange(parts)).astype(float)
    for p in range(parts):
        wanted[:, p] += 0.5 * (part[graph] == p).mean(axis=1)
    asked = np.arange(len(x)) % 5 == 0
    router = _train(x[~asked], wanted[~asked], seed)
    placed = np.argmax(router.odds(x), axis=1)
    order = np.argsort(-router.odds(x[asked]), axis=1, kind="stable")
    near = neighbour_graph(x, k)[asked]
    place = np.argsort(order, axis=1, kind="stable")
    found = np.take_along_axis(place, placed[near], axis=1)
    probes = next(p for p in range(1, parts + 1) if (found < p).mean() >= recall or p == parts)
    return Router(router.first, router.second, probes)


def _placed(router: Router):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                part = pa.array(np.argmax(router.odds(x), axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), part], names=["vec_id", "v", "part"])

    return rows


def _routed(router: Router, sizes: np.ndarray, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                order = np.argsort(-router.odds(x), axis=1, kind="stable")
                # More parts where the chosen ones hold too few vectors for an answer.
                enough = np.argmax(np.cumsum(sizes[order], axis=1) > k, axis=1) + 1
                enough[sizes.sum() <= k] = order.shape[1]
                asked = [o[: max(router.probes, int(e))].tolist() for o, e in zip(order, enough, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(asked, pa.list_(pa.int32()))], names=["query_id", "v", "parts"])

    return rows


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added component by component, so equal vectors get equal scores."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best(k: int):
    def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for start in range(0, len(queries), 128):
            own, q = query_ids[start : start + 128], queries[start : start + 128]
            scores = q @ vectors.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            kth = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
            # The rounding of a product taken in another order is far below this slack.
            slack = 1e-12 * (1 + np.abs(q).sum(axis=1) * np.abs(vectors).max())
            row, column = np.nonzero((scores >= (kth - slack)[:, None]) & (scores > -np.inf))
            exact = _products(q[row], vectors[column])
            order = np.lexsort((ids[column], -exact, row))
            row, column, exact = row[order], column[order], exact[order]
            first = np.searchsorted(row, row, "left")
            kept = np.arange(len(row)) - first < k
            out.append((own[row[kept]], ids[column[kept]], exact[kept]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return best


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Per query the ``k`` nearest found by inner product: ``query_id, rank, vec_id, score double``.

    An inner product needs equal lengths, so each length of vectors has an index of its own, and a query asks that of its
    length. An index is fitted on the ``SAMPLE`` vectors with the smallest hash of the id and holds every vector. Queries are the
    rows that ``is_query`` holds for, candidates all rows but those of the query's own id. Ties go to the smaller id;
    fewer candidates than ``k`` are all returned. Rows without an id, with a null or zero vector, or with null or non-finite
    components take no part. Rows that repeat an id are, for each length, one vector, the smallest. No queries or an empty
    table give no rows; other columns are ignored.
    """
    rows = usable(vectors, key, column).where(F.exists("v", lambda x: x != 0))
    lengths = [r["w"] for r in rows.select(F.size("v").alias("w")).distinct().orderBy("w").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_found(rows.where(F.size("v") == w), is_query, k, recall) for w in lengths]
    return ranked(reduce(DataFrame.unionByName, parts), k)


def _found(rows: DataFrame, is_query: Column, k: int, recall: float) -> DataFrame:
    """The best of each cell, for vectors of one length."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = np.array(picked.column("v").to_pylist(), float)
    router = fit(sample, k, recall)
    placed = settle(rows.mapInArrow(_placed(router), "vec_id long, v array<double>, part int"), "neighbours")
    sizes = np.zeros(router.second.shape[1], np.int64)
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["part"]] = r["n"]
    asked = placed.where(F.coalesce(is_query, F.lit(False)))
    routed = asked.mapInArrow(_routed(router, sizes, k), "query_id long, v array<double>, parts array<int>")
    routed = settle(routed.select("query_id", "v", F.explode("parts").alias("part")), "neighbour-queries")
    asks = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A part of any size is spread over blocks, and so are the queries it gets.
    blocks = F.array(*[F.lit(max(1, math.ceil(int(n) / BLOCK))) for n in sizes])
    groups = F.array(*[F.lit(max(1, math.ceil(asks.get(p, 0) / QUERIES))) for p in range(len(sizes))])
    of = lambda counts: F.element_at(counts, F.col("part") + 1)
    cells = placed.select("vec_id", "v", "part", block_of("vec_id", of(blocks), 1).alias("b"), F.explode(F.sequence(F.lit(1), of(groups))).alias("g"))
    dealt = routed.select(
        "query_id", "v", "part", F.explode(F.sequence(F.lit(0).cast("long"), of(blocks) - F.lit(1).cast("long"))).alias("b"), (block_of("query_id", of(groups), 2) + 1).cast("int").alias("g")
    )
    return search_cells(cells, dealt, ["part", "b", "g"], _best(k), "double")

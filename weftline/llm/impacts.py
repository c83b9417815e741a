"""Exact top-k inner products from an impact-ordered index, score at a time.

Components are integers. Each block of vectors has an index: for every component its value range is cut into levels, and
the vectors of a level are one posting segment. Against a query a segment has one quantised impact, the most that its
component can add to a score above the least possible. Segments of all components are read by descending impact. What a
vector has gathered, plus the highest impact left for each component it was not yet met in, bounds its score from above.
Reading stops only when all vectors whose bound reaches the k-th best exact score found are few enough to be scored
exactly; nothing else can be a member. A component of which nothing was read yet adds no more than its own highest impact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.cells import block_of, ranked, search_cells, usable

LEVELS = 32
#: Shares of the postings after which the proof is tried.
SHARES = (0.85, 1.0)
#: Queries that read the segments side by side.
TOGETHER = 128
#: Rows of a cell.
BLOCK, QUERIES = 8192, 1024


class Index:
    """Posting segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.n = ids, len(ids)
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (x - self.low) // self.width
        self.postings = [np.argsort(level[:, d], kind="stable") for d in range(x.shape[1])]
        self.sizes = np.stack([np.bincount(level[:, d], minlength=LEVELS) for d in range(x.shape[1])])
        self.begins = np.concatenate([np.zeros((x.shape[1], 1), np.int64), np.cumsum(self.sizes, axis=1)], axis=1)
        starts = self.low[:, None] + np.arange(LEVELS) * self.width[:, None]
        self.bottom = np.minimum(starts, self.high[:, None])
        self.top = np.minimum(starts + self.width[:, None] - 1, self.high[:, None])
        self.x = x

    def scored(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return _products(self.x[rows], query)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows and exact scores of the k best vectors of the block but the query's own."""
        if self.n <= 4 * k:
            return [self._chosen(np.arange(self.n), int(i), q, k) for i, q in zip(query_ids, queries, strict=True)]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(queries), TOGETHER):
            out += self._together(query_ids[start : start + TOGETHER], queries[start : start + TOGETHER], k)
        return out

    def _together(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        q = queries[:, :, None]
        # Above the least that a component can add, no impact is negative.
        least = np.where(queries > 0, queries * self.low, queries * self.high)
        impact = np.where(q > 0, q * self.top, q * self.bottom) - least[:, :, None]
        impact = np.where(self.sizes > 0, impact, 0)
        highest, floor = impact.max(axis=2), least.sum(axis=1)
        # One number holds the impacts gathered and, in its upper bits, the components met; the shorter the faster.
        bits = len(self.low).bit_length() + 1
        kind = next((t for t in (np.int32, np.int64) if float(highest.sum(axis=1).max()) < 2.0 ** (8 * np.dtype(t).itemsize - bits)), None)
        if kind is None:
            raise OverflowError("components are too large to be summed exactly")
        unit = 1 << 8 * np.dtype(kind).itemsize - bits
        gathered = np.zeros((self.n, len(queries)), kind)
        answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        open_, above = np.arange(len(queries)), np.full(len(queries), np.inf)
        for left in self._cuts(impact):
            self._read(gathered, impact[open_], above[open_], left[open_], unit)
            met = gathered // unit
            begun = highest[open_] > left[open_, None]
            rest = np.where(begun, 0, highest[open_]).sum(axis=1) + floor[open_]
            ahead = np.maximum(left[open_], 0.0)
            bounds = (gathered & (unit - 1)) + (begun.sum(axis=1) - met) * ahead + rest
            for bound, i in zip(np.ascontiguousarray(bounds.T), open_.tolist(), strict=True):
                bound[self.ids == query_ids[i]] = -np.inf
                seeds = np.argpartition(-bound, 2 * k)[: 2 * k]
                proof = np.partition(self.scored(seeds, queries[i]), -k)[-k]
                possible = np.flatnonzero(bound >= proof)
                if len(possible) <= max(8 * k, self.n // 32) or left[i] < 0:
                    answers[i] = self._chosen(possible, int(query_ids[i]), queries[i], k)
            kept = np.array([i not in answers for i in open_.tolist()], bool)
            open_, gathered, above = open_[kept], gathered[:, kept], left
            if not len(open_):
                break
        return [answers[i] for i in range(len(queries))]

    def _cuts(self, impact: np.ndarray) -> list[np.ndarray]:
        """For each share the impact down to which a query has read then; equal impacts are read together."""
        flat = impact.reshape(len(impact), -1)
        order = np.argsort(-flat, axis=1, kind="stable")
        read = np.cumsum(self.sizes.ravel()[order], axis=1)
        cuts = []
        for share in SHARES[:-1]:
            at = np.argmax(read >= share * read[:, -1:], axis=1)
            cuts.append(np.take_along_axis(flat, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0].astype(float))
        return [*cuts, np.full(len(impact), -1.0)]

    def _read(self, gathered: np.ndarray, impact: np.ndarray, above: np.ndarray, left: np.ndarray, unit: int) -> None:
        """Adds the segments whose impact lies in a query's band, one segment for all queries at a time."""
        now = (impact <= above[:, None, None]) & (impact > left[:, None, None]) & (self.sizes > 0)
        weights = np.where(now, impact + unit, 0).astype(gathered.dtype)
        for d, level in zip(*np.nonzero(now.any(axis=0)), strict=True):
            rows = self.postings[d][self.begins[d, level] : self.begins[d, level + 1]]
            gathered[rows] += weights[:, d, level]

    def _chosen(self, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != query_id]
        scores = self.scored(rows, query)
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; a sum that 64 bits may not hold is refused."""
    if not len(x):
        return np.zeros(0, np.int64)
    most = float(np.abs(x.astype(float)).max()) * float(np.abs(query.astype(float)).max()) * x.shape[1]
    if most < 2**24:
        return (x.astype(np.float32) @ query.astype(np.float32)).astype(np.int64)
    if most >= 2**62:
        raise OverflowError("inner products may exceed 64 bits")
    return x @ query


def _best(k: int):
    def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        found = Index(ids, vectors).best(query_ids, queries, k)
        repeated = np.repeat(query_ids, [len(r) for r, _ in found])
        return repeated, ids[np.concatenate([r for r, _ in found])], np.concatenate([s for _, s in found])

    return best


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Per query its ``k`` highest inner products: ``query_id, rank, vec_id, score long``.

    A component x counts as floor(scale * x). Queries are the rows that ``is_query`` holds for, candidates all rows but
    those of the query's own id. Ties go to the smaller id; fewer candidates than ``k`` are all returned. Rows without
    an id, with an empty or null vector, or with null or non-finite components take no part. An inner product needs equal
    lengths, so a query meets the vectors of its own length. Rows that repeat an id are, for each length, one vector, the
    smallest. No queries or an empty table give no rows; other columns are ignored. Products beyond what 64-bit sums hold
    are refused.
    """
    rows = usable(vectors, key, column)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    asked = rows.where(F.coalesce(is_query, F.lit(False)))
    n, m = rows.agg(F.count(F.lit(1)), F.sum(F.coalesce(is_query, F.lit(False)).cast("int"))).first()
    blocks, groups = max(1, math.ceil(n / BLOCK)), max(1, math.ceil((m or 0) / QUERIES))
    rows, asked = (df.withColumn("w", F.size("v")) for df in (rows, asked))
    cells = rows.select("vec_id", "v", "w", block_of("vec_id", blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    dealt = asked.select(
        F.col("vec_id").alias("query_id"), "v", "w", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), block_of("vec_id", groups, 2).cast("int").alias("g")
    )
    found = search_cells(cells.withColumn("b", F.col("b").cast("int")), dealt, ["w", "b", "g"], _best(k), "long")
    return ranked(found, k)

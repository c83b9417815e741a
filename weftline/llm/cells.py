"""A query set against all vectors in cells: one block of vectors and one block of queries to a task's call.

Blocks have a bounded number of rows, so a cell's memory does not depend on the tables. A row's block follows
from the hash of its id, so rows that repeat an id meet in one cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score {}"


def usable(df: DataFrame, key: str, column: str) -> DataFrame:
    """``vec_id, v array<double>`` of rows with an id and a vector of finite numbers; empty ones take no part."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)


def block_of(key: str, count: Column | int, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.greatest(F.lit(1), count if isinstance(count, Column) else F.lit(count)))


def matrix(table: pa.Table, id_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and their vectors, all of one length; of rows that repeat an id the smallest vector counts."""
    ids = table.column(id_column).to_numpy()
    values = table.column("v").combine_chunks()
    flat = (pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy()
    x = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.append(True, ids[1:] != ids[:-1])
        ids, x = ids[first], x[first]
    return ids, x


def search_cells(vectors: DataFrame, queries: DataFrame, cell: list[str], best: Callable, kind: str) -> DataFrame:
    """``query_id, vec_id, score`` of every cell: ``best(query ids, queries, ids, vectors)`` gives three arrays."""

    def one(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" and kind == "double" else pa.int64()) for n in names})
        found = best(*matrix(right, "query_id"), *matrix(left, "vec_id"))
        return pa.table({n: pa.array(c) for n, c in zip(names, found, strict=True)})

    return vectors.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(one, RESULT.format(kind))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all cells: highest score, then smallest id. Few rows of a query come from a cell."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return placed.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

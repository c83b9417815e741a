"""Nearest vectors by cosine distance, exact.

Distances are matrix products over Arrow batches inside the tasks. Each task keeps its k best
rows per query, so what is shuffled or merged is k rows per task, never the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.operators.paging import page
from weftline.operators.windows import number_rows
from weftline.session import settle

# Tasks get these functions by value: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METRICS = ("cosine",)

# Query vectors handled at once; a block is read by the driver and shipped to the tasks.
BLOCK_VALUES = 4_000_000
# Distances a task holds at once.
TILE_VALUES = 4_000_000


def _check(df: DataFrame, field: str, k: int, metric: str, max_rows: int | None) -> None:
    if metric not in METRICS:
        raise Refused(f"unknown distance {metric!r}")
    if field not in df.columns or not isinstance(df.schema[field].dataType, T.ArrayType):
        raise Refused(f"field {field!r} holds no vectors")
    if k <= 0:
        raise Refused("take must be positive")
    if max_rows is not None and k > max_rows:
        raise Refused(f"take {k} is above the store's limit of {max_rows} rows")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity in doubles; NULL for a zero or missing vector."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(
    df: DataFrame,
    field: str,
    query: Column | Sequence[float],
    k: int,
    key: str,
    metric: str = "cosine",
    where: Column | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """The ``k`` rows nearest one query vector with their ``distance``; the filter comes first.

    The query may be a scalar subquery, so a stored vector need not pass the driver.
    """
    _check(df, field, k, metric, max_rows)
    rows = df if where is None else df.where(where)
    target = query if isinstance(query, Column) else F.array(*[F.lit(float(v)) for v in query])
    scored = rows.withColumn("__query", target).withColumn(
        "distance", cosine_distance(F.col(field), F.col("__query"))
    )
    near = scored.drop("__query").where(F.col("distance").isNotNull())
    return page(near, 0, k, ["distance"], [key])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best(found: Found, k: int) -> Found:
    """The k smallest distances, ties by id, rows without an id first."""
    named, ids, distances = found
    if len(ids) > k:
        bound = np.partition(distances, k - 1)[k - 1]
        near = np.flatnonzero(distances <= bound)
    else:
        near = np.arange(len(ids))
    keep = near[np.lexsort((ids[near], named[near], distances[near]))][:k]
    return named[keep], ids[keep], distances[keep]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which ids there are, and the ids themselves; long integers keep their digits beside missing ones."""
    whole = pa.types.is_integer(column.type)
    values = column.fill_null(0 if whole else "").to_numpy(zero_copy_only=False)
    return column.is_valid().to_numpy(zero_copy_only=False), values if whole else values.astype(str)


def _task(query_ids: list, units: np.ndarray, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = schema.field("id").type
        nothing = (np.empty(0, bool), np.empty(0, np.int64 if kind == pa.int64() else "U1"), np.empty(0))
        best: list[Found] = [nothing] * len(query_ids)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            named, ids = _ids(batch.column(0))
            rows = _unit(_matrix(batch.column(1))).T
            step = max(1, TILE_VALUES // batch.num_rows)
            for first in range(0, len(query_ids), step):
                tile = 1.0 - units[first : first + step] @ rows
                for q, distances in enumerate(tile, first):
                    bound = best[q][2][-1] if len(best[q][2]) == k else np.inf
                    near = np.flatnonzero(distances <= bound)  # a NaN is never near
                    if len(near):
                        more = (named[near], ids[near], distances[near])
                        best[q] = _best(tuple(map(np.concatenate, zip(best[q], more, strict=True))), k)
        for q, (named, ids, distances) in zip(query_ids, best, strict=True):
            columns = [pa.array([q] * len(ids), schema.field("q").type), pa.array(ids, kind, mask=~named), pa.array(distances, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def nearest_batch(
    df: DataFrame,
    field: str,
    key: str,
    queries: DataFrame,
    query_field: str,
    query_key: str,
    k: int,
    metric: str = "cosine",
    max_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest rows for each of many query vectors: query, key, distance, place.

    Queries are cut into blocks of a fixed number of values, whatever their number; each block passes over the table
    once, and its answers are written before the next is read, so the driver holds one block. As in ``nearest`` a
    query meets the vectors of its own length only. Integer keys compare as numbers, all others as text. A row
    without a key is found like any other, as in ``nearest`` before all keys at the same distance; a query without one
    takes no part, as nothing could name its answers.
    """
    _check(df, field, k, metric, max_rows)
    vectors = df.select(_key(df, key).alias("id"), F.col(field).alias("v")).where(F.col(field).isNotNull())
    asked = queries.select(_key(queries, query_key).alias("q"), F.col(query_field).alias("v")).dropna()
    widths = [r["w"] for r in asked.groupBy(F.size("v").alias("w")).count().orderBy("w").collect() if r["w"] > 0]
    if not widths:
        raise Refused("there is no query vector")
    types = {f.name: pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in (asked.schema["q"], vectors.schema["id"])}
    schema = pa.schema([("q", types["q"]), ("id", types["id"]), ("distance", pa.float64())])
    answer = f"q {asked.schema['q'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"
    found = None
    for width in widths:
        block = max(1, BLOCK_VALUES // width)
        placed = settle(number_rows(asked.where(F.size("v") == width), ["q"], "n"), "queries")
        fitting = vectors.where(F.size("v") == width)
        for first in range(0, placed.agg(F.max("n")).first()[0], block):
            rows = placed.where((F.col("n") > first) & (F.col("n") <= first + block)).select("q", "v").toArrow()
            units = _unit(_matrix(rows.column("v").combine_chunks()))
            task = _task(rows.column("q").to_pylist(), units, k, schema)
            # k rows per task and query are left; the rank limit is applied again before the shuffle.
            part = settle(_first(fitting.mapInArrow(task, answer), k), "nearest")
            found = part if found is None else found.unionByName(part)
    kinds = {"query_id": queries.schema[query_key].dataType, key: df.schema[key].dataType}
    named = found.select(F.col("q").cast(kinds["query_id"]).alias("query_id"), F.col("id").cast(kinds[key]).alias(key), "distance", "place")
    return named


def _key(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("long" if isinstance(df.schema[name].dataType, T.IntegralType) else "string")


def _first(found: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(by_query).cast("long")).where(F.col("place") <= k)

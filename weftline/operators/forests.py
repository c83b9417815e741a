"""Edges contracted inside tasks: a spanning star for each component of a bounded number of edges."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tasks get these functions by value: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges a task contracts at once; it holds no more.
CHUNK = 1_000_000
#: Node types that Arrow orders as Spark does.
KINDS = (T.IntegralType, T.StringType, T.DateType)


def labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component; nodes are 0 to n - 1.

    Every tree hangs its root under the least root that an edge leads to, then paths are halved until trees are flat: a
    logarithm of rounds, also for chains.
    """
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above


def _contracted(a: pa.Array, b: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    both = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    code = rank[np.asarray(both.indices)]
    root = labels(code[: len(a)], code[len(a) :], len(order))
    nodes = pc.take(both.dictionary, order)
    hung = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(hung)), nodes.take(pa.array(root[hung]))], schema=schema)


def _forest(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def contract() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return _contracted(*(pa.concat_arrays(c.chunks) for c in table.columns), table.schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                # What is left of the edges is kept for the next ones, if they are fewer by half.
                left = contract()
                held, rows = ([left], left.num_rows) if 2 * left.num_rows < chunk else ([], 0)
                if not held:
                    yield left
        if held:
            yield contract()

    return run


def contract(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs ``(a, b)``, ``a`` the larger, that connect what the given ones connect: in each task a star around the
    smallest node of each component, of ``chunk`` edges at a time. Pairs hold no NULL."""
    kind = pairs.schema["a"].dataType
    if not isinstance(kind, KINDS) or pairs.schema["b"].dataType != kind:
        return pairs
    return pairs.mapInArrow(_forest(chunk), f"a {kind.simpleString()}, b {kind.simpleString()}")

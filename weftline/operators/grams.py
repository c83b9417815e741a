"""Trigrams of texts, gathered in tasks: for a bounded piece of the texts, the keys of the rows that hold each trigram."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Tasks get these functions by value: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that a task looks at at once, but for a longer row; keys in one list.
PIECE, LISTED = 2_000_000, 128


def _postings(texts: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The characters of some columns of texts; trigrams, as numbers in that alphabet, and the rows that hold them, in order and
    each once. None if such numbers are too large. No trigram spans two texts."""
    said = [["" if t is None else t for t in column.to_pylist()] for column in texts]
    codes = [np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in said]
    used = np.zeros(sys.maxunicode + 1, bool)
    for c in codes:
        used[c] = True
    alphabet = np.flatnonzero(used)
    size, count = max(len(alphabet), 1), len(said[0])
    if size**3 * count >= 2**63:
        return None
    place = np.cumsum(used, dtype=np.int64) - 1
    found = []
    for column, c in zip(said, codes, strict=True):
        row = np.repeat(np.arange(count), [len(t) for t in column])
        whole = np.flatnonzero(row[:-2] == row[2:])
        at = place[c]
        gram = (at[:-2] * size + at[1:-1]) * size + at[2:]
        found.append(gram[whole] * count + row[whole])
    # One sort of plain numbers, by trigram and row.
    both = np.sort(np.concatenate(found))
    gram, row = np.divmod(both[np.diff(both, prepend=-1) != 0], count)
    return alphabet, gram, row


def _spelled(alphabet: np.ndarray, grams: np.ndarray) -> pa.Array:
    size = len(alphabet)
    codes = alphabet[np.stack([grams // size**2, grams // size % size, grams % size], axis=1)].astype(np.uint32)
    text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def _listed(keys: pa.Array, texts: Sequence[pa.Array]) -> Iterator[pa.RecordBatch]:
    found = _postings(texts)
    if found is None:
        half = len(keys) // 2
        for part in (slice(0, half), slice(half, len(keys))):
            yield from _listed(keys[part], [t[part] for t in texts])
        return
    alphabet, gram, row = found
    if not len(row):
        return
    begins = np.flatnonzero(np.diff(gram, prepend=-1))
    lengths = np.diff(begins, append=len(gram))
    cuts = np.flatnonzero((np.arange(len(gram)) - np.repeat(begins, lengths)) % LISTED == 0)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(gram)), pa.int32()), keys.take(pa.array(row)))
    spelled = _spelled(alphabet, gram[begins])
    yield pa.RecordBatch.from_arrays([spelled.take(pa.array(np.searchsorted(begins, cuts, "right") - 1)), lists], names=["gram", "keys"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, *texts = batch.columns
        size = sum(np.asarray(pc.fill_null(pc.utf8_length(t), 0)).astype(np.int64) for t in texts)
        piece = (np.cumsum(size) - size) // PIECE
        starts = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), batch.num_rows]
        for at, end in zip(starts, starts[1:], strict=False):
            yield from _listed(keys.slice(at, end - at), [t.slice(at, end - at) for t in texts])


def key_lists(rows: DataFrame) -> DataFrame:
    """``gram, keys`` for rows of a key and texts: every distinct trigram of a row's texts has the row's key in one of its
    lists, once for each row. A list holds LISTED keys at most."""
    kind = rows.schema[0].dataType
    return rows.mapInArrow(_lists, T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(kind))]))

"""Stretches of a text that repeat themselves word for word, found by grammar compression.

Each text is compressed by Re-Pair over its word ids; runs are looked for across the boundary of every rule once,
carried to all places where the rule is derived, and merged. A text needs nothing but itself, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import grammar
from weftline.llm.common import blocks, slim
from weftline.llm.packing import WORD

#: Bytes of text that are compressed side by side; a longer text is compressed alone.
TOGETHER = 2 << 20
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids that no two texts share, and where each text begins."""
    ids: list[int] = []
    starts = np.zeros(len(texts), np.int64)
    base = 0
    for i, words in enumerate(texts):
        starts[i] = len(ids)
        known = dict.fromkeys(words)
        known.update(zip(known, range(base, base + len(known)), strict=True))
        base += len(known)
        ids.extend(map(known.__getitem__, words))
    return np.array(ids, np.int64), starts


def _collapsed(words: list[bytes], begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(begin):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, end, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def _finder(exponent: int, shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", TOGETHER):
            texts = [text.split() for text in part.column("text").to_pylist()]
            ids, starts = _numbered(texts)
            full = np.array([i for i, words in enumerate(texts) if words], np.int64)
            begin, end, period = grammar.runs(ids, starts[full], exponent, shortest)
            ends = np.searchsorted(begin, np.append(starts, len(ids)))
            ends[-1] = len(begin)
            own = np.repeat(starts, np.diff(ends))
            collapsed = [
                _collapsed(words, begin[x:y] - s, end[x:y] - s, period[x:y])
                for words, s, x, y in zip(texts, starts.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            ]
            spans = pa.StructArray.from_arrays(
                [pa.array(begin - own), pa.array(end - begin), pa.array(period)], ["start", "length", "period"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), lists, pa.array(collapsed, pa.binary())], ["doc_id", "runs", "collapsed"]
            )

    return find


def find_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, runs, collapsed``.

    Words lie between ASCII white space and are numbered from 0. A run is a stretch of at least ``exponent`` periods (4 or
    more) and ``shortest`` words that no neighbouring word extends; ``period`` is its smallest. ``runs`` holds all runs
    by start, then period; runs may overlap. ``collapsed`` holds the words that no run holds behind its first period,
    joined by one space. A null, empty or blank text has no runs and an empty ``collapsed``. Repeated rows each
    get their row; a null id stays null; an empty table gives no rows; other columns are ignored. A text is compressed
    whole by one task, in some 150 bytes of memory a word.
    """
    if exponent < 4 or shortest < 1:
        raise ValueError("a run has at least four periods and one word")
    rows = slim(docs, key, text).select("doc_id", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_finder(exponent, shortest), SCHEMA)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` where one document in ten, by its id's checksum, repeats some of its words to its end.

    With g the checksum's other digits and n the number of words, the words from a = g % n on become the p words there
    over and over, p = 1 + (n - a) div (3 + g % 8). All others, and texts without a word, keep their text.
    """
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(check % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))
    rows = slim(docs, key, text).withColumn("words", chosen)
    n, g = F.size("words").cast("long"), F.floor(check / 10).cast("long")
    plan = rows.withColumn("n", F.coalesce(F.when(n > 0, n), F.lit(0).cast("long"))).withColumn("g", g)
    plan = plan.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    plan = plan.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long"))
    return plan.select("doc_id", F.when(F.col("n") > 0, _repeating()).otherwise(F.col("text")).alias("text"))


def _repeating() -> Column:
    rest = F.col("n") - F.col("a")
    block = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    whole = F.flatten(F.array_repeat(block, F.floor(rest / F.col("p")).cast("int")))
    tail = F.slice("words", (F.col("a") + 1).cast("int"), (rest % F.col("p")).cast("int"))
    return F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), whole, tail), " ")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, number of runs, the greatest run and digests, from the rows of :func:`find_runs`."""
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"], r["period"], r["length"]))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").cast("long").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

"""Length buckets with the least padding that their number allows, and batches under a token budget.

Boundaries come from dynamic programming over the histogram of all lengths. Inside a bucket every sequence is padded
to the boundary, so a batch holds as many sequences as boundaries fit into the budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Parts that a bucket's rows are numbered in; a fixed number, so the numbering does not depend on the cluster.
PARTS = 4096


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets that minimise the padding of all sequences.

    ``lengths`` are distinct, positive and ascending. Fewer distinct lengths than buckets need no padding at all.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # Padding within [i, j) is lengths[j - 1] * rows - tokens; tokens are a constant, so padded sizes are compared.
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    cut = np.zeros((buckets, n + 1), np.int64)
    for k in range(buckets):
        now = best.copy() if k else np.full_like(best, np.iinfo(np.int64).max // 4)
        cut[k] = -1
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (below[j] - below[:j])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], cut[k, j] = cost[i], i
        best = now
    ends, j, k = [], n, buckets - 1
    while j > 0:
        while cut[k, j] < 0:
            k -= 1
        ends.append(int(lengths[j - 1]))
        j, k = int(cut[k, j]), k - 1
    return ends[::-1]


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space, counted inside the engine; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def pack(
    docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65536, longest: int = 2048, key: str = "doc_id"
) -> DataFrame:
    """Per sequence ``doc_id, segment, begin, length, bucket, batch, place, padding``.

    ``length`` counts a document's tokens. A document over ``longest`` tokens is cut into sequences of that length and
    a rest, so nothing is dropped: ``begin`` is a sequence's first token. ``bucket`` is the length it is padded
    to, ``batch`` its batch in the bucket (from 0), ``place`` its place there (from 0). Every batch but a bucket's last
    is as full as the budget allows, which must hold one longest sequence. A document without tokens gets one row
    with length 0, bucket 0 and no batch. Repeated rows are packed each; a null id is packed like any other; an empty
    table gives no rows; other columns are ignored. Equal lengths fall into one bucket; ties are placed by id.
    """
    if buckets < 1 or longest < 1 or budget < longest:
        raise ValueError("there must be a bucket, and the budget must hold one longest sequence")
    cut = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("whole"))
    last = F.floor((F.greatest("whole", F.lit(1)) - 1) / longest)
    cut = cut.select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    begin = F.col("segment") * longest
    rows = settle(
        cut.select("doc_id", "segment", begin.alias("begin"), F.least(F.col("whole") - begin, F.lit(longest)).alias("length")),
        "packing",
    )
    # At most ``longest`` lengths come to the driver, whatever the corpus.
    seen = sorted((r["length"], r["n"]) for r in rows.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = boundaries(np.array([s[0] for s in seen], np.int64), np.array([s[1] for s in seen], np.int64), buckets)
    bucket = F.lit(0)
    for end in reversed(ends):
        bucket = F.when(F.col("length") <= end, F.lit(end)).otherwise(bucket)
    bucket = F.when(F.col("length") > 0, bucket).otherwise(0).cast("long")
    part = F.pmod(F.xxhash64("doc_id", "segment", "length"), F.lit(PARTS))
    dealt = rows.withColumns({"bucket": bucket, "part": part})
    # A bucket may hold most of all rows: rows are numbered within parts, and parts begin where the ones before end.
    within = Window.partitionBy("bucket", "part").orderBy("doc_id", "segment", "length", "begin")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # At most PARTS rows for each bucket.
    numbered = dealt.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["bucket", "part"])
    at = F.col("offset") + F.col("at")
    fits = F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))).cast("long")
    batched = F.col("bucket") > 0
    return numbered.select(
        "doc_id",
        "segment",
        "begin",
        "length",
        "bucket",
        F.when(batched, F.floor(at / fits)).cast("long").alias("batch"),
        F.when(batched, F.pmod(at, fits)).cast("long").alias("place"),
        (F.col("bucket") - F.col("length")).alias("padding"),
    )

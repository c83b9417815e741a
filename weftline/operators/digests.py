"""Two versions of a table compared by digests of parts of their keys, so that what is alike never moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that keys are dealt into; each task hands over one digest for each part at most.
PARTS = 65_536
# Two digests of a row start from different values, so that rows alike in one differ in the other.
_STARTS = (11, 7919)
_HALF = 0xFFFFFFFF


def differing(versions: DataFrame, side: str, key: Sequence[str], values: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """Rows of two stacked versions whose part of the keys is not the same in both; ``side`` is -1 before and 1 after.

    A part's digest is its number of rows and sums over the halves of two 64-bit hashes of each row's ``key`` and
    ``values``, those of one side taken from those of the other. Sums do not depend on the order of rows and count
    repeated ones. They are combined inside the tasks, so what is shuffled is digests. The parts that differ, ``PARTS``
    numbers at most, are broadcast; rows of all others stop before any shuffle. Rows that differ pass as equal only where
    both hashes, 128 bits, meet by chance. The versions are read twice, the first time without their other columns.
    """
    columns = [*key, *values]
    sign = F.col(side).cast("long")
    # A hash passes over NULL, so its place is told beside it.
    absent = [F.isnull(F.col(c)) for c in columns]
    hashes = [F.xxhash64(F.lit(start), *[F.col(c) for c in columns], *absent) for start in _STARTS]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(x, 32))]
    sums = [F.sum(sign * h).alias(f"__h{i}") for i, h in enumerate(halves)]
    digests = versions.groupBy(_part(key, parts).alias("__part")).agg(F.sum(sign).alias("__n"), *sums)
    unlike = digests.where(" OR ".join(f"{c} <> 0" for c in digests.columns[1:])).select("__part")
    return versions.withColumn("__of", _part(key, parts)).join(
        F.broadcast(unlike), F.col("__of") == F.col("__part"), "left_semi"
    ).drop("__of")


def _part(key: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts))

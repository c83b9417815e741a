"""Joins to a side that was just aggregated by the join key.

Such a side already lies partitioned by the key, so Spark joins it without a shuffle of its
own, and adaptive execution, which splits a skewed partition only where both sides were
shuffled for the join, leaves the rows of a hot key in one task. A second join column that is
always 0, but not to the optimizer, makes the aggregated side shuffle once more. It is the
smaller side, one row per key, and the large side becomes splittable. Small sides are
broadcast as ever.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _always_zero(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1))


def lookup(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join ``left`` to a side with one row per key; ``pairs`` names columns of left and right.

    The sides share no column name. The right key columns stay out of the result.
    """
    mine = left.withColumn("__zero_l", _always_zero([a for a, _ in pairs]))
    other = right.withColumn("__zero_r", _always_zero([b for _, b in pairs]))

    def same(a: str, b: str) -> Column:
        return mine[a].eqNullSafe(other[b]) if null_safe else mine[a] == other[b]

    condition = reduce(operator.and_, [same(a, b) for a, b in pairs]) & (mine["__zero_l"] == other["__zero_r"])
    return mine.join(other, condition, how).drop("__zero_l", "__zero_r", *[b for _, b in pairs])

"""Positions and chunks, so that no ordered group has to fit one task.

A window partitioned by a hot key would put that key's rows into a single task. Rows of keys above ``MOST`` rows are
dealt by range over the key and all order columns at once, so ties in the first columns are cut by the next. The
rows of a key in one range are counted, and the counts before it place them: each row gets its exact number in
the key's order. Chunks are runs of ``MOST`` such numbers. They depend on the data alone, never on the cluster.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import settle, settle_measured
from weftline.specs import Ordering

POSITION = "__pos"
CHUNK = "__chunk"

# Rows of one window in one task.
MOST = 1_000_000


def _filler(kind: T.DataType) -> Column | None:
    """A value of the type that stands in for NULL; None for types compared as text."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return None


def key_parts(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns without NULL that are equal exactly when the keys are, NULL equal to NULL.

    Windows and joins on the same such columns share one shuffle and one sort; null-safe
    equality would be rewritten to other expressions and shuffle the table again.
    """
    parts: dict[str, Column] = {}
    for i, name in enumerate(keys):
        filler = _filler(df.schema[name].dataType)
        value = F.col(name) if filler is not None else F.col(name).cast("string")
        parts[f"__k{i}"] = F.coalesce(value, F.lit("") if filler is None else filler)
        parts[f"__n{i}"] = F.col(name).isNull()
    return parts


def same_key(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(operator.and_, [df[k].eqNullSafe(hot[f"__h_{k}"]) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Keys with more rows than one window may hold."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.where(F.col("__n") > (MOST if most is None else most)).select(*[F.col(k).alias(f"__h_{k}") for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], most: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys; None where there are none.

    One count over the key columns alone decides, when the plan is made. Without a key all rows are one group.
    """
    if not keys:
        size = df.select(F.lit(1)).limit((MOST if most is None else most) + 1).count()
        return (df, None) if size <= (MOST if most is None else most) else (None, df)
    hot, seen = settle_measured(hot_keys(df, keys, most), "hot-keys", n=F.count(F.lit(1)))
    if not seen["n"]:
        return df, None
    same = same_key(df, hot, keys)
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Ordering]) -> DataFrame:
    """Add ``__pos``, each row's number from 1 in its key's order, and the key in the form of ``key_parts``.

    ``order`` must be total: rows that tie are numbered in any order. The rows are written once to the shared folder,
    with the range each one fell into, so that counting and numbering see the same ranges.
    """
    owner = key_parts(df, keys)
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [o.column() for o in order]
    dealt = df.withColumns(owner) if owner else df
    dealt = settle(dealt.repartitionByRange(count, *owner, *sort).withColumn("__range", F.spark_partition_id()), "ranges")
    groups = [*owner, "__range"]
    sizes = dealt.groupBy(*groups).agg(F.count(F.lit(1)).alias("__size"))
    # One row for each key and range.
    before = Window.partitionBy(*owner).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"__r{g}") for g in groups], F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy(*groups).orderBy(*sort)
    numbered = dealt.withColumn("__row", F.row_number().over(within))
    same = reduce(operator.and_, [numbered[g] == offsets[f"__r{g}"] for g in groups])
    placed = numbered.join(offsets, same).withColumn(POSITION, (F.col("__row") + F.col("__before")).cast("long"))
    return placed.drop("__row", "__before", "__range", *[f"__r{g}" for g in groups])


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Ordering], most: int | None = None) -> DataFrame:
    """``positions`` with ``__chunk``, the run of ``MOST`` numbers that a row's position lies in."""
    placed = positions(df, keys, order)
    return placed.withColumn(CHUNK, F.floor((F.col(POSITION) - 1) / (MOST if most is None else most)))

"""Differences, distinct names and first-per-id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.digests import differing


def schema_diff(stored: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """Names ``added`` to and ``removed`` from the stored set, compared without case.

    Names in parts that agree by their digests stay where they are; the others meet in one aggregate, where each name
    carries on which sides it was seen.
    """
    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.lower(name).alias("name"), F.lit(side).alias("__side"))

    stacked = tagged(stored, -1).unionByName(tagged(current, 1))
    sides = differing(stacked, "__side", ["name"]).groupBy("name").agg(F.min("__side").alias("low"), F.max("__side").alias("high"))
    change = F.when(F.col("low") < 0, "removed").otherwise("added")
    return sides.where(F.col("low") == F.col("high")).select("name", change.alias("change"))


def has_changes(diff: DataFrame) -> Column:
    return diff.agg(F.count(F.lit(1)) > 0).scalar()


def schema_of(df: DataFrame, label: str = "name") -> DataFrame:
    """A frame's field names and types as rows, to compare schemas."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, f"{label} string, type string")


def distinct_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per id in ``order``: a minimum of structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    row = F.struct(*order, *rest)
    first = df.groupBy(*key).agg(F.min(row).alias("__row"))
    return first.select(
        *key, *[F.col(f"__row.{c}").alias(c) for c in (*order, *rest)]
    ).select(*df.columns)


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    """Distinct without case."""
    return df.select(F.lower(name).alias("name")).distinct()


def shared_names(df: DataFrame, name: str) -> DataFrame:
    """Names that more than one row uses, compared without case."""
    return (
        df.groupBy(F.lower(name).alias("name"))
        .agg(F.count(F.lit(1)).alias("uses"))
        .where(F.col("uses") > 1)
    )

"""Stored statements with named parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.paging import row_ceiling


def script_read(
    spark: SparkSession, text: str, params: Mapping[str, object], inputs: Mapping[str, DataFrame], take: int | None = None
) -> DataFrame:
    """Run a statement over named inputs. Values travel as parameters, never as text.

    A statement that selects more than ``take`` rows fails. It runs once: its rows are written and counted.
    """
    result = spark.sql(text, args=dict(params), **inputs)
    return result if take is None else row_ceiling(result, take)

"""What a fixed interval says about entities and their last run. Every moment is passed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _interval(seconds: str) -> Column:
    """The interval in whole seconds; NULL unless it is a positive number."""
    value = F.col(seconds).cast("string").try_cast("long")
    return F.when(value > 0, value)


def _plus(at: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), at)


def missed_slots(df: DataFrame, last_run: str, seconds: str, now: object) -> DataFrame:
    """Slots after the last run and not after ``now``: how many, first and latest.

    A slot exactly now is missed. The slots of a fixed interval follow by arithmetic, so a
    long outage costs no more than a short one.
    """
    step, last = _interval(seconds), F.col(last_run)
    elapsed = F.timestamp_diff("SECOND", last, F.lit(now))
    count = F.when(elapsed >= step, F.floor(elapsed / step)).otherwise(0)
    missed = F.coalesce(F.when(last.isNull(), F.lit(0)).otherwise(count), F.lit(0)).cast("long")
    return df.withColumn("missed", missed).withColumns(
        {
            "first_missed": F.when(F.col("missed") > 0, _plus(last, step)),
            "latest_missed": F.when(F.col("missed") > 0, _plus(last, step * F.col("missed"))),
        }
    )


def interval_due(df: DataFrame, last_run: str, seconds: str, now: object) -> DataFrame:
    """``due`` when never run or the interval has elapsed; ``next_run`` is one interval after the last.

    An interval that is no positive number is never due and has no next run.
    """
    step, last = _interval(seconds), F.col(last_run)
    elapsed = F.timestamp_diff("SECOND", last, F.lit(now))
    due = F.when(step.isNull(), False).when(last.isNull(), True).otherwise(elapsed >= step)
    return df.withColumns({"due": due, "next_run": F.when(step.isNotNull(), _plus(last, step))})

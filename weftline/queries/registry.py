"""Registration of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key. Without SQL its result is tested on a fixture."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def moment(text: str) -> Column:
    """A timestamp without zone, as the tables hold them."""
    return F.lit(text).cast("timestamp_ntz")


def money(name: str) -> Column:
    """Amounts hold two decimals; exact sums do not depend on the order of the rows."""
    return F.col(name).cast("decimal(18,2)")


def text_list(name: str) -> Column:
    return F.array_join(name, ",")

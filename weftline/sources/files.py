"""Readers of record files. Every reader takes the declared schema; none infers one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored under a path or pattern, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A columnar table; projection and filters reach the scan."""
    return spark.read.parquet(path)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A database table or view over JDBC, read by ranges of a column when one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        if lower is None or upper is None or partitions < 1:
            raise Refused("a partitioned read needs both bounds and a number of partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
        )
    return reader.load()


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, separator: str = ",", quote: str = '"'
) -> DataFrame:
    """Delimited text. Quoted separators and doubled quotes come back as written.

    A value holds no line break here, so that one large file is split into many tasks.
    """
    return _delimited(spark, schema, header, separator, quote, False).csv(path)


def read_delimited_multiline(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, separator: str = ",", quote: str = '"'
) -> DataFrame:
    """Delimited text whose quoted values hold line breaks; one task per file."""
    return _delimited(spark, schema, header, separator, quote, True).csv(path)


# What an unquoted empty cell stands for while it is parsed; a quoted one is an empty text.
ABSENT = "\u0000"


def _delimited(spark: SparkSession, schema: T.StructType, header: bool, separator: str, quote: str, multiline: bool):
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", separator)
        .option("quote", quote)
        .option("escape", quote)
        .option("multiLine", multiline)
        .option("nullValue", ABSENT)
        .option("enforceSchema", not header)
        .option("mode", "FAILFAST")
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON records; a field a record lacks reads NULL. ``multiline`` reads whole-file arrays."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def read_xml(spark: SparkSession, path: str, schema: T.StructType, row_element: str) -> DataFrame:
    """XML records by row element, cut to the declared schema."""
    return spark.read.format("xml").option("rowTag", row_element).option("mode", "FAILFAST").schema(schema).load(path)


@dataclass(frozen=True)
class FixedField:
    name: str
    start: int
    length: int
    data_type: str = "string"


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[FixedField]) -> DataFrame:
    """Fixed-width lines: start index from 0, values trimmed, then converted strictly."""
    lines = spark.read.text(path)
    return lines.select(*[_cut(f) for f in fields])


def _cut(spec: FixedField):
    text = F.trim(F.substring("value", spec.start + 1, spec.length))
    return text.alias(spec.name) if spec.data_type == "string" else text.cast(spec.data_type).alias(spec.name)


READERS = {"delimited": read_delimited, "json": read_json, "xml": read_xml}


def read_or_refuse(spark: SparkSession, path: str, read) -> DataFrame:
    """A read of a missing file is an error."""
    if not path_exists(spark, path):
        raise Refused(f"no file at {path}")
    return read()


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, read) -> DataFrame:
    """A read that precedes a write: a missing file is an empty table."""
    return read() if path_exists(spark, path) else spark.createDataFrame([], schema)


def declared(fields: Mapping[str, str]) -> T.StructType:
    """A schema from names and column type names."""
    from weftline.functions.columntypes import column_type

    return T.StructType([T.StructField(n, column_type(t)) for n, t in fields.items()])

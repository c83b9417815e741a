"""Declared column type names and the Spark types that hold their values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused

# Type names with their alternate spellings, as a declared schema writes them.
TYPES: dict[str, T.DataType] = {
    "bigint": T.LongType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "smallint": T.ShortType(),
    "short": T.ShortType(),
    "tinyint": T.ShortType(),
    "byte": T.ShortType(),
    "bit": T.BooleanType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "decimal": T.DecimalType(18, 0),
    "numeric": T.DecimalType(18, 0),
    "money": T.DecimalType(19, 4),
    "smallmoney": T.DecimalType(10, 4),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "real": T.FloatType(),
    "char": T.StringType(),
    "nchar": T.StringType(),
    "varchar": T.StringType(),
    "nvarchar": T.StringType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "ntext": T.StringType(),
    "xml": T.StringType(),
    "uniqueidentifier": T.StringType(),
    "guid": T.StringType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "datetime2": T.TimestampNTZType(),
    "smalldatetime": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(),
    "binary": T.BinaryType(),
    "varbinary": T.BinaryType(),
    "image": T.BinaryType(),
    "timestamp": T.BinaryType(),
    "variant": T.VariantType(),
    "vector": T.ArrayType(T.FloatType()),
}

_SIZED = re.compile(r"^(\w+)\s*\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\)$")


def column_type(name: str) -> T.DataType:
    """Look a type name up, trimmed and without case; an unknown name is an error."""
    text = name.strip().lower()
    sized = _SIZED.match(text)
    base = sized.group(1) if sized else text
    if base not in TYPES:
        raise Refused(f"unknown column type {name!r}")
    if sized and base in ("decimal", "numeric"):
        return T.DecimalType(int(sized.group(2)), int(sized.group(3) or 0))
    return TYPES[base]


def strict_cast(column: Column, target: T.DataType) -> Column:
    """Convert; a value that does not convert fails the job (ANSI cast), never defaults."""
    return column.cast(target)


def unconvertible(column: Column, target: T.DataType) -> Column:
    """True where ``strict_cast`` would fail, to count bad rows before a load."""
    return column.isNotNull() & column.try_cast(target).isNull()


def required(column: Column, name: str) -> Column:
    """A non-nullable field: NULL fails the job."""
    return F.when(
        column.isNull(), F.raise_error(F.lit(f"field {name} is not nullable"))
    ).otherwise(column)

"""Key equality: integers and GUIDs by value however spelled, all else as text without case, NULL never equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_columns(names: Sequence[str]) -> list[str]:
    """Names of the columns that hold the comparable form of a key."""
    return [f"__key{i}" for i in range(len(names))]


def align_keys(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add to both sides key columns that are equal under ``=`` exactly when the keys are."""
    aligned = []
    for side in (left, right):
        forms = {}
        for key, name in zip(key_columns(names), names, strict=True):
            both = [s.schema[name].dataType for s in (left, right)]
            whole = all(isinstance(kind, T.IntegralType) for kind in both)
            forms[key] = F.col(name).cast("long") if whole else comparable(F.col(name))
        aligned.append(side.withColumns(forms))
    return aligned[0], aligned[1]


# Fixed patterns: how a GUID and an integer may be spelled.
GUID = r"(?i)^([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|\([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\))$"
INTEGER = r"^[+-]?[0-9]+$"


def comparable(value: Column) -> Column:
    """One text for all spellings of a key: ``07`` and 7 agree, and so do a GUID in braces and the plain one."""
    text = value.cast("string")
    bare = F.trim(text)
    number = F.when(bare.rlike(INTEGER), bare.try_cast("long"))
    return (
        F.when(bare.rlike(GUID), F.concat(F.lit("g"), F.lower(F.translate(bare, "{}()-", ""))))
        .when(number.isNotNull(), F.concat(F.lit("i"), number.cast("string")))
        .otherwise(F.concat(F.lit("t"), F.lower(text)))
    )


def present_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct complete keys of an aligned frame. A hot key shrinks to one row a task before the shuffle."""
    return df.select(*key_columns(names)).dropna().distinct()

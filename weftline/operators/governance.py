"""Stand-in values, classified reads, retention and change audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators.digests import differing
from weftline.specs import resolve

# Classification levels from open to closed.
LEVELS = ("public", "internal", "confidential", "restricted")


@dataclass(frozen=True)
class StandIn:
    """``null``, ``constant``, ``hash`` (salted) or ``partial`` (last characters stay)."""

    strategy: str
    value: object = None
    salt: str = ""
    keep: int = 4

    def column(self, column: Column) -> Column:
        text = column.cast("string")
        if self.strategy == "null":
            return F.lit(None).cast("string")
        if self.strategy == "constant":
            return F.lit(self.value)
        if self.strategy == "hash":
            return F.sha2(F.concat(text, F.lit(self.salt)), 256)
        if self.strategy == "partial":
            hidden = F.greatest(F.length(text) - self.keep, F.lit(0))
            return F.concat(F.repeat(F.lit("*"), hidden), F.right(text, F.lit(self.keep)))
        raise Refused(f"unknown stand-in strategy {self.strategy!r}")


def stand_in(df: DataFrame, fields: Mapping[str, StandIn]) -> DataFrame:
    """Replace the values of fields; equal inputs give equal stand-ins, so joins still work."""
    return df.withColumns(
        {resolve(df.columns, n): s.column(F.col(resolve(df.columns, n))) for n, s in fields.items()}
    )


def classify(df: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """Attach a classification level to fields, as column metadata."""
    for level in levels.values():
        if level not in LEVELS:
            raise Refused(f"unknown classification level {level!r}")
    for name, level in levels.items():
        target = resolve(df.columns, name)
        df = df.withMetadata(target, {**df.schema[target].metadata, "level": level})
    return df


def classified_read(df: DataFrame, caller: str) -> DataFrame:
    """Only the fields at or below the caller's level; the others are not even scanned."""
    if caller not in LEVELS:
        raise Refused(f"unknown classification level {caller!r}")
    allowed = LEVELS.index(caller)
    names = [
        f.name for f in df.schema.fields if LEVELS.index(f.metadata.get("level", "public")) <= allowed
    ]
    if not names:
        raise Refused(f"no field is readable at level {caller!r}")
    return df.select(*names)


ARCHIVE = "archive"


def document_type(path: Column) -> Column:
    """The first folder of a path; a document at the root or below ``Archive`` has no type."""
    parts = F.split(path, "/")
    first = F.get(parts, F.lit(0))
    return F.when((F.size(parts) > 1) & (F.lower(first) != ARCHIVE), first)


def retention_select(listing: DataFrame, path: str, modified: str, cutoffs: Mapping[str, object], action: str) -> DataFrame:
    """Documents of a type that were last modified before its cutoff, with what to do with them."""
    if action not in ("delete", "archive"):
        raise Refused(f"unknown end action {action!r}")
    if not cutoffs:
        raise Refused("no document type has a cutoff")
    typed = listing.withColumn("document_type", document_type(F.col(path)))
    cutoff = F
    for name, moment in cutoffs.items():
        cutoff = cutoff.when(F.col("document_type") == name, F.lit(moment))
    return typed.where(F.col(modified) < cutoff).withColumn("action", F.lit(action))


def audit_changes(
    before: DataFrame,
    after: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    changed_by: Column | None = None,
    changed_at: Column | None = None,
    tenant: str | None = None,
    for_tenant: object | None = None,
) -> DataFrame:
    """Changed values between two versions of a table: key, field, old and new as text.

    ``changed_by`` and ``changed_at`` say who changed a row and when, from the columns of ``after``; they are NULL for
    rows that are gone. ``tenant`` names the column that scopes the listing; with ``for_tenant`` only that tenant's
    rows are read. The versions are stacked; parts of the keys whose digests agree stay where they are, the others meet by
    key in one aggregate, one row per key and version.
    """
    if for_tenant is not None:
        if tenant is None:
            raise Refused("a tenant's changes need the column that holds the tenant")
        before, after = (df.where(F.col(tenant) == F.lit(for_tenant)) for df in (before, after))
    said = {n: c for n, c in (("changed_by", changed_by), ("changed_at", changed_at)) if c is not None}
    scope = [tenant] if tenant is not None and tenant not in key else []

    def version(df: DataFrame, side: int) -> DataFrame:
        values = [F.col(c).cast("string").alias(f"__v{i}") for i, c in enumerate(columns)]
        told = [(c if side > 0 else F.lit(None)).alias(n) for n, c in said.items()]
        return df.select(*key, *scope, *values, F.lit(side).alias("__side"), *told)

    stacked = version(before, -1).unionByName(version(after, 1))
    held = [f"__v{i}" for i in range(len(columns))]
    moved = differing(stacked, "__side", [*key, *scope], held)
    row = F.struct(*[F.col(v).alias(c) for v, c in zip(held, columns, strict=True)])
    met = moved.groupBy(*key, *scope).agg(
        F.max(F.when(F.col("__side") < 0, row)).alias("old"),
        F.max(F.when(F.col("__side") > 0, row)).alias("new"),
        *[F.max(n).alias(n) for n in said],
    )
    entries = [
        F.struct(
            F.lit(c).alias("field"), F.col(f"old.{c}").alias("old_value"), F.col(f"new.{c}").alias("new_value")
        )
        for c in columns
    ]
    listed = met.select(*key, *scope, *said, F.inline(F.array(*entries)))
    return listed.where(~F.col("old_value").eqNullSafe(F.col("new_value")))

"""Text search over rows. Terms are literal text, never patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.operators.paging import page
from weftline.specs import resolve


def find_text(
    df: DataFrame,
    term: str,
    fields: Sequence[str] = (),
    case_sensitive: bool = False,
    max_results: int | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Rows that hold the term, each with ``matched``: the fields that do, in declared order.

    Searches the named fields, or every text field. ``max_results`` takes rows in key order.
    """
    if not term.strip():
        raise Refused("a search needs a term")
    if max_results is not None and max_results < 0:
        raise Refused("max_results cannot be negative")
    if fields:
        searched = [resolve(df.columns, f) for f in fields]
    else:
        searched = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not searched:
        raise Refused("there is no text field to search")

    def holds(name: str) -> Column:
        text = F.col(name).cast("string")
        return text.contains(term) if case_sensitive else F.lower(text).contains(term.lower())

    hits = F.array_compact(F.array(*[F.when(holds(n), F.lit(n)) for n in searched]))
    found = df.withColumn("matched", hits).where(F.size("matched") > 0)
    if max_results is None:
        return found
    if not key:
        raise Refused("max_results needs a key that orders the rows")
    return page(found, 0, max_results, key=key)


def catalog_search(kinds: Mapping[str, DataFrame], query: str = "", kind: str | None = None) -> DataFrame:
    """Rows of mixed kinds whose name or description holds the query; an empty query lists all.

    Each kind's frame holds ``name`` and ``description``. Ordered by kind, then name without case.
    """
    picked = {k: f for k, f in kinds.items() if kind is None or k.lower() == kind.lower()}
    if not picked:
        raise Refused(f"unknown kind {kind!r}")
    rows = None
    for label, frame in picked.items():
        part = frame.select(F.lit(label).alias("kind"), "name", "description")
        if query:
            text = query.lower()
            part = part.where(
                F.lower("name").contains(text) | F.coalesce(F.lower("description").contains(text), F.lit(False))
            )
        rows = part if rows is None else rows.unionByName(part)
    # The last term only spreads equal rows over tasks; they may come in any order.
    return rows.orderBy("kind", F.lower("name"), "name", "description", F.monotonically_increasing_id())


# Scores of a ranked match.
EXACT, PREFIX, INSIDE = 3, 2, 1


def ranked_search(df: DataFrame, term: str, fields: Sequence[str], name: str, key: str) -> DataFrame:
    """Rows with the best score over their fields: exact, then prefix, then contained; by score."""
    if not term.strip():
        raise Refused("a search needs a term")
    text = term.lower()

    def score(field: str) -> Column:
        value = F.lower(F.col(resolve(df.columns, field)))
        return (
            F.when(value == text, EXACT)
            .when(value.startswith(text), PREFIX)
            .when(value.contains(text), INSIDE)
            .otherwise(0)
        )

    scores = [score(f) for f in fields]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    ranked = df.withColumn("score", best).where(F.col("score") > 0)
    return ranked.orderBy(F.col("score").desc(), name, key)

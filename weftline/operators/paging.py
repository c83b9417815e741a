"""Ordering and paging. A page always has a total order; hitting a ceiling is never silent."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.operators.windows import number_rows
from weftline.session import settle, settle_measured
from weftline.specs import Ordering, ordering

# Every task hands this many rows to the last one of a top-n; beyond it positions are computed. Both answer in order.
DEEP = 10_000


def order_by(df: DataFrame, *names: str | Ordering) -> DataFrame:
    return df.orderBy(*[o.column() for o in ordering(*names)])


def _complete(order: Sequence[str | Ordering], key: Sequence[str]) -> list[Ordering]:
    """The stated order, made total by the key; the key alone where no order is stated."""
    stated = ordering(*order)
    if not stated and not key:
        raise Refused("a page needs an order or a declared key")
    named = {o.name for o in stated}
    return stated + [o for o in ordering(*key) if o.name not in named]


def page(
    df: DataFrame, skip: int, take: int, order: Sequence[str | Ordering] = (), key: Sequence[str] = ()
) -> DataFrame:
    """Skip and take after ordering. A shallow page is a distributed top-n; a deep one is looked for by ranks first, and only
    the ranges that hold it are ordered."""
    if skip < 0 or take < 0:
        raise Refused("skip and take cannot be negative")
    sort = _complete(order, key)
    if skip + take <= DEEP:
        return df.orderBy(*[o.column() for o in sort]).offset(skip).limit(take)
    around, before = _ranges_of(df, skip, take, sort)
    # Only what lies between two known ranks is put in order.
    if skip - before + take <= DEEP:
        return around.orderBy(*[o.column() for o in sort]).offset(skip - before).limit(take)
    placed = number_rows(around, sort, "__at")
    first = F.lit(skip - before)
    return placed.where((F.col("__at") > first) & (F.col("__at") <= first + take)).orderBy("__at").drop("__at")


#: Rows looked at to cut a range, cuts of a range, and times a range is cut at most.
SAMPLE, CUTS, ROUNDS = 1024, 32, 6
#: Types whose values can be named in a filter as they are.
_NAMED = (T.NumericType, T.StringType, T.BooleanType, T.DateType)


def _comes_before(sort: Sequence[Ordering], values: Sequence[object]) -> Column:
    """Whether a row comes before the given values; NULL comes first, or last in descending order."""
    result, equal = F.lit(False), F.lit(True)
    for o, value in zip(sort, values, strict=True):
        column = F.col(o.name)
        if value is None:
            ahead = column.isNotNull() if o.descending else F.lit(False)
        elif o.descending:
            ahead = F.coalesce(column > F.lit(value), F.lit(False))
        else:
            ahead = F.coalesce(column < F.lit(value), F.lit(True))
        result = result | (equal & ahead)
        equal = equal & (column.isNull() if value is None else column.eqNullSafe(F.lit(value)))
    return result


def _ranges_of(df: DataFrame, skip: int, take: int, sort: Sequence[Ordering]) -> tuple[DataFrame, int]:
    """The rows of the ranges that hold a page, and how many rows come before them.

    Exact ranks of some keys come from one count over the order columns, which are written down once. Between the last of them
    before the page and the first behind it the next keys are taken, until the ranges are about as small as the page. The
    keys are those of the least hashes, so a rerun takes the same.
    """
    names = [o.name for o in sort]
    if not all(isinstance(df.schema[n].dataType, _NAMED) for n in names):
        return df, 0
    keys = settle(df.select(*dict.fromkeys(names)), "page-keys")
    before, rows, inside, filters = 0, None, keys, []
    for _ in range(ROUNDS):
        some = inside.orderBy(F.xxhash64(*names)).limit(SAMPLE).orderBy(*[o.column() for o in sort]).collect()
        picked = [tuple(r[n] for n in names) for r in some[:: max(1, len(some) // CUTS)]]
        counts = [F.count_if(_comes_before(sort, p)).alias(f"r{i}") for i, p in enumerate(picked)]
        n, *ranks = inside.agg(F.count(F.lit(1)), *counts).first()
        low = max((i for i, r in enumerate(ranks) if before + r <= skip), default=None)
        high = min((i for i, r in enumerate(ranks) if before + r >= skip + take), default=None)
        left = (n if high is None else ranks[high]) - (0 if low is None else ranks[low])
        if low is not None:
            filters.append(~_comes_before(sort, picked[low]))
            before += ranks[low]
        if high is not None:
            filters.append(_comes_before(sort, picked[high]))
        inside = reduce(DataFrame.where, filters, keys)
        if left <= take + DEEP or (rows is not None and 4 * left > 3 * rows):
            break
        rows = left
    return reduce(DataFrame.where, filters, df), before


def page_with_more(
    df: DataFrame, skip: int, take: int, order: Sequence[str | Ordering] = (), key: Sequence[str] = ()
) -> DataFrame:
    """A page with ``has_more``: one row beyond the page is fetched, counted and cut off again.

    Beyond ``DEEP`` rows the whole frame is counted instead, so no task ever holds more than that.
    """
    sort = _complete(order, key)
    if skip + take >= DEEP:
        beyond = df.agg((F.count(F.lit(1)) > skip + take).alias("more")).scalar()
        return page(df, skip, take, order, key).withColumn("has_more", beyond)
    fetched = page(df, skip, take + 1, order, key)
    # The window sees take + 1 rows at most: its size is the page, not the table.
    whole = Window.partitionBy(F.lit(0))
    at = F.row_number().over(whole.orderBy(*[o.column() for o in sort]))
    counted = fetched.withColumns({"has_more": F.count(F.lit(1)).over(whole) > take, "__at": at})
    return counted.where(F.col("__at") <= take).drop("__at")


def top_k(df: DataFrame, measure: str, n: int, key: Sequence[str]) -> DataFrame:
    return page(df, 0, n, [Ordering(measure, True)], key)


def row_ceiling(df: DataFrame, ceiling: int) -> DataFrame:
    """All rows, or a refusal: a result cut at a ceiling must not look complete.

    The frame is evaluated once, written to the shared folder and counted on the way.
    """
    settled, seen = settle_measured(df, "ceiling", rows=F.count(F.lit(1)))
    if seen["rows"] > ceiling:
        raise Refused(f"more than {ceiling} rows")
    return settled


def page_after(
    df: DataFrame, key: str, last: object | None, take: int
) -> DataFrame:
    """Continuation paging: the filter reaches the scan, so deep pages cost no more than the first."""
    if take <= 0:
        raise Refused("page size must be positive")
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return page(rest, 0, take, key=[key])


def rows_per_source(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """A source capped for a trial run, by its key so that a rerun sees the same rows."""
    if n <= 0:
        raise Refused("rows per source must be positive")
    return page(df, 0, n, key=key)

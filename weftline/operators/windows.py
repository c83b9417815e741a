"""Window calculations that survive a hot partition key.

Ordinary keys are one built-in window over one scan. A key with more rows than ``spread.MOST`` is cut into chunks of
that many positions: ROW_NUMBER and the running SUM, AVG, MIN, MAX and COUNT are prefix scans, where each (key, chunk)
group is scanned on its own, the chunk totals are scanned over the key, and both are added. RANK and DENSE_RANK first
collapse ties, so a hot value is one row. LAG and LEAD meet the row at the position so far away.
Chunks are cut at fixed positions, so a sum of floating numbers adds up in the same order on any cluster.
The default frame is everything from the start to the current row.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators.lookup import lookup
from weftline.operators.spread import CHUNK, POSITION, key_parts, positions, split_hot, with_chunks
from weftline.specs import Ordering, ordering

RUNNING = ("row_number", "sum", "avg", "min", "max", "count")
RANKING = ("rank", "dense_rank")
SHIFTING = ("lag", "lead")
FUNCTIONS = RUNNING + RANKING + SHIFTING


@dataclass(frozen=True)
class WindowColumn:
    """``function`` over ``column`` as ``name``; ``offset`` is for lag and lead."""

    name: str
    function: str
    column: str | None = None
    offset: int = 1

    def __post_init__(self) -> None:
        if self.function not in FUNCTIONS:
            raise Refused(f"unknown window function {self.function!r}")
        if self.offset < 1:
            raise Refused("offset must be positive")


def _join_back(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on ``names``, which hold no NULL; ``right`` holds one row per key.

    The left side comes from a window over the same names: it is neither shuffled nor sorted again.
    """
    renamed = right.withColumnsRenamed({n: f"__r{n}" for n in names})
    same = reduce(operator.and_, [left[n] == renamed[f"__r{n}"] for n in names])
    return left.join(renamed, same, "left").drop(*[f"__r{n}" for n in names])


def _union(plain: DataFrame | None, cut: DataFrame | None) -> DataFrame:
    if plain is None or cut is None:
        return cut if plain is None else plain
    return plain.unionByName(cut)


def running(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str | Ordering],
    columns: Sequence[WindowColumn],
    most: int | None = None,
) -> DataFrame:
    """Running functions. ``order`` must be total: end it with a unique key."""
    keys, sort = list(partition), ordering(*order)
    plain, hot = split_hot(df, keys, most)
    sums = [(f, c) for c in sorted({c.column for c in columns if c.column}) for f in PARTS if _needed(columns, c, f)]
    if plain is not None:
        plain = _scanned(plain, keys, [o.column() for o in sort], sums)
        plain = plain.withColumns({"__b_n": F.lit(0)} | {f"__b_{f}_{c}": F.lit(None).cast(plain.schema[f"__{f}_{c}"].dataType) for f, c in sums})
        plain = plain.withColumns({c.name: _running_value(c) for c in columns}).select(*df.columns, *[c.name for c in columns])
    if hot is not None:
        hot = _cut(hot, keys, sort, sums, most)
        hot = hot.withColumns({c.name: _running_value(c) for c in columns}).select(*df.columns, *[c.name for c in columns])
    return _union(plain, hot)


def _scanned(df: DataFrame, parts: Sequence[str], sort: Sequence[Column], sums: Sequence[tuple[str, str]]) -> DataFrame:
    local = Window.partitionBy(*parts).orderBy(*sort)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"__n": F.row_number().over(local)} | {f"__{f}_{c}": getattr(F, f)(c).over(upto) for f, c in sums})


def _cut(df: DataFrame, keys: list[str], sort: list[Ordering], sums: Sequence[tuple[str, str]], most: int | None) -> DataFrame:
    """Each chunk scanned alone, with what came before it under ``__b_`` names."""
    base = with_chunks(df, keys, sort, most)
    owner = list(key_parts(df, keys))
    parts = [*owner, CHUNK]
    scanned = _scanned(base, parts, [F.col(POSITION)], sums)
    # A chunk's totals are its last row's; summing again might add floating numbers in another order.
    last = scanned.groupBy(*parts).agg(
        F.max("__n").alias("__t_n"), *[F.max_by(f"__{f}_{c}", POSITION).alias(f"__t_{f}_{c}") for f, c in sums]
    )
    before = Window.partitionBy(*owner).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select(
        *parts,
        F.sum("__t_n").over(before).alias("__b_n"),
        *[PARTS[f](f"__t_{f}_{c}").over(before).alias(f"__b_{f}_{c}") for f, c in sums],
    )
    return _join_back(scanned, offsets, parts).withColumn("__b_n", F.coalesce("__b_n", F.lit(0)))


# How the totals of chunks merge.
PARTS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _needed(columns: Sequence[WindowColumn], column: str, part: str) -> bool:
    uses = {"sum": {"sum"}, "avg": {"sum", "count"}, "count": {"count"}, "min": {"min"}, "max": {"max"}}
    return any(c.column == column and part in uses.get(c.function, set()) for c in columns)


def _running_value(spec: WindowColumn) -> Column:
    name = spec.column

    def added(part: str) -> Column:
        here, before = F.col(f"__{part}_{name}"), F.col(f"__b_{part}_{name}")
        return F.coalesce(here + before, here, before)

    if spec.function == "row_number" or (spec.function == "count" and name is None):
        return F.col("__n") + F.col("__b_n")
    if spec.function == "count":
        return added("count")
    if spec.function == "sum":
        return added("sum")
    if spec.function == "avg":
        return added("sum").cast("double") / F.nullif(added("count"), F.lit(0))
    pick = F.least if spec.function == "min" else F.greatest
    return pick(F.col(f"__{spec.function}_{name}"), F.col(f"__b_{spec.function}_{name}"))


def ranking(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str | Ordering],
    columns: Sequence[WindowColumn],
    most: int | None = None,
) -> DataFrame:
    """RANK and DENSE_RANK over ``order``, whose ties share a rank.

    Ordinary keys use the built-in functions. The ties of hot keys are collapsed to one row
    each, placed by their running counts, and joined back.
    """
    keys, sort = list(partition), ordering(*order)
    names = [*df.columns, *[c.name for c in columns]]
    plain, hot = split_hot(df, keys, most)
    if plain is not None:
        over = Window.partitionBy(*keys).orderBy(*[o.column() for o in sort])
        native = {c.name: getattr(F, c.function)().over(over).cast("long") for c in columns}
        plain = plain.withColumns(native).select(*names)
    if hot is not None:
        values = keys + [o.name for o in sort if o.name not in keys]
        ties = hot.groupBy(*values).agg(F.count(F.lit(1)).alias("__ties"))
        places = [WindowColumn("__upto", "sum", "__ties"), WindowColumn("__place", "row_number")]
        scanned = running(ties, keys, sort, places, most)
        forms = {"rank": F.col("__upto") - F.col("__ties") + 1, "dense_rank": F.col("__place")}
        ranks = scanned.select(*values, *[forms[c.function].cast("long").alias(c.name) for c in columns])
        placed = ranks.withColumnsRenamed({v: f"__r_{v}" for v in values})
        hot = lookup(hot, placed, [(v, f"__r_{v}") for v in values], "inner", null_safe=True).select(*names)
    return _union(plain, hot)


def shifted(
    df: DataFrame, partition: Sequence[str], order: Sequence[str | Ordering], column: WindowColumn, most: int | None = None
) -> DataFrame:
    """LAG and LEAD in a total order."""
    keys, sort = list(partition), ordering(*order)
    plain, hot = split_hot(df, keys, most)
    if plain is not None:
        over = Window.partitionBy(*keys).orderBy(*[o.column() for o in sort])
        plain = plain.withColumn(column.name, getattr(F, column.function)(column.column, column.offset).over(over))
    if hot is not None:
        hot = _by_position(hot, keys, sort, column)
    return _union(plain, hot)


def _by_position(df: DataFrame, keys: list[str], sort: list[Ordering], spec: WindowColumn) -> DataFrame:
    """Number the rows, then meet the row that lies ``offset`` away."""
    numbered = positions(df, keys, sort)
    step = spec.offset if spec.function == "lag" else -spec.offset
    owner = list(key_parts(df, keys))
    away = numbered.select(*owner, (F.col(POSITION) + step).alias(POSITION), F.col(spec.column).alias("__away"))
    joined = _join_back(numbered, away, [*owner, POSITION])
    return joined.withColumn(spec.name, F.col("__away")).select(*df.columns, spec.name)


def windowed(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str | Ordering],
    column: WindowColumn,
    key: Sequence[str] = (),
    most: int | None = None,
) -> DataFrame:
    """One windowed calculation. ``key`` completes the order where the function needs a total one."""
    if column.function in RANKING:
        return ranking(df, partition, order, [column], most)
    total = [*ordering(*order), *ordering(*key)]
    if column.function in SHIFTING:
        return shifted(df, partition, total, column, most)
    return running(df, partition, total, [column], most)


def number_rows(df: DataFrame, order: Sequence[str | Ordering], name: str, start: Column | int = 0) -> DataFrame:
    """Consecutive numbers after ``start`` over the whole frame, without a single-task window."""
    first = start if isinstance(start, Column) else F.lit(start)
    placed = positions(df, [], ordering(*order))
    return placed.withColumn(name, (F.col(POSITION) + first).cast("long")).drop(*({POSITION} - {name}))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``: a max of structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    picked = df.groupBy(*keys).agg(F.max(row).alias("__row"))
    fields = [F.col(f"__row.{c}").alias(c) for c in (*order, *rest)]
    return picked.select(*keys, *fields).select(*df.columns)


def field_history(
    df: DataFrame, record: Sequence[str], version: str, started: str, ended: str = "valid_to"
) -> DataFrame:
    """Every version of a record in version order; a version ends where the next one starts."""
    return shifted(df, record, [version], WindowColumn(ended, "lead", started))


def period_over_period(
    df: DataFrame, at: str, measure: Column, months: Sequence[tuple[str, int]] = (("month", 1), ("year", 12))
) -> DataFrame:
    """Monthly value against the value one month and one year earlier.

    The months are few; each comparison is a join on the month's ordinal, which also gets
    missing months right where a shift by rows would not.
    """
    monthly = (
        df.groupBy((F.year(at) * 12 + F.month(at) - 1).alias("__month"))
        .agg(measure.alias("value"))
    )
    result = monthly
    for label, back in months:
        earlier = monthly.select(
            (F.col("__month") + back).alias("__month"), F.col("value").alias(f"previous_{label}")
        )
        result = result.join(earlier, "__month", "left")
        change = F.col("value") - F.col(f"previous_{label}")
        result = result.withColumns(
            {
                f"delta_{label}": change,
                f"percent_{label}": change * 100 / F.nullif(F.col(f"previous_{label}"), F.lit(0).cast(monthly.schema["value"].dataType)),
            }
        )
    period = F.make_date(F.floor(F.col("__month") / 12).cast("int"), (F.col("__month") % 12 + 1).cast("int"), F.lit(1))
    return result.withColumn("period", period).drop("__month")

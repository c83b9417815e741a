"""Aggregates: calculation types, statistical summaries, counts, usage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.operators.paging import page
from weftline.specs import Ordering



def _mean(column: str | Column) -> Column:
    """The sum as it is, exact for decimals, over the count; NULL for no value."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


CALCULATIONS = {"Sum": F.sum, "Average": _mean, "Count": F.count, "Min": F.min, "Max": F.max}


def calculate(df: DataFrame, kind: str, column: str | Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """One of the five calculation types over a column, per group when ``by`` is given."""
    if kind not in CALCULATIONS:
        raise Refused(f"unknown calculation type {kind!r}")
    measure = CALCULATIONS[kind](column).alias(name)
    return df.groupBy(*by).agg(measure) if by else df.agg(measure)


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)


def _decimals(kinds: Sequence[T.DataType]) -> str:
    """A type that holds the values of all columns that are not floating, without loss."""
    scale = max([k.scale for k in kinds if isinstance(k, T.DecimalType)], default=0)
    return f"decimal(38,{scale})"


def _kind(kind: T.DataType) -> str:
    """The histogram column a value lies in: whole numbers, decimals or floating numbers."""
    if isinstance(kind, T.IntegralType):
        return "w"
    return "d" if isinstance(kind, T.DecimalType) else "f"


def _shared_decimal(kinds: Sequence[T.DataType]) -> T.DecimalType:
    """The narrowest type for the values of all decimal columns; up to 18 digits Spark computes in longs."""
    decimals = [k for k in kinds if isinstance(k, T.DecimalType)]
    scale = max(k.scale for k in decimals)
    return T.DecimalType(max(k.precision - k.scale for k in decimals) + scale, scale)


def value_histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``column_no, w, d, f, n`` (and the group): how often each value occurs in each column, NULL included.

    ``column_no`` numbers ``columns``. A value lies in ``w`` if its column is of whole numbers, in ``d`` if of decimals, in
    ``f`` if of floating numbers; columns of absent kinds are left out. Values are counted in each task before they are
    shuffled, so neither a hot value nor a hot group meets one task; each column is read once.
    """
    kinds = [df.schema[c].dataType for c in columns]
    types = {"w": "bigint", "d": None, "f": "double"}
    if any(_kind(k) == "d" for k in kinds):
        types["d"] = _shared_decimal(kinds).simpleString()
    present = [x for x in "wdf" if any(_kind(k) == x for k in kinds)]
    entries = [
        F.struct(
            F.lit(i).alias("column_no"),
            *[(F.col(name) if x == _kind(kind) else F.lit(None)).cast(types[x]).alias(x) for x in present],
        )
        for i, (name, kind) in enumerate(zip(columns, kinds, strict=True))
    ]
    groups = [F.col(b).alias(f"__by_{b}") for b in by]
    if len(present) == 1:
        # Plain values are lighter than rows of one field.
        values = F.array(*[F.col(c).cast(types[present[0]]) for c in columns])
        rows = df.select(*groups, F.posexplode(values).alias("column_no", present[0]))
    else:
        rows = df.select(*groups, F.inline(F.array(*entries)))
    return rows.groupBy(*[f"__by_{b}" for b in by], "column_no", *present).agg(F.count(F.lit(1)).alias("n"))


#: Rows that a first look at a table fetches at most.
FIRST = 1000
#: Digits of a count beside a decimal value in an exact sum of products.
_COUNT = "decimal(12,0)"


def stat_set(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per numeric column (and group): n, nulls, distinct, min, max, sum, mean, stddev.

    All follow from one histogram, (group, column, value) with its count: one scan, one shuffle of distinct values, and
    one of groups. Values are compared exactly; minimum, maximum and sum are taken in each column's own kind and given
    as exact decimals. Where only some of the columns hold floating numbers, they are given as doubles, and
    ``min_exact``, ``max_exact`` and ``sum_exact`` follow: exact decimals of the others, NULL for the floating ones.
    Second moments are taken around a value of the table, which a first look fetches, so that large numbers close to each
    other keep their digits: the deviation's relative error is about 1e-16 times the square of (the distance of a group's
    mean from that value, over the deviation). Where the first rows hold no value of a column, or decimals have over 25
    digits, moments are one aggregate and distinct values another. Without a group every column has its row, also over
    no rows.
    """
    if not columns:
        raise Refused("a stat set needs at least one column")
    numbers = df.select(*by, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    types = [numbers.schema[f"__v{i}"].dataType for i in range(len(columns))]
    exact = _decimals(types)
    if any(isinstance(k, T.DecimalType) for k in types) and _shared_decimal(types).precision > 25:
        # Products of such values and counts would not fit: one conversion to the widest type, each value once.
        return _stat_set_wide(numbers, columns, types, by)
    around = _pivots(numbers, len(columns))
    if around is None:
        return _stat_set_wide(numbers, columns, types, by)
    common = "double" if any(_floating(k) for k in types) else exact
    mixed = common == "double" and not all(_floating(k) for k in types)
    histogram = value_histogram(numbers, [f"__v{i}" for i in range(len(columns))], by)
    kinds = [x for x in "wdf" if x in histogram.columns]
    present = F.coalesce(*[F.col(x).cast("double") for x in kinds]).isNotNull()
    n = F.col("n")
    pivot = F.element_at(F.array(*[F.lit(p) for p in around]), F.col("column_no") + 1)
    # In doubles before the difference: a difference of whole numbers may leave their range.
    off = F.coalesce(*[F.col(x).cast("double") for x in kinds]) - pivot
    measures = [
        F.coalesce(F.sum(F.when(present, n)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("nulls"),
        F.count_if(present).alias("distinct_values"),
        F.sum(off * n).alias("first"),
        F.sum(off * off * n).alias("second"),
    ]
    for x in kinds:
        product = F.col(x) * n if x == "f" else (F.col(x).cast("decimal(20,0)") if x == "w" else F.col(x)) * n.cast(_COUNT)
        measures += [F.min(x).alias(f"min_{x}"), F.max(x).alias(f"max_{x}"), F.sum(product).alias(f"sum_{x}")]
    groups = [f"__by_{b}" for b in by]
    seen = histogram.groupBy(*groups, "column_no").agg(*measures)
    if not by:
        numbered = df.sparkSession.range(0, len(columns), 1, 1).select(F.col("id").cast("int").alias("no"))
        seen = numbered.join(seen, F.col("no") == F.col("column_no"), "left").withColumn("column_no", F.col("no"))
        seen = seen.fillna(0, ["n", "nulls", "distinct_values"])

    def taken(part: str, kind: str) -> Column:
        # Only the column of a value's own kind holds anything.
        return F.coalesce(*[F.col(f"{part}_{x}").cast(kind) for x in kinds])

    variance = (F.col("second") - F.col("first") * F.col("first") / F.col("n")) / (F.col("n") - 1)
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_no") + 1)
    whole = [x for x in kinds if x != "f"]
    total = F.coalesce(*[F.col(f"sum_{x}").cast("double") for x in kinds])
    return seen.select(
        *[F.col(f"__by_{b}").alias(b) for b in by],
        names.alias("column"),
        "n",
        "nulls",
        "distinct_values",
        *[taken(part, common).alias(f"{part}_value") for part in ("min", "max", "sum")],
        F.try_divide(total, F.col("n")).alias("mean_value"),
        F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).alias("stddev_value"),
        *([F.coalesce(*[F.col(f"{p}_{x}").cast(exact) for x in whole]).alias(f"{p}_exact") for p in ("min", "max", "sum")] if mixed else []),
    )


def _pivots(numbers: DataFrame, count: int) -> list[float] | None:
    """A finite value of each column from the first rows; None where those hold no value of some column."""
    values = [F.col(f"__v{i}").cast("double").alias(f"__v{i}") for i in range(count)]
    rows = numbers.select(*values).limit(FIRST).collect()
    found = [next((float(r[i]) for r in rows if r[i] is not None and math.isfinite(r[i])), None) for i in range(count)]
    return None if any(v is None for v in found) else found


def _stat_set_wide(numbers: DataFrame, columns: Sequence[str], types: Sequence[T.DataType], by: Sequence[str]) -> DataFrame:
    """A stat set of decimals of more than 25 digits: moments in one aggregate, distinct values counted in another."""
    exact = _decimals(types)
    common = "double" if any(_floating(k) for k in types) else exact
    parts = ("min", "max", "sum")
    extra = [f"{p}_exact" for p in parts] if common == "double" and not all(_floating(k) for k in types) else []
    measures, entries = [], []
    for i, name in enumerate(columns):
        value = F.col(f"__v{i}")
        own = "double" if _floating(types[i]) else exact
        # A sum of longs may leave their range.
        summed = value if own == "double" else value.cast(own)
        measures += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.isNull()).alias(f"nulls{i}"),
            F.min(value).cast(own).alias(f"min{i}"),
            F.max(value).cast(own).alias(f"max{i}"),
            F.sum(summed).cast(own).alias(f"sum{i}"),
            F.stddev_samp(value).alias(f"stddev{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"n{i}").alias("n"),
                F.col(f"nulls{i}").alias("nulls"),
                F.col(f"min{i}").cast(common).alias("min_value"),
                F.col(f"max{i}").cast(common).alias("max_value"),
                F.col(f"sum{i}").cast(common).alias("sum_value"),
                (F.col(f"sum{i}").cast("double") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("mean_value"),
                F.col(f"stddev{i}").alias("stddev_value"),
                *[(F.lit(None) if own == "double" else F.col(f"{p}{i}")).cast(exact).alias(e) for p, e in zip(parts, extra, strict=False)],
            )
        )
    moments = numbers.groupBy(*by).agg(*measures).select(*by, F.inline(F.array(*entries)))
    kinds = {numbers.schema[f"__v{i}"].dataType for i in range(len(columns))}
    pairs = [F.struct(F.lit(name).alias("__column"), _exact(F.col(f"__v{i}"), kinds).alias("__value")) for i, name in enumerate(columns)]
    values = numbers.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.inline(F.array(*pairs)))
    distinct = values.groupBy(*[f"__by_{b}" for b in by], "__column").agg(F.count_distinct("__value").alias("distinct_values"))
    same = moments["column"] == distinct["__column"]
    for b in by:
        same = same & moments[b].eqNullSafe(distinct[f"__by_{b}"])
    joined = moments.join(distinct, same, "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return joined.select(
        *by, "column", "n", "nulls", "distinct_values", "min_value", "max_value", "sum_value", "mean_value", "stddev_value", *extra
    )


def _exact(value: Column, kinds: set[T.DataType]) -> Column:
    """The value in a form that all columns share and that keeps different values apart."""
    return value if len(kinds) == 1 else value.cast("string")


def count_by(df: DataFrame, *by: str, name: str = "rows") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def kind_summary(kinds: dict[str, DataFrame]) -> DataFrame:
    """How many of each kind there are; counting rows reads no column."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(kind).alias("kind"), "items")
        for kind, df in kinds.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def period_summary(
    df: DataFrame, at: str, failed: Column, measure: Column, user: str, start: object, end: object
) -> DataFrame:
    """Usage per calendar month inside [start, end): total, successes, failures, mean, users."""
    inside = df.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end)))
    return inside.groupBy(F.date_format(at, "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed).alias("successes"),
        F.count_if(failed).alias("failures"),
        _mean(measure).alias("mean_value"),
        F.countDistinct(user).alias("users"),
    )


def top_by_usage(df: DataFrame, by: str, n: int, name: str = "uses") -> DataFrame:
    return page(count_by(df, by, name=name), 0, n, [Ordering(name, True)], [by])


def throughput(df: DataFrame, at: str, service: str, width: str) -> DataFrame:
    """Events per service and tumbling window; the same plan serves a stream."""
    grouped = df.groupBy(F.window(at, width).alias("__w"), service).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(
        F.col("__w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("__w.end").cast("timestamp_ntz").alias("window_end"),
        service,
        "events",
    )


def run_metrics(df: DataFrame, run: Sequence[str], failed: Column, at: str) -> DataFrame:
    """Per run: records extracted, transformed and failed, duration in seconds, success flag."""
    seconds = F.timestamp_diff("SECOND", F.min(at), F.max(at))
    return df.groupBy(*run).agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(~failed).alias("transformed"),
        F.count_if(failed).alias("failed"),
        seconds.alias("seconds"),
        (F.count_if(failed) == 0).alias("success"),
    )


# Defaults of the pre-compute selection.
MIN_EXECUTIONS = 5
MAX_RECOMPUTED = 50


def precompute_stale(
    usage: DataFrame, cutoff: object, key: str, min_executions: int = MIN_EXECUTIONS, most: int = MAX_RECOMPUTED
) -> DataFrame:
    """Calculations worth recomputing: used often, and never cached or cached before ``cutoff``."""
    stale = F.col("last_cached_at").isNull() | (F.col("last_cached_at") < F.lit(cutoff))
    wanted = usage.where((F.col("executions") >= min_executions) & stale)
    return page(wanted, 0, most, [Ordering("executions", True)], [key])

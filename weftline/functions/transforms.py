"""Field transforms. Each is a Column in, Column out; a chain folds them by ordinal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.specs import Param, Step


def bind(value: object) -> Column:
    """A parameter: another field when it is a ``Param``, a constant otherwise."""
    if isinstance(value, Column):
        return value
    return F.col(value.name) if isinstance(value, Param) else F.lit(value)


# Characters whose upper case is several characters, and as many of a private plane for them.
_EXPANDING = "".join(chr(i) for i in range(0x10000) if len(chr(i).upper()) > 1)
_PRIVATE = "".join(chr(0xF0000 + i) for i in range(len(_EXPANDING)))


def to_upper(column: Column) -> Column:
    """Upper case character by character: one that has no single upper form, such as ß, stays.

    Few texts hold such a character; in those it steps aside while the rest is upper-cased. A
    text that already uses the private plane is taken apart instead.
    """
    upper = F.upper(column)
    aside = F.translate(F.upper(F.translate(column, _EXPANDING, _PRIVATE)), _PRIVATE, _EXPANDING)
    pieces = F.split(column, f"(?<=[{_EXPANDING}])|(?=[{_EXPANDING}])")
    apart = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{_EXPANDING}]$"), p).otherwise(F.upper(p)))
    free = F.length(F.translate(column, _PRIVATE, "")) == F.length(column)
    return (
        F.when(F.length(upper) == F.length(column), upper).when(free, aside).otherwise(F.array_join(apart, ""))
    )


def to_lower(column: Column) -> Column:
    return F.lower(column)


def trim(column: Column) -> Column:
    return F.trim(column)


def round_to(column: Column, digits: int = 0) -> Column:
    return F.round(column, digits)


def format_date(column: Column, fmt: str, tz: str | None = None) -> Column:
    """Format a timestamp without zone; ``tz`` first moves it from UTC to that zone."""
    moved = F.convert_timezone(F.lit("UTC"), F.lit(tz), column.cast("timestamp_ntz")) if tz else column
    return F.date_format(moved, fmt)


def when(column: Column, cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """First case that holds gives the value, in the order stated."""
    result = F
    for predicate, value in cases:
        result = result.when(predicate, bind(value))
    return result.otherwise(bind(otherwise))


def static(column: Column, value: object) -> Column:
    return F.lit(value)


def boolean(column: Column) -> Column:
    """True/false text, or a number where anything but zero is true; other text is NULL."""
    text = column.cast("string")
    return F.coalesce(
        F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False),
        text.try_cast("double") != 0,
    )


def inject(column: Column, value: object) -> Column:
    """A value of the run (run id, source name, load time) on every row."""
    return bind(value)


def replace_null(column: Column, value: object) -> Column:
    return F.coalesce(column, bind(value))


KINDS = {
    "ToUpper": to_upper,
    "ToLower": to_lower,
    "Trim": trim,
    "Round": round_to,
    "FormatDate": format_date,
    "When": when,
    "Static": static,
    "Boolean": boolean,
    "Inject": inject,
    "Coalesce": replace_null,
}


def apply_step(column: Column, step: Step) -> Column:
    if step.kind not in KINDS:
        raise Refused(f"unknown transform {step.kind!r}")
    return KINDS[step.kind](column, **step.params)


def chain(column: Column, steps: Sequence[Step]) -> Column:
    """Apply the steps in ordinal order, whatever order they are listed in."""
    return reduce(apply_step, sorted(steps, key=lambda s: s.ordinal), column)


def sum_null_as_zero(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def classify_bands(column: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The first band, from the highest threshold down, whose threshold is reached."""
    ordered = sorted(bands, key=lambda b: b[0], reverse=True)
    return when(column, [(column >= F.lit(low), name) for low, name in ordered], otherwise)


# Thresholds and labels of the yardage transform.
YARDAGE_BANDS = (
    (4000, "MVP Candidate"),
    (2000, "Elite"),
    (1500, "Pro Bowl"),
    (1000, "Starter"),
    (500, "Backup"),
)
LOWEST_BAND = "Rotational"

# The demonstration flow's own thresholds and labels.
FLOW_BANDS = (
    (2000, "Elite"),
    (1500, "Pro Bowl"),
    (1000, "Starter"),
    (500, "Backup"),
)


def safe_ratio(numerator: Column, divisor: Column, digits: int = 1) -> Column:
    """Half-to-even rounded rate, 0 for a zero divisor."""
    rate = numerator.cast("decimal(28,6)") / F.nullif(divisor.cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return F.when(divisor == 0, F.lit(0.0)).otherwise(F.bround(rate, digits).cast("double"))


def point_wkt(first: Column, second: Column, geography: bool = False) -> Column:
    """``POINT (x y)``. A geography stores latitude first, its text puts longitude first."""
    x, y = (second, first) if geography else (first, second)
    return F.when(
        first.isNotNull() & second.isNotNull(),
        F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")")),
    )


def spatial_value(first: Column, second: Column, srid: int, geography: bool = False) -> Column:
    return F.struct(
        point_wkt(first, second, geography).alias("wkt"),
        F.lit(srid).alias("srid"),
        F.lit("geography" if geography else "geometry").alias("kind"),
    )

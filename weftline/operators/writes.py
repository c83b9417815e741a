"""Table writes as next states.

A plain file table has no MERGE, so each write computes the table that should follow, and
the rows it wrote; ``sources.sinks.publish`` then puts that table in place of the old one.
Keys compare by value, text without case, and NULL equals nothing.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.functions.keys import align_keys, key_columns, present_keys
from weftline.operators.lookup import lookup
from weftline.operators.windows import number_rows
from weftline.specs import TableSpec

IS_CURRENT, IS_DELETED = "IsCurrent", "IsDeleted"


@dataclass(frozen=True)
class Change:
    """The table after the write, and the rows the write touched."""

    state: DataFrame
    written: DataFrame


def returning(change: Change, spec: TableSpec, columns: Sequence[str]) -> DataFrame:
    """The written rows cut to the named columns; an undeclared one is refused before any write."""
    return change.written.select(*spec.require(columns))


def _declared(rows: DataFrame, spec: TableSpec, like: DataFrame) -> DataFrame:
    """Rows in the declared columns, each in the target's type; a column they lack is NULL."""
    spec.require(rows.columns)
    held = {c.lower(): c for c in rows.columns}
    return rows.select(
        *[
            (F.col(held[c.lower()]) if c.lower() in held else F.lit(None)).cast(like.schema[c].dataType).alias(c)
            for c in spec.columns
        ]
    )


def _last_id(spec: TableSpec, *frames: DataFrame) -> Column:
    """The highest row id in use, 0 for an empty table, as a scalar subquery."""
    ids = None
    for frame in frames:
        part = frame.select(F.col(spec.physical_key).cast("long").alias("id"))
        ids = part if ids is None else ids.unionAll(part)
    return ids.agg(F.greatest(F.lit(0), F.max("id")).alias("id")).scalar()


def _numbered(target: DataFrame, rows: DataFrame, spec: TableSpec, order: Sequence[str]) -> DataFrame:
    """Give rows without a physical key the next ids, in ``order``; a key a row carries is kept."""
    key = spec.physical_key
    fresh = number_rows(
        rows.where(F.col(key).isNull()).drop(key), order, "__id", _last_id(spec, target, rows)
    )
    fresh = fresh.withColumn(key, F.col("__id").cast(rows.schema[key].dataType))
    return rows.where(F.col(key).isNotNull()).unionByName(fresh.select(*rows.columns))


def insert_append(target: DataFrame, rows: DataFrame, spec: TableSpec, order: Sequence[str] = ()) -> Change:
    """Append rows. ``order`` (ending in a unique column) is the order in which ids are given."""
    added = _declared(rows, spec, target)
    if spec.physical_key is not None:
        if not order:
            raise Refused("row ids need an order of the new rows")
        added = _numbered(target, added, spec, order)
    return Change(target.unionByName(added), added)


def insert_replace(target: DataFrame, rows: DataFrame, spec: TableSpec) -> Change:
    """Truncate and insert as one step: the new rows are the table."""
    added = _declared(rows, spec, target)
    return Change(added, added)


def _selected(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def update_where(target: DataFrame, spec: TableSpec, predicate: Column, values: Mapping[str, object]) -> Change:
    """Set the declared columns that ``values`` carries on the rows the filter selects.

    The physical key and the version flags are never set. Nothing left to set is refused.
    """
    fixed = {n.lower() for n in (spec.physical_key, IS_CURRENT, IS_DELETED) if n}
    given = {n.lower(): v for n, v in values.items()}
    names = [c for c in spec.columns if c.lower() in given and c.lower() not in fixed]
    if not names:
        raise Refused(f"table {spec.name}: the record carries no updatable column")
    hit = _selected(predicate)

    def new_value(name: str) -> Column:
        value = given[name.lower()]
        column = value if isinstance(value, Column) else F.lit(value)
        return column.cast(target.schema[name].dataType)

    marked = target.withColumn("__hit", hit)
    state = marked.withColumns(
        {n: F.when(F.col("__hit"), new_value(n)).otherwise(F.col(n)) for n in names}
    )
    return Change(state.drop("__hit"), state.where("__hit").drop("__hit"))


def delete_where(target: DataFrame, predicate: Column | None = None, all_rows: bool = False) -> Change:
    """Remove the rows a filter selects, or all when so stated; a delete that states neither is refused."""
    if predicate is None and not all_rows:
        raise Refused("a delete states a filter or all rows")
    hit = F.lit(True) if predicate is None else _selected(predicate)
    return Change(target.where(~hit), target.where(hit))


@dataclass(frozen=True)
class SoftDelete:
    """What a soft delete sets, and what besides the filter a row must hold."""

    flag: str
    flag_value: bool = True
    deleted_at: tuple[str, object] | None = None
    marker: tuple[str, object] | None = None
    absent_keys: Sequence[str] = ()


def soft_delete(
    target: DataFrame,
    spec: TableSpec,
    options: SoftDelete,
    predicate: Column | None = None,
    source: DataFrame | None = None,
) -> Change:
    """Flag rows instead of removing them; every row is kept.

    A row is flagged when it does not hold the flag value yet, the filter selects it, its
    marker holds the marker value, and, given a source, its key is absent from it.
    """
    if predicate is None and source is None:
        raise Refused("a soft delete states a filter or a source")
    if (source is None) != (not options.absent_keys):
        raise Refused("a source set and its key columns go together")
    named = [options.flag, *options.absent_keys]
    named += [pair[0] for pair in (options.deleted_at, options.marker) if pair is not None]
    spec.require(named)
    flag = F.col(options.flag)
    hit = ~F.coalesce(flag == F.lit(options.flag_value), F.lit(False))
    if predicate is not None:
        hit = hit & _selected(predicate)
    if options.marker is not None:
        column, value = options.marker
        hit = hit & _selected(F.lower(F.col(column).cast("string")) == F.lit(str(value).lower()))
    marked = target
    if source is not None:
        marked = _mark_present(target, source, spec.require(options.absent_keys), "__present")
        hit = hit & ~F.col("__present")
    state = marked.withColumn("__hit", hit)
    values = {options.flag: F.when(F.col("__hit"), F.lit(options.flag_value)).otherwise(flag)}
    if options.deleted_at is not None:
        column, value = options.deleted_at
        stamp = F.lit(value).cast(target.schema[column].dataType)
        values[column] = F.when(F.col("__hit"), stamp).otherwise(F.col(column))
    state = state.withColumns(values)
    return Change(
        state.select(*target.columns), state.where("__hit").select(*target.columns)
    )


def _keyed(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """The target with comparable keys, the distinct keys of the source, and how they pair."""
    left, right = align_keys(target, source.select(*keys), keys)
    names = key_columns(keys)
    present = present_keys(right, keys).withColumnsRenamed({n: f"{n}_in" for n in names})
    return left, present, [(n, f"{n}_in") for n in names]


def _mark_present(target: DataFrame, source: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: whether the row's key is in ``source``. The source shrinks to distinct keys."""
    left, present, pairs = _keyed(target, source, keys)
    joined = lookup(left, present.withColumn(name, F.lit(True)), pairs)
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).select(*target.columns, name)


def _absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``source``; a NULL key is in no source."""
    left, present, pairs = _keyed(target, source, keys)
    return lookup(left, present, pairs, "left_anti").select(*target.columns)


def version_save(target: DataFrame, rows: DataFrame, spec: TableSpec, order: Sequence[str]) -> Change:
    """Version on write: the stored current row of a saved logical id is closed, the new one appended.

    Rows are saved in ``order``; when one save holds an id twice, its last row stays current. A row without a complete
    logical id equals no other: it is appended as current and closes none.
    """
    if not spec.logical_key or spec.physical_key is None:
        raise Refused(f"table {spec.name} is not versioned")
    saved = _declared(rows, spec, target).drop(spec.physical_key, IS_CURRENT, IS_DELETED)
    numbered = number_rows(saved, order, spec.physical_key, _last_id(spec, target))
    keys = list(spec.logical_key)
    numbered, _ = align_keys(numbered, target, keys)
    names = key_columns(keys)
    complete = reduce(operator.and_, [F.col(n).isNotNull() for n in names])
    known = numbered.where(complete)
    last = known.groupBy(*[F.col(n).alias(f"{n}_in") for n in names]).agg(F.max(spec.physical_key).alias("__last"))
    current = F.coalesce(F.col(spec.physical_key) == F.col("__last"), F.lit(True))
    added = (
        lookup(numbered, last, [(n, f"{n}_in") for n in names])
        .withColumns({IS_CURRENT: current, IS_DELETED: F.lit(False)})
        .withColumn(spec.physical_key, F.col(spec.physical_key).cast(target.schema[spec.physical_key].dataType))
        .select(*target.columns)
    )
    closed = _mark_present(target, saved, keys, "__hit")
    closed = closed.withColumn(IS_CURRENT, F.col(IS_CURRENT) & ~F.col("__hit")).drop("__hit")
    return Change(closed.unionByName(added), added)


def version_retire(target: DataFrame, ids: DataFrame, spec: TableSpec) -> Change:
    """Mark the current rows of the given logical ids deleted, in place; they stay current."""
    marked = _mark_present(target, ids, list(spec.logical_key), "__id_hit")
    hit = F.col("__id_hit") & F.col(IS_CURRENT) & ~F.col(IS_DELETED)
    state = marked.withColumn("__hit", hit).withColumn(IS_DELETED, F.col(IS_DELETED) | F.col("__hit"))
    return Change(
        state.drop("__hit", "__id_hit"), state.where("__hit").drop("__hit", "__id_hit")
    )


def _one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the last by ``order``. Without an order equal keys fail the write.

    Keys are equal as everywhere, by value; a row whose key holds NULL equals no other.
    """
    formed, _ = align_keys(rows, rows, keys)
    names = key_columns(keys)
    complete = reduce(operator.and_, [F.col(n).isNotNull() for n in names])
    whole = F.struct(*rows.columns)
    pick = F.max_by(whole, F.struct(*order)) if order else F.any_value(whole)
    one = formed.where(complete).groupBy(*names).agg(pick.alias("__row"), F.count(F.lit(1)).alias("__n"))
    if not order:
        refusal = F.raise_error(F.lit(f"several rows hold one key {', '.join(keys)}; state an order"))
        one = one.withColumn("__row", F.when(F.col("__n") > 1, refusal).otherwise(F.col("__row")))
    return one.select("__row.*").unionByName(formed.where(~complete).select(*rows.columns))


def upsert(
    target: DataFrame, rows: DataFrame, spec: TableSpec, keys: Sequence[str], order: Sequence[str] = ()
) -> Change:
    """Replace rows whose key is stored, add the others.

    ``order`` decides among equal source keys and should be total; without one they are refused.
    """
    incoming = _one_per_key(_declared(rows, spec, target), spec.require(keys), spec.require(order))
    return Change(_absent(target, incoming, spec.require(keys)).unionByName(incoming), incoming)


def insert_if_new(
    target: DataFrame, rows: DataFrame, spec: TableSpec, keys: Sequence[str], order: Sequence[str] = ()
) -> Change:
    """Add the rows whose key is not stored yet; running it again adds nothing. Equal source keys as in ``upsert``."""
    incoming = _one_per_key(_declared(rows, spec, target), spec.require(keys), spec.require(order))
    added = _absent(incoming, target, spec.require(keys))
    return Change(target.unionByName(added), added)


def state_change(
    documents: DataFrame, log: DataFrame, changes: DataFrame, document_id: str, state: str, at: str, change_id: str
) -> tuple[DataFrame, DataFrame]:
    """Append changes to the log; each document moves to the state of its latest change."""
    latest = changes.groupBy(F.col(document_id).alias("__doc")).agg(
        F.max(F.struct(F.col(at), F.col(change_id), F.col(state).alias("__state"))).alias("__last")
    )
    moved = lookup(documents, latest, [(document_id, "__doc")])
    moved = moved.withColumn(state, F.coalesce(F.col("__last.__state"), F.col(state)))
    return moved.select(*documents.columns), log.unionByName(changes)


# The typed slots of an attribute value.
SLOTS = {"text": "string", "number": "double", "date": "date", "flag": "boolean"}


def attribute_upsert(stored: DataFrame, rows: DataFrame, owner: str, code: str, order: Sequence[str] = ()) -> Change:
    """Upsert attribute values on (owner, code); a value sits in one of four typed slots.

    ``order`` decides among values for one owner and code, by columns of ``rows``; without one they are refused.
    """
    spec = TableSpec("attributes", [owner, code, *SLOTS])
    typed = stored.select(owner, code, *[F.col(s).cast(t).alias(s) for s, t in SLOTS.items()])
    if order:
        rows = _one_per_key(rows, [owner, code], order).select(owner, code, *SLOTS)
    return upsert(typed, rows, spec, [owner, code])


def attribute_table(stored: DataFrame, owner: str, code: str, attributes: Mapping[str, str]) -> DataFrame:
    """One row per owner, one column per attribute code, read from the attribute's slot."""
    columns = [
        F.max(F.when(F.col(code) == F.lit(name), F.col(slot))).alias(name)
        for name, slot in attributes.items()
    ]
    return stored.groupBy(owner).agg(*columns)


def sample_upsert(samples: DataFrame, rows: DataFrame, data_set: str, sample: str) -> Change:
    """Replace the rows of one named sample of a data set; all others stay."""
    named = (F.lower("data_set") == data_set.lower()) & (F.lower("sample") == sample.lower())
    incoming = rows.withColumns({"data_set": F.lit(data_set), "sample": F.lit(sample)}).select(*samples.columns)
    return Change(delete_where(samples, named).state.unionByName(incoming), incoming)

"""Logical data sets: declared fields over one source, one store, or several stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.functions.predicates import FILTERABLE, by_fields
from weftline.functions.transforms import chain
from weftline.operators.joins import join_frames
from weftline.operators.paging import page_with_more
from weftline.specs import DataSetSpec, FieldSpec, SourceSpec, resolve


def project_declared(df: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    """Only the declared, current, undeleted fields, in declared order.

    A field the source lacks reads NULL. A dotted physical name reaches into nested data.
    """
    columns = [_read(df, f) for f in fields if f.current and not f.deleted]
    if not columns:
        raise Refused("no current field is declared")
    return df.select(*columns)


def _read(df: DataFrame, spec: FieldSpec) -> Column:
    root = spec.physical.split(".")[0].lower()
    if root in {c.lower() for c in df.columns}:
        column = F.col(spec.physical)
    else:
        column = F.lit(None).cast(spec.data_type or "string")
    if spec.data_type is not None:
        column = column.cast(spec.data_type)
    column = chain(column, spec.steps)
    return column.alias(spec.name, metadata={FILTERABLE: spec.filterable, "level": spec.level})


def rename_fields(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Physical to logical names. Unmapped fields pass through, mapped physical names disappear.

    A nested field is lifted out of its struct, which keeps its other members and goes when none is left.
    """
    flat = {p: l for p, l in names.items() if "." not in p}
    nested = {p: l for p, l in names.items() if "." in p}
    lifted = df.withColumns({l: F.col(p) for p, l in nested.items()}) if nested else df
    for top in dict.fromkeys(resolve(df.columns, p.split(".")[0]) for p in nested):
        paths = [p.split(".", 1)[1] for p in nested if p.split(".")[0].lower() == top.lower()]
        gone = _emptied(df.schema[top].dataType, paths)
        lifted = lifted.drop(top) if gone is None else lifted.withColumn(top, F.col(top).dropFields(*gone))
    return lifted.withColumnsRenamed({resolve(df.columns, p): l for p, l in flat.items()})


def _emptied(struct: T.StructType, paths: Sequence[str]) -> list[str] | None:
    """The members to drop for these paths, a nested struct as a whole once nothing is left in it; None for all."""
    dropped, left = [], 0
    for member in struct.fields:
        inner = [p.split(".", 1)[1] for p in paths if "." in p and p.split(".")[0].lower() == member.name.lower()]
        if any(p.lower() == member.name.lower() for p in paths):
            dropped.append(member.name)
            continue
        below = _emptied(member.dataType, inner) if inner else []
        if below is None:
            dropped.append(member.name)
            continue
        left += 1
        dropped += [f"{member.name}.{b}" for b in below]
    return dropped if left else None


def read_source(frames: Mapping[str, DataFrame], source: SourceSpec) -> DataFrame:
    if source.name not in frames:
        raise Refused(f"unknown source {source.name!r}")
    frame = frames[source.name]
    return project_declared(frame, source.fields) if source.fields else frame


def _qualified(df: DataFrame, source: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{source}__{c}" for c in df.columns})


def joined_sources(spec: DataSetSpec, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Fold the join list; every field stays addressable as ``source__field``."""
    sources = {s.name: s for s in spec.sources}
    for join in spec.joins:
        for name in (join.left, join.right):
            if name not in sources:
                raise Refused(f"join names unknown source {name!r}")
    result = _qualified(read_source(frames, sources[spec.joins[0].left]), spec.joins[0].left)
    for join in spec.joins:
        right = _qualified(read_source(frames, sources[join.right]), join.right)
        pairs = [(f"{join.left}__{a}", f"{join.right}__{b}") for a, b in join.pairs]
        result = join_frames(result, right, pairs, join.how, join.hot)
    return result


def open_data_set(spec: DataSetSpec, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The lazy frame of a data set: joined, concatenated or read from its one source."""
    if spec.joins:
        joined = joined_sources(spec, frames)
        if not spec.output:
            raise Refused(f"joined data set {spec.name} declares no output fields")
        result = joined.select(*[F.col(f"{s}__{f}").alias(a) for s, f, a in spec.output])
    else:
        result = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [read_source(frames, s) for s in spec.sources],
        )
    return with_calculated(result, {c.name: c.formula for c in spec.calculated})


def open_named(name: str, specs: Mapping[str, DataSetSpec], frames: Mapping[str, DataFrame]) -> DataFrame:
    """A data set by name. Its sources may be data sets themselves, views of views to any depth."""
    return _open_named(name, specs, frames, ())


def _open_named(
    name: str, specs: Mapping[str, DataSetSpec], frames: Mapping[str, DataFrame], above: tuple[str, ...]
) -> DataFrame:
    known = {n.lower(): n for n in specs}
    if name.lower() not in known:
        raise Refused(f"unknown data set {name!r}")
    if name.lower() in above:
        raise Refused(f"data set {name!r} reads itself")
    spec = specs[known[name.lower()]]
    nested = {
        s.name: _open_named(s.name, specs, frames, (*above, name.lower()))
        for s in spec.sources
        if s.name not in frames and s.name.lower() in known
    }
    return open_data_set(spec, {**frames, **nested})


def query_data_set(
    spec: DataSetSpec,
    frames: Mapping[str, DataFrame],
    params: Mapping[str, str] | None = None,
    skip: int = 0,
    take: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Read a data set by field parameters, and a page of it when ``take`` is given.

    Filters name declared fields; they are set on the opened frame and Catalyst moves them to
    the sources. A page is ordered, by the data set's key where no order is stated.
    """
    rows = open_data_set(spec, frames)
    wanted = by_fields(params or {}, rows.schema)
    rows = rows if wanted is None else rows.where(wanted)
    return rows if take is None else page_with_more(rows, skip, take, order, spec.key)


def with_calculated(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Fields computed on read, as SQL expressions over the declared fields."""
    for name, formula in formulas.items():
        df = df.withColumn(name, F.expr(formula))
    return df


def union_all(*frames: DataFrame) -> DataFrame:
    """Concatenation of all sources' records; a field a source lacks reads NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def project_alias(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    return df.select(*[F.col(name).alias(alias) for name, alias in fields])

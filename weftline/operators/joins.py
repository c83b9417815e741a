"""Joins of sources, with the outer joins kept splittable when a key is hot."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.operators.heavy import Sketch, heavy_keys, heavy_pairs, salted_join, sketch_of, worth_a_sketch
from weftline.operators.lookup import lookup
from weftline.operators.windows import WindowColumn, running

KINDS = ("inner", "left", "right", "full")


def _on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(operator.and_, [left[a] == right[b] for a, b in pairs])


def _owner_keys(owners: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The distinct keys of the other side, under names of their own."""
    keys = owners.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)]).distinct()
    return keys, [(a, f"__k{i}") for i, (a, _) in enumerate(pairs)]


def _unmatched(side: DataFrame, other: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``side`` without a partner; the other side shrinks to its distinct keys first."""
    return lookup(side, *_owner_keys(other, pairs), "left_anti")


def join_frames(
    left: DataFrame,
    right: DataFrame,
    pairs: Sequence[tuple[str, str]],
    how: str = "inner",
    hot: bool | None = None,
    weigh: DataFrame | None = None,
    sketch: bool | None = None,
) -> DataFrame:
    """Equi-join on pairs of columns; the two frames share no column name.

    Adaptive execution splits a hot key on either side of an inner join, but on one side only of an outer join and on
    none of a full one. So the sides it can't split are looked at when an outer join is planned: a sketch of their keys
    finds the heavy ones, whose rows are dealt into cells inside the join (``heavy.salted_join``), those of a full join also
    by the pairs that both sides make. Without a heavy key it is the plain join. A side lighter than one skewed partition is not looked at, unless ``sketch`` says so, and none is
    if ``sketch`` is False. ``weigh`` stands in for a right side that is dear to evaluate: a frame with its key columns.

    Spark's full join holds all pairs of one key before it gives the first on, its inner join only those of one row. So a
    full join with more pairs than a task should make is the dealt inner join and the rows of either side that anti joins
    find unmatched; the sides are read again for these.

    ``hot`` is an older way, for keys of a type that a sketch can't hold: the join is the inner join and, under it, the
    rows an anti join finds unmatched, which reads the sides again. Said False, nothing is done about hot keys.
    """
    if how not in KINDS:
        raise Refused(f"unknown join type {how!r}")
    if not pairs:
        raise Refused("a join needs at least one pair of fields")
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise Refused(f"both sides of the join hold {sorted(shared)}")
    if hot:
        return _with_rest(left.join(right, _on(left, right, pairs), "inner"), left, right, pairs, how)
    if how != "inner" and hot is None and sketch is not False:
        ours, theirs = [a for a, _ in pairs], [b for _, b in pairs]
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        right_side = _sketch(right, theirs, sketch, weigh) if how in ("left", "full") else Sketch(0, {})
        left_side = _sketch(left, ours, sketch) if how in ("right", "full") else Sketch(0, {})
        if how == "full":
            of_left, of_right, tasks = heavy_pairs(left_side, right_side, partitions)
            if tasks > 1:
                matches = salted_join(left, right, pairs, "inner", of_left, of_right, tasks)
                return _with_rest(matches, left, right, pairs, how)
        else:
            of_left, of_right = heavy_keys(left_side, partitions), heavy_keys(right_side, partitions)
        if of_left or of_right:
            return salted_join(left, right, pairs, how, of_left, of_right)
    return left.join(right, _on(left, right, pairs), how)


def _sketch(side: DataFrame, keys: Sequence[str], sketch: bool | None, weigh: DataFrame | None = None) -> Sketch:
    return sketch_of(side if weigh is None else weigh, keys) if sketch or worth_a_sketch(side) else Sketch(0, {})


def _with_rest(matches: DataFrame, left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str) -> DataFrame:
    """The inner join's rows and those that an outer join pads."""
    result = matches
    if how in ("left", "full"):
        result = result.unionByName(_unmatched(left, right, pairs), allowMissingColumns=True)
    if how in ("right", "full"):
        flipped = [(b, a) for a, b in pairs]
        result = result.unionByName(_unmatched(right, left, flipped), allowMissingColumns=True)
    return result


def semi_join(df: DataFrame, owners: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose owner exists."""
    return lookup(df, *_owner_keys(owners, pairs), "left_semi")


def anti_join(df: DataFrame, other: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose key is not in the other set; a NULL key is in no set."""
    return _unmatched(df, other, pairs)


def sibling_join(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], declared: T.StructType, filter_on: Sequence[str] = ()
) -> DataFrame:
    """Join two containers of one folder; filter columns must be declared."""
    for name in filter_on:
        if name.lower() not in {f.lower() for f in declared.names}:
            raise Refused(f"filter column {name!r} is not declared")
    return join_frames(left, right, pairs)


def child_counts(
    parents: DataFrame, key: str, children: DataFrame, parent_key: str, name: str
) -> DataFrame:
    """Parents with the number of their children, 0 when none."""
    counts = children.groupBy(F.col(parent_key).alias("__parent")).agg(F.count(F.lit(1)).alias("__n"))
    joined = lookup(parents, counts, [(key, "__parent")])
    return joined.withColumn(name, F.coalesce("__n", F.lit(0))).drop("__n")


def scoped_overlay(
    definitions: DataFrame,
    code: str,
    row_id: str,
    for_tenant: object,
    for_organization: object | None = None,
    tenant: str = "tenant_id",
    organization: str = "organization_id",
    locked: str = "locked",
) -> DataFrame:
    """The definition in force per code for one tenant: the widest locked one, else the narrowest scope.

    Platform definitions have neither tenant nor organization, tenant ones no organization. Read are
    the platform's, the tenant's and, where an organization is named, that organization's; the filter reaches
    the scan. One best row per code is a minimum of structs, combined before the shuffle.
    """
    own = F.col(tenant) == F.lit(for_tenant)
    seen = (F.col(tenant).isNull() | own) & F.col(organization).isNull()
    if for_organization is not None:
        seen = seen | (own & (F.col(organization) == F.lit(for_organization)))
    definitions = definitions.where(seen)
    width = (
        F.when(F.col(tenant).isNull() & F.col(organization).isNull(), 0)
        .when(F.col(organization).isNull(), 1)
        .otherwise(2)
    )
    # A locked definition overrules narrower ones only, so among locked ones the widest wins.
    overrules = F.col(locked) & (width < 2)
    preference = F.struct(
        F.when(overrules, 0).otherwise(1).alias("a"),
        F.when(overrules, width).otherwise(-width).alias("b"),
        F.col(row_id).alias("c"),
    )
    rest = [c for c in definitions.columns if c != code]
    best = definitions.groupBy(code).agg(
        F.min(F.struct(preference.alias("__p"), *rest)).alias("__row")
    )
    return best.select(code, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*definitions.columns)


def parent_child(
    parents: DataFrame,
    key: str,
    children: DataFrame,
    parent_key: str,
    order: Sequence[str],
    into: str,
    block: int = 1000,
) -> DataFrame:
    """Owners with their children as ordered lists.

    A list holds at most ``block`` children; an owner with more gets further rows, numbered
    ``block_no``. So no task and no row ever holds an unbounded group.
    """
    placed = running(children, [parent_key], order, [WindowColumn("__place", "row_number")])
    body = [c for c in children.columns if c != parent_key]
    lists = (
        placed.withColumn("__block", F.floor((F.col("__place") - 1) / block))
        .groupBy(F.col(parent_key).alias("__parent"), "__block")
        .agg(F.array_sort(F.collect_list(F.struct("__place", *body))).alias("__items"))
    )
    bare = F.transform("__items", lambda i: F.struct(*[i[c].alias(c) for c in body]))
    empty = F.slice(F.array(F.struct(*[F.lit(None).cast(children.schema[c].dataType).alias(c) for c in body])), 1, 0)
    composed = lists.select("__parent", "__block", bare.alias(into))
    # An owner with very many children has many lists: it is heavy among the children as it is among the lists.
    owners = children.select(F.col(parent_key).alias("__parent"))
    joined = join_frames(parents, composed, [(key, "__parent")], "left", weigh=owners)
    return joined.select(
        *parents.columns,
        F.coalesce("__block", F.lit(0)).cast("long").alias("block_no"),
        F.coalesce(F.col(into), empty).alias(into),
    )

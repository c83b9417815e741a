"""Filter trees over declared fields, folded into one Column for Catalyst to split."""

from __future__ import annotations

import logging
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused

log = logging.getLogger(__name__)

FILTERABLE = "filterable"


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Group:
    """``all`` of the members, or ``any`` of them; members may be groups, to any depth."""

    mode: str
    members: Sequence[Condition | Group]


def all_of(*members: Condition | Group) -> Group:
    return Group("all", members)


def any_of(*members: Condition | Group) -> Group:
    return Group("any", members)


# contains, startswith and endswith take the term literally: % and _ are no wildcards here.
OPERATORS = {
    "equal": lambda c, v: c == v,
    "not_equal": lambda c, v: c != v,
    "greater": lambda c, v: c > v,
    "greater_or_equal": lambda c, v: c >= v,
    "less": lambda c, v: c < v,
    "less_or_equal": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "is_null": lambda c, _: c.isNull(),
    "is_not_null": lambda c, _: c.isNotNull(),
}


def _field(schema: T.StructType, name: str) -> T.StructField:
    for candidate in schema.fields:
        if candidate.name.lower() == name.lower():
            return candidate
    raise Refused(f"filter names unknown field {name!r}")


def build(node: Condition | Group, schema: T.StructType) -> Column:
    """The predicate of a filter tree. Unknown operators and unfilterable fields are refused."""
    if isinstance(node, Group):
        if node.mode not in ("all", "any"):
            raise Refused(f"unknown filter group {node.mode!r}")
        if not node.members:
            raise Refused("a filter group is empty")
        fold = operator.and_ if node.mode == "all" else operator.or_
        return reduce(fold, [build(member, schema) for member in node.members])
    if node.op not in OPERATORS:
        raise Refused(f"unknown filter operator {node.op!r}")
    target = _field(schema, node.field)
    if target.metadata.get(FILTERABLE) is False:
        raise Refused(f"field {target.name!r} is not filterable")
    return OPERATORS[node.op](F.col(target.name), node.value)


def by_fields(params: Mapping[str, str], schema: T.StructType) -> Column | None:
    """Named parameters as ANDed equals on declared fields, each value in its field's type.

    Names compare without case. A name that is no field is logged and ignored, an empty
    value is skipped. None when nothing is left to filter on.
    """
    declared = {f.name.lower(): f for f in schema.fields}
    terms = []
    for name, value in params.items():
        target = declared.get(name.lower())
        if target is None:
            log.warning("ignoring parameter %r: no such field", name)
        elif value is not None and value != "":
            if target.metadata.get(FILTERABLE) is False:
                raise Refused(f"field {target.name!r} is not filterable")
            terms.append(F.col(target.name) == F.lit(value).cast(target.dataType))
    return reduce(operator.and_, terms) if terms else None


def in_scope(scope: Column, value: object) -> Column:
    """Rows of one tenant, and the rows shared by all (no tenant)."""
    return (scope == F.lit(value)) | scope.isNull()


def current_rows(is_current: str = "IsCurrent", is_deleted: str = "IsDeleted") -> Column:
    return F.col(is_current) & ~F.col(is_deleted)

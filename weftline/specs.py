"""Declarations that operators are driven by. They hold no data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from weftline.errors import Refused, UnknownField


@dataclass(frozen=True)
class Step:
    """One transform of a field mapping; chains run by ``ordinal``."""

    ordinal: int
    kind: str
    params: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Param:
    """A transform parameter bound to another field instead of a constant."""

    name: str


@dataclass(frozen=True)
class FieldSpec:
    physical: str
    logical: str | None = None
    data_type: T.DataType | None = None
    filterable: bool = True
    current: bool = True
    deleted: bool = False
    level: str = "public"
    steps: Sequence[Step] = ()

    @property
    def name(self) -> str:
        return self.logical or self.physical


@dataclass(frozen=True)
class SourceSpec:
    """One input of a data set: the frame's name, the store it lives in, its fields."""

    name: str
    store: str = "main"
    fields: Sequence[FieldSpec] = ()
    unique_key: Sequence[str] = ()


@dataclass(frozen=True)
class JoinSpec:
    """A join of two sources; hot keys are found when it is planned. ``hot`` is passed to ``join_frames``."""

    left: str
    right: str
    pairs: Sequence[tuple[str, str]]
    how: str = "inner"
    hot: bool | None = None


@dataclass(frozen=True)
class Calculated:
    name: str
    formula: str


@dataclass(frozen=True)
class DataSetSpec:
    """A logical data set. ``output`` lists (source, field, alias) of a joined set."""

    name: str
    kind: str
    sources: Sequence[SourceSpec]
    joins: Sequence[JoinSpec] = ()
    output: Sequence[tuple[str, str, str]] = ()
    calculated: Sequence[Calculated] = ()
    key: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("simple", "compound", "federated"):
            raise Refused(f"data set {self.name}: unknown kind {self.kind!r}")
        if not self.sources:
            raise Refused(f"data set {self.name} has no source")
        if self.kind == "simple" and len(self.sources) != 1:
            raise Refused(f"simple data set {self.name} needs exactly one source")
        if self.kind == "compound" and len({s.store for s in self.sources}) != 1:
            raise Refused(f"compound data set {self.name} spans several stores")


@dataclass(frozen=True)
class Ordering:
    name: str
    descending: bool = False

    def column(self) -> Column:
        from pyspark.sql import functions as F

        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()


def ordering(*names: str | Ordering) -> list[Ordering]:
    """``"-x"`` orders by x descending."""
    result = []
    for name in names:
        if isinstance(name, Ordering):
            result.append(name)
        else:
            result.append(Ordering(name.removeprefix("-"), name.startswith("-")))
    return result


@dataclass(frozen=True)
class TableSpec:
    """A writable table: declared columns and its physical and logical keys."""

    name: str
    columns: Sequence[str]
    physical_key: str | None = None
    logical_key: Sequence[str] = ()

    def require(self, names: Sequence[str]) -> list[str]:
        """The declared spelling of each name; an undeclared one is refused by name."""
        declared = {c.lower(): c for c in self.columns}
        found = []
        for name in names:
            if name.lower() not in declared:
                raise UnknownField(f"table {self.name} does not declare column {name!r}")
            found.append(declared[name.lower()])
        return found


def resolve(names: Sequence[str], name: str, owner: str = "schema") -> str:
    """Find ``name`` among ``names`` ignoring case."""
    for candidate in names:
        if candidate.lower() == name.lower():
            return candidate
    raise UnknownField(f"{owner} does not declare field {name!r}")

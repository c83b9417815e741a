"""Formulas: expression trees of allow-listed nodes, and calculations over named inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import Refused


@dataclass(frozen=True)
class NodeType:
    name: str
    low: int
    high: int | None
    build: object


def _case_when(*args: Column) -> Column:
    result = F
    for i in range(0, len(args) - 1, 2):
        result = result.when(args[i], args[i + 1])
    return result.otherwise(args[-1]) if len(args) % 2 else result


def _round(value: Column, digits: Column | None = None) -> Column:
    return F.round(value) if digits is None else F.round(value, digits)


NODE_TYPES: dict[str, NodeType] = {
    n.name: n
    for n in (
        NodeType("+", 2, None, lambda *a: reduce(lambda x, y: x + y, a)),
        NodeType("-", 1, 2, lambda a, b=None: -a if b is None else a - b),
        NodeType("*", 2, None, lambda *a: reduce(lambda x, y: x * y, a)),
        NodeType("/", 2, 2, lambda a, b: a / b),
        NodeType("%", 2, 2, lambda a, b: a % b),
        NodeType("=", 2, 2, lambda a, b: a == b),
        NodeType("!=", 2, 2, lambda a, b: a != b),
        NodeType("<", 2, 2, lambda a, b: a < b),
        NodeType("<=", 2, 2, lambda a, b: a <= b),
        NodeType(">", 2, 2, lambda a, b: a > b),
        NodeType(">=", 2, 2, lambda a, b: a >= b),
        NodeType("and", 2, None, lambda *a: reduce(lambda x, y: x & y, a)),
        NodeType("or", 2, None, lambda *a: reduce(lambda x, y: x | y, a)),
        NodeType("not", 1, 1, lambda a: ~a),
        NodeType("case", 2, None, _case_when),
        NodeType("coalesce", 1, None, lambda *a: F.coalesce(*a)),
        NodeType("round", 1, 2, _round),
        NodeType("abs", 1, 1, F.abs),
        NodeType("upper", 1, 1, F.upper),
        NodeType("lower", 1, 1, F.lower),
        NodeType("concat", 1, None, lambda *a: F.concat(*a)),
        NodeType("nullif", 2, 2, F.nullif),
    )
}


@dataclass(frozen=True)
class FieldNode:
    name: str


@dataclass(frozen=True)
class ValueNode:
    value: object


@dataclass(frozen=True)
class CallNode:
    op: str
    args: Sequence[FieldNode | ValueNode | CallNode]


Node = FieldNode | ValueNode | CallNode


def field(name: str) -> FieldNode:
    return FieldNode(name)


def value(literal: object) -> ValueNode:
    return ValueNode(literal)


def call(op: str, *args: Node) -> CallNode:
    return CallNode(op, args)


def to_column(node: Node) -> Column:
    """The Column of a tree; an unlisted operation or a wrong number of arguments is refused."""
    if isinstance(node, FieldNode):
        return F.col(node.name)
    if isinstance(node, ValueNode):
        return F.lit(node.value)
    kind = NODE_TYPES.get(node.op)
    if kind is None:
        raise Refused(f"operation {node.op!r} is not allowed in a formula")
    if len(node.args) < kind.low or (kind.high is not None and len(node.args) > kind.high):
        raise Refused(f"operation {node.op!r} does not take {len(node.args)} arguments")
    return kind.build(*[to_column(a) for a in node.args])


def validate(node: Node, df: DataFrame) -> str:
    """Analyse the formula against a schema without running it; answers its type."""
    return df.select(to_column(node).alias("result")).schema["result"].dataType.simpleString()


def with_formulas(df: DataFrame, formulas: Mapping[str, Node]) -> DataFrame:
    for name, node in formulas.items():
        validate(node, df)
        df = df.withColumn(name, to_column(node))
    return df


@dataclass(frozen=True)
class CalculationEntity:
    """Named frame inputs and scalars, one statement, the field it yields."""

    name: str
    statement: str
    result_field: str
    scalars: Mapping[str, object]


def run_calculation(entity: CalculationEntity, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Bind inputs as relations and scalars as parameters; values never enter the text."""
    if not inputs:
        raise Refused(f"calculation {entity.name} has no input")
    spark = next(iter(inputs.values())).sparkSession
    result = spark.sql(entity.statement, args=dict(entity.scalars), **inputs)
    if entity.result_field not in result.columns:
        raise Refused(f"calculation {entity.name} does not yield field {entity.result_field!r}")
    return result

"""Heavy keys of a join's side, found by a sketch when the join is planned, and an outer join that deals them out.

Adaptive execution splits a skewed partition only on the preserved side of an outer join, and on neither side of a full
one. Here the rows of a heavy key are dealt into cells, and the other side's rows of that key are copied to each cell, inside
the one join. A copy that meets no row in its cell would be padded; but a heavy key is a key that the other side
certainly holds, so a padded copy is always one too many, and goes.

A key that both sides repeat makes pairs by the product of its rows, so little input may make many rows. Where both sides
are sketched, keys are dealt by their pairs too, and the join gets a task for each so many pairs, whatever its input weighs.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys a sketch reports, and keys it counts on the way.
REPORTED, TRACKED = 1000, 20_000
#: Cells to a partition: small ones even out.
CELLS = 4
#: Cells of evenly made pairs to a partition, where both sides of a join are dealt.
EVEN = 8 * CELLS
#: Pairs of rows that a task of a join may make.
PAIRS = 20_000_000
#: Key types that a sketch gives back exactly as they are.
_EXACT = (T.IntegralType, T.StringType, T.DateType, T.DecimalType, T.BooleanType)

Heavy = dict[tuple, int]


class Sketch(NamedTuple):
    """Rows with a complete key, and about how many of them each key holds that holds many."""

    rows: int
    keys: dict[tuple, int]

    def most_of_others(self) -> int:
        """Rows that a key not reported may hold: where all keys are reported, there is none."""
        return min(self.keys.values()) if len(self.keys) >= REPORTED else 0


def planned_bytes(df: DataFrame) -> int:
    """What the optimizer expects a frame to weigh; a scan weighs its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def worth_a_sketch(df: DataFrame) -> bool:
    """A side no heavier than one skewed partition can't hold one."""
    least = df.sparkSession.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    return planned_bytes(df) > _as_bytes(least)


def _as_bytes(size: str) -> int:
    """Spark's spelling of a size: ``256MB``, ``50kb``, ``1024b`` or a plain number."""
    text = size.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(text[-1:], 0)
    return int(text.rstrip("kmgtp") or 0) << unit


def sketch_of(df: DataFrame, keys: Sequence[str]) -> Sketch:
    """One pass over the key columns. At most REPORTED keys come to the driver. A key is found if it holds more than about
    one row in 5,000; every key given occurs. Keys of a type that a sketch can't give back exactly are not reported."""
    fields = [df.schema[k] for k in keys]
    if not all(isinstance(f.dataType, _EXACT) for f in fields):
        return Sketch(0, {})
    known = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).dropna()
    item = "k0" if len(keys) == 1 else "to_json(struct(*))"
    named = known.selectExpr(f"{item} AS item")
    seen = named.agg(F.expr(f"approx_top_k(item, {REPORTED}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = seen.select("n", F.inline("top"))
    if len(keys) > 1:
        kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
        found = found.select("n", "count", F.from_json("item", kinds).alias("item"))
    rows = found.collect()
    counts = {tuple(r["item"]) if len(keys) > 1 else (r["item"],): r["count"] for r in rows}
    return Sketch(rows[0]["n"] if rows else 0, counts)


def heavy_keys(side: Sketch, partitions: int) -> Heavy:
    """Keys with more rows than half a partition's share, and into how many cells each is dealt."""
    heavy: Heavy = {}
    for key, count in side.keys.items():
        if 2 * count * partitions > side.rows:
            cells = min(-(-CELLS * count * partitions // side.rows), CELLS * partitions)
            if cells > 1:
                heavy[key] = cells
    return heavy


def heavy_pairs(left: Sketch, right: Sketch, partitions: int) -> tuple[Heavy, Heavy, int]:
    """The heavy keys of both sides, dealt so that no cell makes more than its part of PAIRS, and how many tasks all pairs need.

    A key is cut on both sides, in the measure of its rows there, which copies fewest rows. A key that one side does not
    report is taken to hold as many rows there as it may.
    """
    of_left, of_right = heavy_keys(left, partitions), heavy_keys(right, partitions)
    made = {
        key: left.keys.get(key, left.most_of_others()) * right.keys.get(key, right.most_of_others()) for key in left.keys | right.keys
    }
    total = sum(made.values())
    for key, pairs in made.items():
        dealt = of_left.get(key, 1) * of_right.get(key, 1)
        cells = -(-CELLS * pairs // PAIRS)
        if key in of_left and key in of_right:
            # Where cells of the rows' size on both sides are more than evenness needs, fewer save copies.
            even = max(of_left.pop(key), of_right.pop(key), -(-EVEN * partitions * pairs // total))
            cells = max(cells, min(dealt, even))
        elif cells <= dealt:
            continue
        ours, theirs = left.keys.get(key, 0), right.keys.get(key, 0)
        if theirs:
            mine = math.ceil(math.sqrt(cells * ours / theirs)) if ours else 1
            of_left[key] = max(of_left.get(key, 1), min(mine, cells))
            of_right[key] = max(of_right.get(key, 1), -(-cells // of_left[key]))
        else:
            of_left[key] = cells
    return {k: n for k, n in of_left.items() if n > 1}, {k: n for k, n in of_right.items() if n > 1}, -(-total // PAIRS)


def _scatter(df: DataFrame, keys: Sequence[str]) -> Column:
    """A number that rows of one key differ in. It follows from the row alone, so a task that runs again deals alike;
    rows that are equal in all columns stay together."""
    rest = [f.name for f in df.schema if f.name not in keys and not _has_map(f.dataType)]
    return F.xxhash64(*rest) if rest else F.lit(0).cast("long")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def _marked(df: DataFrame, keys: Sequence[str], heavy: Heavy, kinds: Sequence[T.DataType], name: str) -> DataFrame:
    """``name``: the cells of a row's key, 1 for a key that is not heavy. The table of heavy keys is bounded by REPORTED."""
    if not heavy:
        return df.withColumn(name, F.lit(1))
    fields = [T.StructField(f"__h{i}", kind) for i, kind in enumerate(kinds)]
    rows = [(*key, cells) for key, cells in heavy.items()]
    table = df.sparkSession.createDataFrame(rows, T.StructType([*fields, T.StructField("__cells", T.IntegerType())]))
    same = reduce(operator.and_, [df[k] == table[f"__h{i}"] for i, k in enumerate(keys)])
    joined = df.join(F.broadcast(table), same, "left")
    return joined.withColumn(name, F.coalesce("__cells", F.lit(1))).drop("__cells", *[f.name for f in fields])


def salted_join(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str, of_left: Heavy, of_right: Heavy, tasks: int = 1
) -> DataFrame:
    """A join that deals the rows of heavy keys into cells; each side is read once.

    ``of_left`` and ``of_right`` are the heavy keys of the two sides: keys that certainly occur there. Rows without a
    complete key match nothing and are dealt out too. A join that needs more than one of ``tasks`` gets that many at least;
    adaptive execution would join them again, as it weighs what they read and not what they make. It is merged, as copies
    are not in the weight by which a side would be broadcast.
    """
    ours, theirs = [a for a, _ in pairs], [b for _, b in pairs]
    many = CELLS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, keys: list[str], own: Heavy, copied: Heavy, names: tuple[str, str, str]) -> DataFrame:
        """Adds a row's cell among its own side's, its cell among the other side's, and how often it was copied."""
        kinds = [df.schema[k].dataType for k in keys]
        cell, copy, copies = names
        missing = reduce(operator.or_, [F.col(k).isNull() for k in keys])
        marked = _marked(df, keys, own, kinds, "__own")
        cells = F.when(missing, F.lit(many)).otherwise(F.col("__own"))
        marked = marked.withColumn(cell, F.pmod(_scatter(df, keys), cells).cast("int")).drop("__own")
        if not copied:
            return marked.withColumns({copy: F.lit(0), copies: F.lit(1)})
        marked = _marked(marked, keys, copied, kinds, copies)
        return marked.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))

    mine = dealt(left, ours, of_left, of_right, ("__r_l", "__s_l", "__copied_l")).withColumn("__l", F.lit(True))
    other = dealt(right, theirs, of_right, of_left, ("__s_o", "__r_o", "__copied_o")).withColumn("__o", F.lit(True))
    if tasks > 1:
        tasks = max(tasks, many // CELLS)
        for a, b in pairs:
            kinds = mine.schema[a].dataType, other.schema[b].dataType
            if kinds[0] != kinds[1] and all(isinstance(k, T.IntegralType) for k in kinds):
                mine, other = mine.withColumn(f"__as_{a}", F.col(a).cast("long")), other.withColumn(f"__as_{b}", F.col(b).cast("long"))
        pairs = [(f"__as_{a}", f"__as_{b}") if f"__as_{a}" in mine.columns else (a, b) for a, b in pairs]
        mine = mine.repartition(tasks, *[a for a, _ in pairs], "__r_l", "__s_l")
        other = other.repartition(tasks, *[b for _, b in pairs], "__r_o", "__s_o").hint("merge")
    same = [mine[a] == other[b] for a, b in pairs] + [mine["__r_l"] == other["__r_o"], mine["__s_l"] == other["__s_o"]]
    joined = mine.join(other, reduce(operator.and_, same), how)
    needless = F.lit(False)
    if how in ("left", "full"):
        needless = needless | (F.col("__o").isNull() & (F.col("__copied_l") > 1))
    if how in ("right", "full"):
        needless = needless | (F.col("__l").isNull() & (F.col("__copied_o") > 1))
    return joined.where(~needless).select(*left.columns, *right.columns)

"""Data-quality rules. All rules of a table run in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators.windows import latest_per_key


@dataclass(frozen=True)
class Rule:
    """``NotNull``, or ``InRange`` with inclusive bounds; NULL is in every range."""

    name: str
    kind: str
    field: str
    severity: str = "Error"
    low: float | None = None
    high: float | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ("NotNull", "InRange"):
            raise Refused(f"unknown rule type {self.kind!r}")
        if self.kind == "InRange" and self.low is None and self.high is None:
            raise Refused(f"rule {self.name} states no bound")

    def violated(self) -> Column:
        value = F.col(self.field)
        if self.kind == "NotNull":
            return value.isNull()
        outside = F.lit(False)
        if self.low is not None:
            outside = outside | (value < F.lit(self.low))
        if self.high is not None:
            outside = outside | (value > F.lit(self.high))
        return F.coalesce(outside, F.lit(False))


def check_all(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per enabled rule: checked, violations, passed. A single aggregate over the table."""
    active = [r for r in rules if r.enabled]
    if not active:
        raise Refused("no rule is enabled")
    counts = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(r.violated()).alias(f"v{i}") for i, r in enumerate(active)],
    )
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.field).alias("field"),
            F.lit(r.severity).alias("severity"),
            F.col("checked"),
            F.col(f"v{i}").alias("violations"),
            (F.col(f"v{i}") == 0).alias("passed"),
        )
        for i, r in enumerate(active)
    ]
    return counts.select(F.inline(F.array(*rows)))


def check(df: DataFrame, rule: Rule) -> DataFrame:
    return check_all(df, [rule])


def dashboard(executions: DataFrame) -> DataFrame:
    """Latest execution of every rule, counted by severity and outcome."""
    latest = latest_per_key(executions, ["rule"], ["executed_at", "execution_id"])
    return latest.groupBy("severity", "passed").agg(F.count(F.lit(1)).alias("rules"))


def failures(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows to quarantine, each with the rules it breaks."""
    broken = F.array_compact(F.array(*[F.when(r.violated(), F.lit(r.name)) for r in rules if r.enabled]))
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)

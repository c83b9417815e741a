"""Versions compared by digests: the same answer as a whole comparison, and nothing moved for what is alike."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import governance, setops
from weftline.operators.digests import differing

VALUES = st.one_of(st.none(), st.sampled_from(["", "a", "b", "A"]))
TABLE = st.dictionaries(st.integers(0, 12), st.tuples(VALUES, VALUES), max_size=10)
SCHEMA = "k long, x string, y string"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TABLE, TABLE)
def test_audit_equals_the_whole_comparison(spark, before, after):
    frames = [spark.createDataFrame([(k, *v) for k, v in t.items()], SCHEMA) for t in (before, after)]
    got = governance.audit_changes(*frames, ["k"], ["x", "y"])
    want = []
    for k in before.keys() | after.keys():
        for i, name in enumerate("xy"):
            old, new = before.get(k, (None, None))[i], after.get(k, (None, None))[i]
            if old != new:
                want.append((k, name, old, new))
    found = [(r["k"], r["field"], r["old_value"], r["new_value"]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def stacked(before, after):
    return before.withColumn("side", F.lit(-1)).unionByName(after.withColumn("side", F.lit(1)))


def test_only_parts_that_differ_are_left(spark):
    before = spark.range(0, 20000, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"))
    assert differing(stacked(before, before.repartition(3)), "side", ["k"], ["x"], 256).count() == 0
    after = before.withColumn("x", F.when(F.col("k") == 77, -1).otherwise(F.col("x")))
    left = differing(stacked(before, after), "side", ["k"], ["x"], 256)
    assert left.where("k = 77").count() == 2 and left.count() < 400


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ([(1, None, "a")], [(1, "a", None)]),  # a value that moves past a NULL
        ([(1, "a", "b")], [(1, "b", "a")]),
        ([(1, "a", "b"), (1, "a", "b")], [(1, "a", "b")]),  # repeated rows count
        ([(1, "a", "a"), (2, "b", "b")], [(1, "b", "b"), (2, "a", "a")]),  # values that change places
        ([(None, "a", "a")], [(None, "a", "b")]),
        ([], [(None, None, None)]),
    ],
)
def test_what_differs_is_seen(spark, before, after):
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (before, after))
    assert differing(stacked(a, b), "side", ["k"], ["x", "y"], 1).count() == len(before) + len(after)
    assert differing(stacked(a, a), "side", ["k"], ["x", "y"], 1).count() == 0


def test_names_that_repeat_on_one_side_are_no_change(spark):
    a, b = (spark.createDataFrame([(n,) for n in names], "name string") for names in ("aabC", "abd"))
    got = sorted(tuple(r) for r in setops.schema_diff(a, b, "name").collect())
    assert got == [("c", "removed"), ("d", "added")]
    assert setops.schema_diff(a, a, "name").count() == 0

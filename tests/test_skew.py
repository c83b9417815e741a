"""Plans under skew: with one key holding a third of all rows, the join is split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators import heavy, joins, writes
from weftline.operators.lookup import lookup
from weftline.specs import TableSpec

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture
def tight(spark):
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key in SMALL:
        spark.conf.unset(key)


@pytest.fixture
def hot(tight):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20000)
    return tight.range(0, 600000, 1, 8).select(key.alias("k"), "id")


def is_split(df):
    """Whether the final plan splits a skewed partition."""
    checked = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.sum(F.col("h").cast("decimal(20,0)")))
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString()
    return "skew=true" in plan.split("Initial Plan")[0]


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_splits_the_hot_key(hot, how, null_safe):
    keys = hot.select((F.col("k") * 2).alias("k2")).distinct().withColumn("v", F.col("k2") + 1)
    assert is_split(lookup(hot, keys, [("k", "k2")], how, null_safe))


def test_outer_joins_split_the_side_that_repeats_its_key(tight, hot):
    unique = tight.range(0, 30000, 1, 8).select(F.col("id").alias("u"))
    assert is_split(joins.join_frames(unique, hot, [("u", "k")], "left", hot=True))
    assert is_split(joins.join_frames(hot, unique, [("k", "u")], "full", hot=True))


def spread_of(df):
    """Rows of the result in each task that has some: the largest number and the median."""
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1], sizes[len(sizes) // 2]


@pytest.fixture
def uncoalesced(tight):
    tight.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tight.conf.set("spark.sql.shuffle.partitions", "16")
    yield tight
    tight.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tight.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_deal_out_a_hot_key_that_nobody_declared(uncoalesced, hot, how):
    unique = uncoalesced.range(0, 30000, 1, 8).select(F.col("id").alias("u"))
    sides = (hot, unique, [("k", "u")]) if how == "right" else (unique, hot, [("u", "k")])
    joined = joins.join_frames(*sides, how)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # The two ranges, and the table of heavy keys, are each read once a side.
    assert plan.count("Range (") == 2
    most, median = spread_of(joined)
    assert most < 2 * median
    plain, _ = spread_of(joins.join_frames(*sides, how, sketch=False))
    assert plain > 3 * median
    assert joined.count() == 600000 + 10000


def test_a_full_join_deals_out_hot_keys_of_both_sides(uncoalesced):
    left = uncoalesced.range(0, 4000, 1, 4).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("a"), F.col("id").alias("x"))
    right = uncoalesced.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 5000).otherwise(F.col("id")).alias("b"), F.col("id").alias("y"))
    joined = joins.join_frames(left, right, [("a", "b")], "full", sketch=True)
    expected = left.join(right, left["a"] == right["b"], "full")
    assert joined.exceptAll(expected).count() == expected.exceptAll(joined).count() == 0
    most, median = spread_of(joined)
    assert most < 2 * median


CASES = [
    # Hot on the left, on the right, on both, nowhere; NULL keys; repeated rows; keys of one side alone.
    ([7] * 40 + [1, 2, 3], [7, 1, 9]),
    ([7, 1, 9], [7] * 40 + [1, 2, 3]),
    ([7] * 15 + [8] * 15 + [1], [7] * 12 + [9] * 20 + [1, 1]),
    ([None] * 30 + [1, 2], [None] * 30 + [2, 2, 3]),
    ([], [7] * 40),
    ([7] * 40, []),
    ([1, 2, 3], [4, 5, 6]),
]


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("case", CASES)
def test_salted_joins_equal_plain_ones(spark, case, how):
    left = spark.createDataFrame([(k, i % 3) for i, k in enumerate(case[0])], "a int, x int")
    right = spark.createDataFrame([(k, f"v{i % 4}", {"m": 1}) for i, k in enumerate(case[1])], "b long, y string, z map<string,int>")
    joined = joins.join_frames(left, right, [("a", "b")], how, sketch=True)
    plain = joins.join_frames(left, right, [("a", "b")], how, sketch=False)
    assert joined.columns == plain.columns
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))


def test_keys_are_dealt_by_the_pairs_they_make():
    # Two partitions hold 25 even keys well by their rows, but not what both sides make of them.
    ours, theirs = (heavy.Sketch(25 * n, {(k,): n for k in range(25)}) for n in (40_000, 400_000))
    of_left, of_right, tasks = heavy.heavy_pairs(ours, theirs, 2)
    made = 25 * 40_000 * 400_000
    assert tasks == made // heavy.PAIRS
    for k in range(25):
        assert 40_000 * 400_000 / (of_left[k,] * of_right[k,]) <= heavy.PAIRS / heavy.CELLS
        assert of_left[k,] < of_right[k,]
    assert heavy.heavy_pairs(heavy.Sketch(0, {}), heavy.Sketch(0, {}), 8) == ({}, {}, 0)


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_a_full_join_gets_tasks_for_the_pairs_it_makes(spark, monkeypatch, kind):
    monkeypatch.setattr(heavy, "PAIRS", 2000)
    left = spark.range(0, 300, 1, 2).selectExpr(f"cast(if(id % 50 = 0, null, id % 10) AS {kind}) AS a", "id AS x")
    right = spark.range(0, 1000, 1, 2).selectExpr(f"cast(id % 11 AS {'long' if kind == 'int' else kind}) AS b", "id AS y")
    joined = joins.join_frames(left, right, [("a", "b")], "full", sketch=True)
    plain = joins.join_frames(left, right, [("a", "b")], "full", sketch=False)
    assert joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    # Adaptive execution would join so little input in one task.
    assert len(sizes) >= 13 and max(sizes) < 8 * 2000


@pytest.mark.parametrize("case", [*CASES, ([7, 7, 8, 8] * 9 + [5, None], [7, 8, 8] * 9 + [6, 6, None])])
def test_a_full_join_of_many_pairs_equals_the_plain_one(spark, monkeypatch, case):
    monkeypatch.setattr(heavy, "PAIRS", 20)
    left = spark.createDataFrame([(k, i % 3) for i, k in enumerate(case[0])], "a int, x int")
    right = spark.createDataFrame([(k, f"v{i % 4}", {"m": 1}) for i, k in enumerate(case[1])], "b long, y string, z map<string,int>")
    joined = joins.join_frames(left, right, [("a", "b")], "full", sketch=True)
    plain = joins.join_frames(left, right, [("a", "b")], "full", sketch=False)
    assert [(f.name, f.dataType) for f in joined.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))


def test_a_full_join_does_not_hold_all_pairs_of_a_key(spark, monkeypatch):
    # Spark's full join gives no row on before it has made all pairs of a key; its inner join none before all of one row.
    def plan(pairs):
        monkeypatch.setattr(heavy, "PAIRS", pairs)
        left = spark.range(0, 300, 1, 2).selectExpr("id % 10 AS a", "id AS x")
        right = spark.range(0, 1000, 1, 2).selectExpr("id % 11 AS b", "id AS y")
        return joins.join_frames(left, right, [("a", "b")], "full", sketch=True)._jdf.queryExecution().executedPlan().toString()

    assert "FullOuter" in plan(10**9)
    assert "FullOuter" not in plan(2000) and "SortMergeJoin" in plan(2000)


@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,2)", "boolean", "double"])
def test_salted_joins_by_keys_of_many_types(spark, kind):
    def side(names, n):
        value = {"date": "date_add(DATE'2020-01-01', k)", "boolean": "k = 0"}.get(kind, f"cast(k AS {kind})")
        rows = spark.range(n).selectExpr("CAST(IF(id % 2 = 0, 0, id % 11) AS int) AS k", "id AS v")
        return rows.selectExpr(f"{value} AS {names[0]}", f"concat('p', v % 3) AS {names[1]}", f"v AS {names[2]}")

    left, right = side("abc", 60), side("xyz", 90).where("z % 11 <> 3")
    for pairs in ([("a", "x")], [("a", "x"), ("b", "y")]):
        joined = joins.join_frames(left, right, pairs, "full", sketch=True)
        plain = joins.join_frames(left, right, pairs, "full", sketch=False)
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))


def test_owners_of_very_many_children_are_dealt_out(uncoalesced):
    owners = uncoalesced.range(0, 300).select(F.col("id").alias("o"))
    children = uncoalesced.range(0, 40000, 1, 4).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 250).alias("p"), F.col("id").alias("c"))
    made = joins.parent_child(owners, "o", children, "p", ["c"], "items", block=10)
    assert made.select(F.explode("items.c")).distinct().count() == 40000
    assert made.where("size(items) = 0").count() == 50
    most, median = spread_of(made)
    assert most < 2.5 * median


def test_writes_split_a_hot_key_of_the_table(tight, hot):
    rows = tight.range(0, 30000, 2, 8).select(F.col("id").alias("k"), (-F.col("id")).alias("id"))
    spec = TableSpec("t", ["k", "id"])
    assert is_split(writes.upsert(hot, rows, spec, ["k"]).state)


def test_lookup_joins_keys_of_different_integer_types(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "b long, v string")
    assert sorted(lookup(left, right, [("a", "b")]).collect(), key=repr) == [(1, "x"), (2, None), (None, None)]
    assert lookup(left, right, [("a", "b")], "inner", null_safe=True).count() == 2

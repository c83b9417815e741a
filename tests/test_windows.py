"""Chunked windows against Spark's own, on a table whose one key holds a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators import windows
from weftline.operators.spread import hot_keys, split_hot, with_chunks
from weftline.operators.windows import WindowColumn
from weftline.specs import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.4 else (None if rng.random() < 0.1 else f"k{rng.randrange(300)}")
        at = None if rng.random() < 0.05 else (5 if rng.random() < 0.3 else rng.randrange(100))
        text = None if rng.random() < 0.05 else rng.choice(["Customer#1", "Customer#2", "a", "é"]) + str(rng.randrange(50))
        amount = None if rng.random() < 0.1 else rng.randrange(1000)
        rows.append((i, key, at, text, amount, 1, "same"))
    return spark.createDataFrame(rows, "id long, key string, at int, text string, amount long, one int, two string").repartition(4).cache()


def expected(df, partition, order, function, column, offset):
    window = Window.partitionBy(*partition).orderBy(*[o.column() for o in ordering(*order)])
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if function in ("row_number", "rank", "dense_rank"):
        return df.withColumn("want", getattr(F, function)().over(window).cast("long"))
    if function in ("lag", "lead"):
        return df.withColumn("want", getattr(F, function)(column, offset).over(window))
    return df.withColumn("want", getattr(F, function)(column).over(running))


CASES = [
    (["key"], ["at", "id"]),
    (["key"], ["-at", "-id"]),
    (["key"], ["-text", "id"]),
    ([], ["-at", "id"]),
    ([], ["text", "id"]),
    (["key"], ["one", "two", "id"]),
]


@pytest.mark.parametrize(("partition", "order"), CASES, ids=str)
def test_running(skewed, partition, order):
    columns = [WindowColumn("row_number", "row_number")]
    columns += [WindowColumn(f, f, "amount") for f in ("sum", "avg", "min", "max", "count")]
    got = windows.running(skewed, partition, order, columns, most=60).cache()
    for column in columns:
        want = expected(got, partition, order, column.function, column.column, 1)
        assert want.where(~F.col("want").eqNullSafe(F.col(column.name))).count() == 0, column
    assert got.count() == skewed.count()


@pytest.mark.parametrize(("partition", "order"), [(["key"], ["at"]), (["key"], ["-text", "at"]), ([], ["at"])], ids=str)
def test_ranking(skewed, partition, order):
    columns = [WindowColumn("rank", "rank"), WindowColumn("dense_rank", "dense_rank")]
    got = windows.ranking(skewed, partition, order, columns, most=60).cache()
    for column in columns:
        want = expected(got, partition, order, column.function, None, 1)
        assert want.where(~F.col("want").eqNullSafe(F.col(column.name))).count() == 0
    assert got.count() == skewed.count()


SHIFTS = [
    (["key"], ["at", "id"], "lag", 1),
    (["key"], ["-at", "-id"], "lead", 1),
    (["key"], ["-at", "-id"], "lag", 1),
    (["key"], ["-at", "id"], "lag", 1),
    (["key"], ["at", "id"], "lead", 3),
    ([], ["at", "id"], "lead", 1),
    ([], ["at", "id"], "lag", 3),
]


@pytest.mark.parametrize(("partition", "order", "function", "offset"), SHIFTS, ids=str)
def test_shifting(skewed, partition, order, function, offset):
    column = WindowColumn("got", function, "amount", offset)
    got = windows.shifted(skewed, partition, order, column, most=60).cache()
    want = expected(got, partition, order, function, "amount", offset)
    assert want.where(~F.col("want").eqNullSafe(F.col("got"))).count() == 0
    assert got.count() == skewed.count()


def test_only_hot_keys_are_cut(skewed):
    assert [r[0] for r in hot_keys(skewed, ["key"], 300).collect()] == ["hot"]
    plain, hot = split_hot(skewed, ["key"], 300)
    assert plain.where("key = 'hot'").count() == 0 and hot.where("key = 'hot'").count() == hot.count() > 300
    assert hot_keys(skewed, ["key"]).count() == 0 and split_hot(skewed, ["key"])[1] is None


@pytest.mark.parametrize("order", [["at", "id"], ["one", "two", "id"]])
def test_no_chunk_holds_more_than_its_share(skewed, order):
    """Also where the first two order columns tie for every row."""
    cut = with_chunks(skewed.where("key = 'hot'"), ["key"], ordering(*order), 50).cache()
    sizes = [r["count"] for r in cut.groupBy("__chunk").count().collect()]
    assert max(sizes) == 50 and len(sizes) > 10
    ranges = skewed.where("key = 'hot'").repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count()
    assert ranges.agg(F.max("count")).first()[0] < cut.count() / 3


def test_one_scan_and_one_window_when_nothing_is_hot(skewed):
    got = windows.running(skewed, ["key"], ["at", "id"], [WindowColumn("s", "sum", "amount")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and plan.count("Window ") == 1 and "Join" not in plan


def test_sums_of_floating_numbers_do_not_depend_on_the_cluster(spark, skewed):
    floats = skewed.withColumn("f", F.col("amount") / 7)
    column = [WindowColumn("s", "sum", "f"), WindowColumn("a", "avg", "f")]
    seen = []
    for partitions in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        seen.append(sorted(tuple(r) for r in windows.running(floats, ["key"], ["at", "id"], column, most=60).select("id", "s", "a").collect()))
    assert seen[0] == seen[1]


def test_numbers_follow_the_order_without_gaps(skewed):
    got = windows.number_rows(skewed, ["text", "id"], "n", start=10)
    numbers = got.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(numbers) == (11, 1510, 1500)


def test_number_rows_of_an_empty_frame(skewed):
    assert windows.number_rows(skewed.where("id < 0"), ["id"], "n").count() == 0


def test_period_over_period_skips_missing_months(spark):
    df = spark.createDataFrame([("2024-01-10", 10.0), ("2024-03-01", 30.0), ("2025-01-05", 20.0)], "d string, v double")
    df = df.select(F.to_date("d").alias("d"), "v")
    got = {str(r["period"]): r for r in windows.period_over_period(df, "d", F.sum("v")).collect()}
    assert got["2024-03-01"]["previous_month"] is None
    assert got["2025-01-01"]["previous_year"] == 10.0 and got["2025-01-01"]["percent_year"] == 100.0


def test_unknown_function_is_refused():
    with pytest.raises(Refused):
        WindowColumn("x", "median")

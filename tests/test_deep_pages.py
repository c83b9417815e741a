"""Deep pages by rank selection: the rows of a whole sort, from few sorted rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import paging
from weftline.specs import ordering


@pytest.fixture
def shallow(monkeypatch):
    """Pages are deep beyond ten rows."""
    monkeypatch.setattr(paging, "DEEP", 10)
    monkeypatch.setattr(paging, "SAMPLE", 64)
    monkeypatch.setattr(paging, "CUTS", 8)


ROWS = [(rnd.choice([None, 1, 2, 2, 2, 5]), rnd.choice([None, "a", "b", "é", ""]), rnd.choice([None, 0.5, -1.0, float("nan")]), i) for rnd in [random.Random(2)] for i in range(700)]


@pytest.mark.parametrize("order", [["a", "b", "i"], ["-a", "b", "-i"], ["b", "-c", "i"], ["-c", "-b", "-a", "i"], ["i"], ["-i"]])
def test_deep_pages_equal_a_whole_sort(spark, shallow, order):
    df = spark.createDataFrame(ROWS, "a int, b string, c double, i long").repartition(4)
    whole = [r["i"] for r in df.orderBy(*[o.column() for o in ordering(*order)]).collect()]
    for skip, take in ((0, 25), (300, 1), (333, 40), (690, 50), (900, 5), (100, 600)):
        assert [r["i"] for r in paging.page(df, skip, take, order).collect()] == whole[skip : skip + take]


def test_repeated_rows_and_types_without_a_literal(spark, shallow):
    same = spark.createDataFrame([(1,)] * 300 + [(2,)] * 5, "k int")
    assert [r["k"] for r in paging.page(same, 295, 20, ["k"]).collect()] == [1] * 5 + [2] * 5
    times = spark.range(200).select(F.timestamp_seconds(F.col("id") * 7).alias("t"), "id")
    assert [r["id"] for r in paging.page(times, 150, 10, ["t"]).collect()] == list(range(150, 160))
    assert paging.page(same.where("k > 5"), 50, 5, ["k"]).count() == 0


def test_few_rows_are_sorted_for_a_page_far_down(spark):
    df = spark.range(0, 1_300_000, 1, 8).select((F.col("id") * 7919 % 1_300_021).alias("k"), F.col("id").alias("v"))
    order = ordering("k")
    around, before = paging._ranges_of(df, 1_000_000, 50, order)
    assert before <= 1_000_000 and around.count() < 50 + 2 * paging.DEEP
    got = [r["k"] for r in paging.page(df, 1_000_000, 50, ["k"]).collect()]
    assert got == sorted(7919 * i % 1_300_021 for i in range(1_300_000))[1_000_000:1_000_050]

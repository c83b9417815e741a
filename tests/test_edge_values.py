"""Values that a careless comparison, conversion or page would get wrong."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators import aggregates, datasets, governance, lineage, paging, search, vectors, writes
from weftline.operators.writes import SoftDelete
from weftline.sources import sinks
from weftline.specs import TableSpec

PLAIN = "0f8fad5b-d9cb-469f-a165-70867728950e"
VERSIONED = TableSpec("v", ["RowId", "Id", "Name", "IsCurrent", "IsDeleted"], "RowId", ["Id"])


@pytest.fixture
def stored(spark):
    rows = [(1, "7", "seven", True, False), (2, PLAIN, "guid", True, False), (3, "x1", "text", True, False)]
    return spark.createDataFrame(rows, "RowId long, Id string, Name string, IsCurrent boolean, IsDeleted boolean")


@pytest.fixture
def otherwise(spark):
    rows = [(" 007", "s"), ("{" + PLAIN.upper() + "}", "g"), ("X1", "t")]
    return spark.createDataFrame(rows, "Id string, Name string")


def test_a_saved_version_closes_every_spelling_of_its_id(stored, otherwise):
    state = writes.version_save(stored, otherwise, VERSIONED, ["Name"]).state
    current = [r["Name"] for r in state.where("IsCurrent").collect()]
    assert sorted(current) == ["g", "s", "t"] and state.count() == 6


def test_one_save_with_two_spellings_leaves_one_current_row(spark, stored):
    twice = spark.createDataFrame([("07", "a"), ("7", "b"), ("+7", "c")], "Id string, Name string")
    state = writes.version_save(stored, twice, VERSIONED, ["Name"]).state
    assert [r["Name"] for r in state.where("IsCurrent AND Name IN ('seven', 'a', 'b', 'c')").collect()] == ["c"]


def test_retire_and_soft_delete_find_every_spelling(spark, stored, otherwise):
    assert writes.version_retire(stored, otherwise.select("Id"), VERSIONED).written.count() == 3
    absent = writes.soft_delete(stored, VERSIONED, SoftDelete("IsDeleted", absent_keys=["Id"]), source=otherwise.where("Name <> 't'"))
    assert [r["RowId"] for r in absent.written.collect()] == [3]
    numbers = spark.createDataFrame([(7,), (8,)], "Id long")
    assert [r["RowId"] for r in writes.version_retire(stored, numbers, VERSIONED).written.collect()] == [1]


def test_text_that_is_no_number_stays_text(spark):
    spec = TableSpec("t", ["k", "n"])
    table = spark.createDataFrame([("1.0", 1), ("99999999999999999999", 2), ("", 3), (None, 4)], "k string, n int")
    new = spark.createDataFrame([("1", 5), ("099999999999999999999", 6), ("", 7), (None, 8)], "k string, n int")
    assert sorted(r["n"] for r in writes.upsert(table, new, spec, ["k"]).state.collect()) == [1, 2, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("write", [writes.upsert, writes.insert_if_new])
def test_equal_source_keys_need_an_order(spark, write):
    spec = TableSpec("t", ["k", "n"])
    table = spark.createDataFrame([("a", 0)], "k string, n int")
    new = spark.createDataFrame([("B", 1), ("b", 2), (None, 3), (None, 4)], "k string, n int")
    with pytest.raises(Exception, match="several rows hold one key"):
        write(table, new, spec, ["k"]).state.collect()
    assert sorted(r["n"] for r in write(table, new, spec, ["k"], ["n"]).state.collect()) == [0, 2, 3, 4]


def test_equal_attributes_need_an_order(spark):
    schema = "owner int, code string, text string, number double, date date, flag boolean"
    stored = spark.createDataFrame([], schema)
    new = spark.createDataFrame([(1, "size", None, 3.0, None, None, 1), (1, "SIZE", None, 4.0, None, None, 2)], schema + ", at int")
    with pytest.raises(Exception, match="several rows"):
        writes.attribute_upsert(stored, new.drop("at"), "owner", "code").state.collect()
    assert [r["number"] for r in writes.attribute_upsert(stored, new, "owner", "code", ["at"]).state.collect()] == [4.0]


def test_members_beside_a_renamed_one_stay(spark):
    df = spark.sql("SELECT 'q7' AS id, named_struct('mag', 4.25, 'place', 'here', 'deep', named_struct('a', 1, 'b', 2)) AS p, named_struct('only', 1) AS o")
    got = datasets.rename_fields(df, {"p.mag": "Magnitude", "p.deep.a": "A", "o.only": "Only", "id": "Key"})
    assert got.columns == ["Key", "p", "Magnitude", "A", "Only"]
    assert got.select("p.*").columns == ["place", "deep"] and got.select("p.deep.*").columns == ["b"]
    gone = datasets.rename_fields(df, {"p.deep.a": "A", "p.deep.b": "B"})
    assert gone.select("p.*").columns == ["mag", "place"]


def test_statistics_of_large_integers_are_exact(spark):
    big = 2**53
    df = spark.createDataFrame([(big, 1), (big + 1, 1), (big + 2, 1), (2**63 - 1, 2), (2**63 - 1, 2)], "x long, g int")
    got = {r["g"]: r for r in aggregates.stat_set(df, ["x"], ["g"]).collect()}
    assert got[1]["distinct_values"] == 3 and int(got[1]["sum_value"]) == 3 * big + 3 and int(got[1]["max_value"]) == big + 2
    assert got[2]["distinct_values"] == 1 and int(got[2]["sum_value"]) == 2 * (2**63 - 1)


def test_statistics_of_mixed_types_are_exact(spark):
    big = 2**53
    df = spark.createDataFrame([(big, 0.5), (big + 1, 0.5), (big + 2, None)], "x long, y double")
    got = {r["column"]: (r["n"], r["nulls"], r["distinct_values"]) for r in aggregates.stat_set(df, ["x", "y"]).collect()}
    assert got == {"x": (3, 0, 3), "y": (2, 1, 1)}


def test_integers_beside_floating_numbers_keep_their_digits(spark):
    big = 2**53
    df = spark.createDataFrame([(big, 0.5), (big + 1, 0.5), (big + 1, None)], "x long, y double")
    got = {r["column"]: r for r in aggregates.stat_set(df, ["x", "y"]).collect()}
    assert [int(got["x"][c]) for c in ("min_exact", "max_exact", "sum_exact")] == [big, big + 1, 3 * big + 2]
    assert [got["y"][c] for c in ("min_value", "max_value", "sum_value", "sum_exact")] == [0.5, 0.5, 1.0, None]
    assert "sum_exact" not in aggregates.stat_set(df, ["x"]).columns


def test_deep_pages_come_in_order(spark):
    df = spark.range(0, 30000, 1, 5).select((F.col("id") * 7919 % 30011).alias("k"))
    want = sorted(7919 * i % 30011 for i in range(30000))
    got = [r["k"] for r in paging.page(df, 12000, 9000, ["-k"]).collect()]
    assert got == want[::-1][12000:21000]
    tail = paging.page_with_more(df, 25000, 6000, ["k"], []).collect()
    assert [r["k"] for r in tail] == want[25000:] and {r["has_more"] for r in tail} == {False}
    assert {r["has_more"] for r in paging.page_with_more(df, 20000, 10, ["k"]).collect()} == {True}


def test_blank_terms_are_refused(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    for term in ("", " ", "\t"):
        with pytest.raises(Refused):
            search.find_text(df, term)


def test_a_repeated_id_cannot_close_a_cycle(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (2, 3, "again")], "id int, parent_id int, name string")
    with pytest.raises(Refused, match="held 2 times"):
        lineage.tree_paths(nodes)


def test_an_insert_stops_at_its_first_failure(spark):
    df = spark.range(0, 40, 1, 4)

    def send(stream, number, rows):
        if rows[0]["id"] >= 10:
            raise ValueError("full")

    receipts = sinks.send_in_batches(df, ["id"], 5, send).collect()
    assert [(r["batch"], r["rows"], r["error"]) for r in sorted(receipts, key=lambda r: r["batch"])] == [(0, 5, None), (1, 5, None), (2, 0, "full")]


def test_audit_says_who_when_and_keeps_to_a_tenant(spark):
    before = spark.createDataFrame([(1, 10, "a", "x"), (2, 20, "b", "x"), (3, 10, "c", "x")], "id int, tenant int, name string, by string")
    after = spark.createDataFrame([(1, 10, "A", "ann"), (2, 20, "B", "bo")], before.schema)
    got = governance.audit_changes(before, after, ["id"], ["name"], F.col("by"), F.lit("noon"), "tenant", 10).collect()
    assert sorted((r["id"], r["tenant"], r["changed_by"], r["changed_at"], r["old_value"], r["new_value"]) for r in got) == [
        (1, 10, "ann", "noon", "a", "A"),
        (3, 10, None, None, "c", None),
    ]
    with pytest.raises(Refused, match="tenant"):
        governance.audit_changes(before, after, ["id"], ["name"], for_tenant=10)


def test_batch_search_meets_vectors_of_its_own_length(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0]), ("c", [0.5, 0.5]), ("d", [3.0, 0.1, 0.2]), ("e", [0.0, 0.0]), ("f", None), ("g", [1.0, None])]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(2)
    asked = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 0.0, 0.0]), ("r", None)], "n string, v array<double>")
    got = sorted(tuple(r) for r in vectors.nearest_batch(df, "v", "k", asked, "v", "n", 5).collect())
    want = []
    for name, vector in [("p", [1.0, 0.0]), ("q", [1.0, 0.0, 0.0])]:
        near = vectors.nearest(df.where("NOT exists(v, x -> x IS NULL)"), "v", vector, 5, "k").collect()
        want += [(name, r["k"], r["distance"], i) for i, r in enumerate(near, 1)]
    assert [(q, k, i) for q, k, _, i in got] == [(q, k, i) for q, k, _, i in want]
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(3, 90), (90, 5), (10, 12)], "src int, dst int")
    far = {r["node"]: r["distance"] for r in lineage.downstream(chain, 0).collect()}
    assert far[40] == 39 and far[12] == 11 and far[90] == 4 and len(far) == 41
    found = sorted((r["position"], r["node"]) for r in lineage.path(chain, 0, 20).collect())
    assert found == list(enumerate([*range(11), *range(12, 21)]))
    assert [tuple(r) for r in lineage.path(chain, 7, 7).collect()] == [(0, 7)]
    assert lineage.path(chain, 20, 0).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_stat_sets_by_histogram_equal_those_by_columns(spark, by):
    df = spark.range(0, 3000, 1, 4).selectExpr(
        "IF(id % 7 = 0, NULL, id % 5) AS g",
        "CAST(IF(id % 3 = 0, NULL, 1700000000000 + id % 41) AS bigint) AS a",
        "CAST(id % 13 AS int) AS b",
        "CAST((id % 29) / 4 AS decimal(9,3)) AS c",
        "CAST(IF(id % 4 = 0, NULL, id * 1.25) AS decimal(18,2)) AS d",
        "IF(id % 11 = 0, NULL, CAST(id AS double) / 8 - 100) AS e",
        "CAST(id % 17 AS float) AS f",
        "CAST(IF(id < 5, id, NULL) AS int) AS h",
    )
    for columns in (["a", "b", "h"], ["c", "d"], ["e", "f"], ["a", "c", "e", "h"]):
        numbers = df.select(*by, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
        types = [numbers.schema[f"__v{i}"].dataType for i in range(len(columns))]
        expected = aggregates._stat_set_wide(numbers, columns, types, by)
        got = aggregates.stat_set(df, columns, by)
        assert dict(got.dtypes) == dict(expected.dtypes)
        order = [*by, "column"]
        pairs = zip(got.select(expected.columns).sort(*order).collect(), expected.sort(*order).collect(), strict=True)
        for one, other in pairs:
            for name in expected.columns:
                # Sums of floating numbers add up in another order, and Spark's own deviation of large numbers is rough.
                near = 1e-5 if name == "stddev_value" else 1e-9
                assert one[name] == (pytest.approx(other[name], rel=near) if isinstance(other[name], float) else other[name])


def test_deviations_of_large_numbers_close_to_each_other(spark):
    values = [10**15 + i % 41 for i in range(500)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x long, g int")
    assert aggregates.stat_set(df, ["x"]).first()["stddev_value"] == pytest.approx(statistics.stdev(values), rel=1e-12)
    grouped = {r["g"]: r["stddev_value"] for r in aggregates.stat_set(df, ["x"], ["g"]).collect()}
    assert grouped == {g: pytest.approx(statistics.stdev(values[g::2]), rel=1e-12) for g in (0, 1)}


def test_stat_sets_read_their_table_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS g", "id % 10 AS x", "id / 2 AS y").write.parquet(str(tmp_path / "t"))
    plan = aggregates.stat_set(spark.read.parquet(str(tmp_path / "t")), ["x", "y"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_histogram_counts_each_value_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (None, 2.0)], "x int, y double")
    got = {(r["column_no"], r["w"], r["f"]): r["n"] for r in aggregates.value_histogram(df, ["x", "y"]).collect()}
    assert got == {(0, 1, None): 2, (0, None, None): 1, (1, None, 2.0): 2, (1, None, None): 1}
    # A column of many digits takes the wide way.
    wide = df.selectExpr("CAST(x AS decimal(38,4)) AS x", "CAST(x AS decimal(10,0)) AS y")
    assert aggregates.stat_set(df.selectExpr("CAST(NULL AS int) AS x"), ["x"]).first()["nulls"] == 3
    assert [(r["n"], r["nulls"], r["distinct_values"]) for r in aggregates.stat_set(wide, ["x", "y"]).collect()] == [(2, 1, 1)] * 2

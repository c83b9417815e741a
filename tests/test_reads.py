"""Data sets, filters, joins, paging and search on the small frames of the specification."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused, UnknownField
from weftline.functions import formula as fx
from weftline.functions.columntypes import column_type, required, strict_cast, unconvertible
from weftline.functions.predicates import FILTERABLE, Condition, Group, all_of, any_of, build, by_fields
from weftline.operators import joins, paging, search, setops
from weftline.operators.datasets import open_data_set, open_named, project_declared, rename_fields, union_all
from weftline.specs import DataSetSpec, FieldSpec, JoinSpec, SourceSpec


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "Vega"), (2, "Orin"), (3, "Sable")], "Id int, Name string")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, 64), (2, 5)], "CustomerId int, Amount int")


def federated(how):
    return DataSetSpec(
        "CustomerOrders",
        "federated",
        [SourceSpec("customers", "a"), SourceSpec("orders", "b")],
        [JoinSpec("customers", "orders", [("Id", "CustomerId")], how)],
        [("customers", "Name", "Name"), ("orders", "Amount", "Amount")],
    )


def test_inner_join_of_two_stores(customers, orders, rows):
    got = open_data_set(federated("inner"), {"customers": customers, "orders": orders})
    assert rows(got) == [("Orin", 5), ("Vega", 64)]


def test_left_join_keeps_unmatched_rows(customers, orders, rows):
    frames = {"customers": customers.where("Id < 3"), "orders": orders.where("CustomerId = 1")}
    assert rows(open_data_set(federated("left"), frames)) == [("Orin", None), ("Vega", 64)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_joins_equal_the_built_in_ones(spark, rows, how):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (5, "e")], "x int, l string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "y int, r string")
    want = left.join(right, left["x"] == right["y"], how)
    assert rows(joins.join_frames(left, right, [("x", "y")], how)) == rows(want)


def test_unknown_source_is_refused(customers):
    with pytest.raises(Refused, match="orders"):
        open_data_set(federated("inner"), {"customers": customers})


def test_data_sets_of_data_sets(customers, rows):
    names = DataSetSpec("Names", "simple", [SourceSpec("customers", fields=[FieldSpec("Name", "n")])])
    again = DataSetSpec("Again", "simple", [SourceSpec("NAMES", fields=[FieldSpec("n", "m")])])
    loop = DataSetSpec("Loop", "simple", [SourceSpec("loop")])
    specs = {"Names": names, "Again": again, "Loop": loop}
    assert rows(open_named("again", specs, {"customers": customers})) == [("Orin",), ("Sable",), ("Vega",)]
    with pytest.raises(Refused, match="reads itself"):
        open_named("Loop", specs, {})
    with pytest.raises(Refused, match="unknown data set"):
        open_named("Other", specs, {})


def test_compound_sources_share_a_store():
    with pytest.raises(Refused, match="several stores"):
        DataSetSpec("x", "compound", [SourceSpec("a", "one"), SourceSpec("b", "two")])


def test_simple_set_has_one_source():
    with pytest.raises(Refused):
        DataSetSpec("x", "simple", [SourceSpec("a"), SourceSpec("b")])


def test_concatenation(spark, rows):
    a, b = (spark.createDataFrame([(n,)], "Name string") for n in ("oak", "elm"))
    assert rows(union_all(a, b)) == [("elm",), ("oak",)]


def test_rename_reaches_nested_fields_and_drops_physical_names(spark):
    readings = spark.createDataFrame([((0.25,), "probe-4", 86400)], "sample struct<ph:double>, device string, at long")
    got = rename_fields(readings, {"sample.ph": "Acidity", "device": "Probe"})
    assert sorted(got.columns) == ["Acidity", "Probe", "at"]
    assert got.first().asDict() == {"Probe": "probe-4", "Acidity": 0.25, "at": 86400}


def test_declared_projection_types_missing_fields(spark):
    df = spark.createDataFrame([("7",)], "a string")
    got = project_declared(df, [FieldSpec("b", "y"), FieldSpec("a", "x", T.IntegerType()), FieldSpec("a", "z", deleted=True)])
    assert got.columns == ["y", "x"] and tuple(got.first()) == (None, 7)


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "50%", 3.0), (2, "5x%", None), (3, "ab_c", 9.0)], "id int, name string, v double")

    def ids(node):
        return [r[0] for r in rows(df.where(build(node, df.schema)), "id")]

    assert ids(Condition("NAME", "contains", "0%")) == [1]
    assert ids(Condition("name", "contains", "b_c")) == [3]
    assert ids(Condition("name", "starts_with", "5")) == [1, 2]
    assert ids(Condition("v", "is_null")) == [2]
    assert ids(any_of(Condition("id", "equal", 1), all_of(Condition("v", "greater", 5), Condition("id", "not_in", [1])))) == [1, 3]


def test_filter_refusals(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType(), metadata={FILTERABLE: False})])
    with pytest.raises(Refused, match="operator"):
        build(Condition("a", "sounds_like", 1), schema)
    with pytest.raises(Refused, match="'b'"):
        build(Condition("b", "equal", 1), schema)
    with pytest.raises(Refused, match="unknown field"):
        build(Condition("c", "equal", 1), schema)
    with pytest.raises(Refused):
        build(Group("none", [Condition("a", "equal", 1)]), schema)


def test_unfilterable_mark_survives_projection(spark):
    df = project_declared(spark.createDataFrame([(1,)], "a int"), [FieldSpec("a", "x", filterable=False)])
    with pytest.raises(Refused, match="not filterable"):
        by_fields({"X": "1"}, df.schema)


def test_by_fields_without_usable_parameter(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert by_fields({"nope": "1", "a": ""}, df.schema) is None


def test_paging_follows_the_order(spark):
    boats = spark.createDataFrame(
        [("heron", "f"), ("tern", "k"), ("gull", "a"), ("skua", "q"), ("auk", "d"), ("eider", "h")], "Boat string, Berth string"
    )
    assert [r["Boat"] for r in paging.order_by(boats, "-Berth").collect()] == ["skua", "tern", "eider", "heron", "auk", "gull"]
    assert [r["Boat"] for r in paging.page(boats, 2, 3, ["-Berth"]).collect()] == ["eider", "heron", "auk"]


def test_page_without_order_or_key_is_refused(customers):
    with pytest.raises(Refused):
        paging.page(customers, 0, 1)


def test_deep_page_equals_shallow_page(customers, rows, monkeypatch):
    shallow = rows(paging.page(customers, 1, 1, key=["Id"]))
    monkeypatch.setattr(paging, "DEEP", 0)
    assert rows(paging.page(customers, 1, 1, key=["Id"])) == shallow == [(2, "Orin")]


@pytest.mark.parametrize(("take", "more"), [(2, True), (3, False), (4, False)])
def test_page_tells_whether_more_follow(customers, take, more):
    got = paging.page_with_more(customers, 0, take, key=["Id"]).collect()
    assert len(got) == min(take, 3) and {r["has_more"] for r in got} == {more}


def test_row_ceiling_fails_instead_of_cutting(customers):
    assert paging.row_ceiling(customers, 3).count() == 3
    with pytest.raises(Exception, match="more than 2 rows"):
        paging.row_ceiling(customers, 2).collect()


def test_rows_per_source_must_be_positive(customers):
    with pytest.raises(Refused):
        paging.rows_per_source(customers, 0, ["Id"])


def test_keyset_pages_meet(customers):
    first = [r["Id"] for r in paging.page_after(customers, "Id", None, 2).collect()]
    second = [r["Id"] for r in paging.page_after(customers, "Id", first[-1], 2).collect()]
    assert first + second == [1, 2, 3]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Olga", "Bern"), (2, "Tim", "Volos"), (3, "Rik", "Graz")], "Id int, Name string, City string")


def test_find_names_the_fields_that_matched(people):
    got = {r["Id"]: r["matched"] for r in search.find_text(people, "OL").collect()}
    assert got == {1: ["Name"], 2: ["City"]}
    assert [r["Id"] for r in search.find_text(people, "ol", case_sensitive=True).collect()] == [2]
    assert search.find_text(people, "OL", case_sensitive=True).count() == 0


def test_find_stops_at_the_limit_in_key_order(spark):
    df = spark.createDataFrame([(9, "bark"), (4, "lark"), (6, "ark"), (5, "park")], "Id int, Name string")
    assert [r["Id"] for r in search.find_text(df, "ark", max_results=2, key=["Id"]).collect()] == [4, 5]


def test_find_refusals(people):
    with pytest.raises(Refused):
        search.find_text(people, "")
    with pytest.raises(UnknownField, match="Town"):
        search.find_text(people, "x", ["Town"])
    with pytest.raises(Refused):
        search.find_text(people, "x", max_results=-1)


def test_catalog_search_orders_by_kind_and_name(spark):
    kinds = {
        "view": spark.createDataFrame([("beta", "about sales"), ("Alpha", None)], "name string, description string"),
        "table": spark.createDataFrame([("Sales", None)], "name string, description string"),
    }
    assert [r["name"] for r in search.catalog_search(kinds).collect()] == ["Sales", "Alpha", "beta"]
    assert [r["name"] for r in search.catalog_search(kinds, "SALES").collect()] == ["Sales", "beta"]
    assert [r["name"] for r in search.catalog_search(kinds, "", "VIEW").collect()] == ["Alpha", "beta"]


def test_schema_diff_ignores_case(spark, rows):
    stored = spark.createDataFrame([("Id",), ("Name",)], "name string")
    now = spark.createDataFrame([("id",), ("Age",), ("AGE",)], "name string")
    diff = setops.schema_diff(stored, now, "name")
    assert rows(diff) == [("age", "added"), ("name", "removed")]
    assert spark.range(1).select(setops.has_changes(diff)).first()[0] is True


def test_children_come_in_bounded_blocks(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, i) for i in range(7)], "parent int, n int")
    got = joins.parent_child(parents, "id", children, "parent", ["n"], "items", block=3).collect()
    lists = {(r["id"], r["block_no"]): [i["n"] for i in r["items"]] for r in got}
    assert lists == {(1, 0): [0, 1, 2], (1, 1): [3, 4, 5], (1, 2): [6], (2, 0): []}


def test_scoped_overlay(spark):
    rows = [
        (1, "a", None, None, False), (2, "a", 1, None, False), (3, "a", 1, 2, True),
        (4, "b", None, None, True), (5, "b", 1, 2, False),
        (6, "c", None, None, False), (7, "c", 1, None, True), (8, "c", 1, 2, False),
    ]
    df = spark.createDataFrame(rows, "row_id int, code string, tenant_id int, organization_id int, locked boolean")
    other = spark.createDataFrame(
        [(9, "a", 7, None, True), (10, "b", 7, 2, True), (11, "c", 1, 3, True), (12, "d", 7, None, False)], df.schema
    )

    def chosen(*scope):
        return {r["code"]: r["row_id"] for r in joins.scoped_overlay(df.union(other), "code", "row_id", *scope).collect()}

    assert chosen(1, 2) == {"a": 3, "b": 4, "c": 7}
    assert chosen(1) == {"a": 2, "b": 4, "c": 7}
    assert chosen(7, 2) == {"a": 9, "b": 4, "c": 6, "d": 12}
    assert chosen(5) == {"a": 1, "b": 4, "c": 6}


def test_column_types():
    assert column_type(" LONG ") == T.LongType()
    assert column_type("NVarChar(max)") == T.StringType()
    assert column_type("numeric(10,2)") == T.DecimalType(10, 2)
    assert column_type("Money") == T.DecimalType(19, 4)
    with pytest.raises(Refused, match="geometry"):
        column_type("geometry")


def test_conversions_fail_instead_of_defaulting(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    assert df.where(unconvertible(F.col("v"), T.IntegerType())).count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(strict_cast(F.col("v"), T.IntegerType())).collect()
    with pytest.raises(Exception, match="not nullable"):
        df.select(required(F.col("v"), "v")).collect()


def test_formula_refusals(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(Refused, match="reflect"):
        fx.to_column(fx.call("reflect", fx.field("a")))
    with pytest.raises(Refused, match="arguments"):
        fx.to_column(fx.call("nullif", fx.field("a")))
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        fx.validate(fx.field("b"), df)
    assert fx.validate(fx.call("+", fx.field("a"), fx.value(1)), df) == "int"

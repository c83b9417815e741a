"""Next states of tables: keys, versions, soft deletes, refusals, publishing."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from weftline.errors import Refused, UnknownField
from weftline.operators import governance, writes
from weftline.operators.writes import SoftDelete
from weftline.sources import sinks
from weftline.specs import TableSpec

PEOPLE = TableSpec("people", ["RowId", "Name"], "RowId")
VERSIONS = TableSpec("versions", ["RowId", "Id", "Name", "IsCurrent", "IsDeleted"], "RowId", ["Id"])


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "iris"), (2, "moss")], "RowId long, Name string")


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(
        [(1, "AA-1", "Alpha", True, False), (2, "bb-2", "Beta", True, True)],
        "RowId long, Id string, Name string, IsCurrent boolean, IsDeleted boolean",
    )


def test_insert_numbers_rows_and_keeps_carried_keys(spark, people, rows):
    new = spark.createDataFrame([(None, "yew"), (41, "fern"), (None, "sedge")], "RowId long, Name string")
    change = writes.insert_append(people, new, PEOPLE, ["Name"])
    assert rows(change.state) == [(1, "iris"), (2, "moss"), (41, "fern"), (42, "sedge"), (43, "yew")]
    assert change.written.count() == 3


def test_insert_into_an_empty_table_starts_at_one(spark, people, rows):
    new = spark.createDataFrame([("sedge",)], "name string")
    assert rows(writes.insert_append(people.where("RowId < 0"), new, PEOPLE, ["Name"]).state) == [(1, "sedge")]


def test_insert_of_an_undeclared_column_is_refused(spark, people):
    with pytest.raises(UnknownField, match="Age"):
        writes.insert_append(people, spark.createDataFrame([(1,)], "Age int"), PEOPLE, ["Name"])


def test_update_leaves_keys_and_flags(versions, rows):
    change = writes.update_where(
        versions, VERSIONS, F.col("Id") == "AA-1", {"name": "AlphaEdited", "RowId": 9, "IsCurrent": False}
    )
    assert rows(change.state) == [(1, "AA-1", "AlphaEdited", True, False), (2, "bb-2", "Beta", True, True)]
    assert change.written.count() == 1
    assert writes.update_where(versions, VERSIONS, F.col("Id") == "none", {"Name": "x"}).written.count() == 0
    with pytest.raises(Refused, match="no updatable"):
        writes.update_where(versions, VERSIONS, F.lit(True), {"RowId": 1, "IsDeleted": True})


def test_delete_states_what_it_removes(people, rows):
    assert rows(writes.delete_where(people, F.col("Name") == "iris").state) == [(2, "moss")]
    assert writes.delete_where(people, all_rows=True).state.count() == 0
    with pytest.raises(Refused):
        writes.delete_where(people)


def test_delete_keeps_rows_the_filter_cannot_judge(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "RowId long, Name string")
    assert [r["RowId"] for r in writes.delete_where(df, F.col("Name") == "x").state.collect()] == [1]


def test_soft_delete_flags_once_and_keeps_all_rows(versions):
    first = writes.soft_delete(versions, VERSIONS, SoftDelete("IsDeleted"), F.lit(True))
    assert (first.written.count(), first.state.count()) == (1, 2)
    again = writes.soft_delete(first.state, VERSIONS, SoftDelete("IsDeleted"), F.lit(True))
    assert again.written.count() == 0


def test_soft_delete_with_a_false_flag_closes_the_row(versions, rows):
    change = writes.soft_delete(versions, VERSIONS, SoftDelete("IsCurrent", False), F.col("Id") == "AA-1")
    assert rows(change.written) == [(1, "AA-1", "Alpha", False, False)]


def test_soft_delete_of_absent_rows_ignores_case_and_never_matches_null(spark, rows):
    table = spark.createDataFrame([("A", False), ("b", None), (None, False)], "Id string, Gone boolean")
    spec = TableSpec("t", ["Id", "Gone"])
    source = spark.createDataFrame([("a",), (None,)], "Id string")
    change = writes.soft_delete(table, spec, SoftDelete("Gone", absent_keys=["Id"]), source=source)
    assert rows(change.state) == [("A", False), ("b", True), (None, True)]


def test_soft_delete_refusals(versions):
    with pytest.raises(UnknownField, match="NoSuchFlag"):
        writes.soft_delete(versions, VERSIONS, SoftDelete("NoSuchFlag"), F.lit(True))
    with pytest.raises(Refused):
        writes.soft_delete(versions, VERSIONS, SoftDelete("IsDeleted"))


def test_save_closes_the_prior_version(spark, versions, rows):
    new = spark.createDataFrame([("aa-1", "AlphaV2", 1), ("cc-3", "Gamma", 2)], "Id string, Name string, n int")
    change = writes.version_save(versions, new.drop("n"), VERSIONS, ["Id"])
    assert rows(change.state) == [
        (1, "AA-1", "Alpha", False, False),
        (2, "bb-2", "Beta", True, True),
        (3, "aa-1", "AlphaV2", True, False),
        (4, "cc-3", "Gamma", True, False),
    ]


def test_save_over_a_deleted_row_and_twice_in_one_save(spark, versions, rows):
    new = spark.createDataFrame([("bb-2", "B1"), ("bb-2", "B2")], "Id string, Name string")
    change = writes.version_save(versions, new, VERSIONS, ["Name"])
    assert rows(change.state, "RowId", "Name", "IsCurrent", "IsDeleted") == [
        (1, "Alpha", True, False), (2, "Beta", False, True), (3, "B1", False, False), (4, "B2", True, False)
    ]


def test_retire_marks_in_place(spark, versions, rows):
    ids = spark.createDataFrame([("aa-1",), ("bb-2",), ("zz",)], "Id string")
    change = writes.version_retire(versions, ids, VERSIONS)
    assert rows(change.written) == [(1, "AA-1", "Alpha", True, True)]
    assert change.state.count() == 2


def test_upsert_and_insert_if_new(spark, people, rows):
    new = spark.createDataFrame([(2, "mint"), (3, "sedge")], "RowId int, Name string")
    assert rows(writes.upsert(people, new, PEOPLE, ["RowId"]).state) == [(1, "iris"), (2, "mint"), (3, "sedge")]
    once = writes.insert_if_new(people, new, PEOPLE, ["rowid"])
    assert rows(once.state) == [(1, "iris"), (2, "moss"), (3, "sedge")]
    assert writes.insert_if_new(once.state, new, PEOPLE, ["RowId"]).written.count() == 0


def test_upsert_takes_the_last_of_equal_keys(spark, people, rows):
    spec = TableSpec("t", ["RowId", "Name"])
    new = spark.createDataFrame([(2, "a"), (2, "b")], "RowId long, Name string")
    assert rows(writes.upsert(people, new, spec, ["RowId"], order=["Name"]).written) == [(2, "b")]


def test_returning_names_declared_columns(people):
    change = writes.update_where(people, PEOPLE, F.lit(True), {"Name": "x"})
    assert writes.returning(change, PEOPLE, ["name"]).columns == ["Name"]
    with pytest.raises(UnknownField, match="Nope"):
        writes.returning(change, PEOPLE, ["Nope"])


def test_replace_publishes_one_table_only(spark, people, rows, tmp_path):
    north, south = str(tmp_path / "north"), str(tmp_path / "south")
    assert sinks.publish(people, north) == 2
    sinks.publish(people, south)
    sinks.publish(writes.insert_replace(people, spark.createDataFrame([(3, "sedge")], "RowId long, Name string"), PEOPLE).state, north)
    assert rows(spark.read.parquet(north)) == [(3, "sedge")]
    assert spark.read.parquet(south).count() == 2


def test_a_table_may_be_rewritten_from_itself(spark, people, rows, tmp_path):
    path = str(tmp_path / "self")
    sinks.publish(people, path)
    sinks.publish(writes.delete_where(spark.read.parquet(path), F.col("RowId") == 1).state, path)
    assert rows(spark.read.parquet(path)) == [(2, "moss")]


def test_a_failed_publish_leaves_the_old_table(spark, people, rows, tmp_path):
    path = str(tmp_path / "kept")
    sinks.publish(people, path)
    broken = people.withColumn("Name", F.when(F.col("RowId") == 2, F.raise_error(F.lit("late"))).otherwise("x"))
    with pytest.raises(Exception, match="late"):
        sinks.publish(broken, path)
    assert rows(spark.read.parquet(path)) == [(1, "iris"), (2, "moss")]


def test_audit_lists_changed_fields(spark, rows):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    after = spark.createDataFrame([(1, "a", 5), (3, None, 3)], "id int, x string, y int")
    assert rows(governance.audit_changes(before, after, ["id"], ["x", "y"])) == sorted(
        [(1, "y", "1", "5"), (2, "x", "b", None), (2, "y", "2", None), (3, "y", None, "3")], key=repr
    )


def test_classified_read_leaves_out_what_is_above(spark):
    df = governance.classify(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), {"B": "internal", "c": "restricted"})
    assert governance.classified_read(df, "public").columns == ["a"]
    assert governance.classified_read(df, "confidential").columns == ["a", "b"]
    with pytest.raises(Refused):
        governance.classify(df, {"a": "secret"})


def test_stand_ins(spark):
    df = spark.createDataFrame([("4111111111111111", "ab")], "card string, short string")
    masked = governance.stand_in(df, {"card": governance.StandIn("partial"), "short": governance.StandIn("partial")}).first()
    assert tuple(masked) == ("************1111", "ab")
    with pytest.raises(Refused):
        governance.stand_in(df, {"card": governance.StandIn("shuffle")}).collect()


def test_retention_leaves_the_archive_alone(spark):
    day = datetime.datetime(2020, 1, 1)
    paths = ["Invoices/a.pdf", "archive/Invoices/a.pdf", "root.pdf", "Other/b.pdf"]
    df = spark.createDataFrame([(p, day) for p in paths], "path string, modified timestamp_ntz")
    got = governance.retention_select(df, "path", "modified", {"Invoices": F.lit("2021-01-01").cast("timestamp_ntz")}, "delete")
    assert [r["path"] for r in got.collect()] == ["Invoices/a.pdf"]


def test_attributes_read_back_by_slot(spark, rows):
    schema = "owner int, code string, text string, number double, date date, flag boolean"
    stored = spark.createDataFrame([(1, "size", None, 3.0, None, None), (1, "name", "x", None, None, None)], schema)
    new = spark.createDataFrame([(1, "SIZE", None, 4.0, None, None), (2, "name", "y", None, None, None)], schema)
    change = writes.attribute_upsert(stored, new, "owner", "code")
    table = writes.attribute_table(change.state.withColumn("code", F.lower("code")), "owner", "code", {"size": "number", "name": "text"})
    assert rows(table) == [(1, 4.0, "x"), (2, None, "y")]
